"""The whole way from recordings and transcripts to word timelines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import AlignmentConfig
from .functions.labels import add_star
from .functions.numbers import expand_numbers
from .functions.scripts import romanize_aligned, split_characters
from .functions.text import collapse, normalize_mms_words, words
from .functions.tokenizers import CharTokenizer
from .operators import decoding, stitching
from .operators import words as timeline
from .operators.timeline import frame_offset, segment_windows

#: Languages that are written without blanks between words.
UNSPACED = ("cmn", "zho", "jpn", "yue")
#: Languages whose numbers the built-in speller knows.
SPELLED = ("eng", "en")


def prepare_transcripts(transcripts: DataFrame, language: str = "eng", expand: bool = True, romanizer=None, text: str = "text") -> DataFrame:
    """``recording_id, idx, original, normalized``: words of transcripts, in one pass and with one entry an original word.

    White space is collapsed, unspaced scripts are split into characters, words are romanised if a
    romaniser is given, numbers are spelled, and what is left is normalised. A changed number of words
    raises.
    """
    source: Column = collapse(F.col(text))
    if language in UNSPACED:
        source = split_characters(source)
    out = transcripts.select("recording_id", words(source).alias("original"))
    plain = romanize_aligned(F.array_join("original", " "), romanizer) if romanizer is not None else F.col("original")
    if expand and language in SPELLED:
        plain = expand_numbers(plain)
    out = out.withColumn("normalized", normalize_mms_words(plain))
    same = F.when(F.size("original") == F.size("normalized"), F.col("normalized")).otherwise(F.raise_error(F.lit("the number of words changed")).cast("array<string>"))
    return out.select("recording_id", F.posexplode(F.arrays_zip("original", same.alias("normalized"))).alias("idx", "w")).select("recording_id", "idx", "w.original", "w.normalized")


def segment_recordings(recordings: DataFrame, config: AlignmentConfig = AlignmentConfig()) -> DataFrame:
    """Windows of recordings ``recording_id, n_samples``, with their offset in frames."""
    out = segment_windows(recordings, rate=config.sample_rate, size=config.segment_size, overlap=config.overlap, least=config.least_segment, extra=config.extra_samples)
    return out.withColumn("frame_offset", frame_offset(F.col("offset"), config.sample_rate, config.frame_duration))


@dataclass
class Alignment:
    """Words, unaligned regions and per-segment decisions of all recordings."""

    words: DataFrame
    holes: DataFrame
    segments: DataFrame


def align(emissions: DataFrame, reference: DataFrame, tokenizer: CharTokenizer, segments: DataFrame, config: AlignmentConfig = AlignmentConfig()) -> Alignment:
    """Word timelines of ``emissions(recording_id, segment_index, frame, logp)``, given their transcripts' words.

    Every transcript becomes one decoding graph. Segments are decoded apart from each other; only the
    stitching brings a recording together. ``segments`` has the frame offsets.
    """
    by = "recording_id"
    star = len(tokenizer.labels)
    scores = F.when(F.size("logp") < star, add_star(F.col("logp"))).otherwise(F.col("logp"))
    stacked = emissions.groupBy(by, "segment_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", scores.alias("x")))), lambda e: e["x"]).alias("logp"))
    encoded = reference.select(by, "idx", tokenizer.encode_word(F.col("normalized")).alias("ids"))
    tokens = decoding.token_table(encoded, by, tokenizer.ids.get(tokenizer.unknown) if tokenizer.unknown else None)
    arcs = decoding.factor_arcs(tokens, by, config.blank_penalty, config.skip_penalty, config.return_penalty)
    sizes = tokens.groupBy(by).agg(F.max("n").alias("n"))
    paths = decoding.decode_segments(stacked, decoding.graph_arrays(arcs, by), by)
    decided = decoding.segment_decisions(paths, sizes, by, config.frame_score_threshold, config.skip_threshold, config.return_threshold)
    found = decoding.attach_symbols(decoding.path_tokens(paths, sizes, by), decoding.symbols(tokens, by), segments.select(by, "segment_index", "frame_offset"), by)
    found = found.join(decided.where(~F.col("rejected")).select(by, "segment_index"), [by, "segment_index"], "left_semi")
    stitched, holes = stitching.stitch_lis(found, drop_exits=config.drop_exits, scan=config.outlier_scan, jump=config.outlier_jump, size=config.neighborhood_size, share=config.neighbor_threshold)
    return Alignment(timeline.build_words(stitched, reference, [by]), holes, decided)
