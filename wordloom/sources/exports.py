"""Timelines as text: JSON, label tracks, subtitles, interval grids, karaoke lines and pages.

Every function takes words ``recording_id, index, word, start_frame, end_frame, score, original`` and
gives rows; the ``*_file`` forms give one text a recording, in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.words import BY, FRAME_DURATION, seconds, with_position
from ..plans.helpers import ordered_concat


def _rounded(value: Column, digits: int) -> Column:
    """Half-even on the double, as most JSON writers print."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def json_words(words: DataFrame, by: list[str] = BY, frame_duration=FRAME_DURATION, chars: str | None = None) -> DataFrame:
    """One JSON object a word. ``original`` only if it differs, ``score`` only above 0, ``index`` only from 0."""
    fields = [
        F.col("word"), _rounded(seconds(F.col("start_frame"), frame_duration), 3).alias("start"), _rounded(seconds(F.col("end_frame"), frame_duration), 3).alias("end"),
        F.when((F.col("original") != "") & (F.col("original") != F.col("word")), F.col("original")).alias("original"),
        F.when(F.col("score") > 0, _rounded(F.col("score"), 3)).alias("score"), F.when(F.col("index") >= 0, F.col("index")).alias("index"),
    ]
    if chars:
        fields.append(F.when(F.size(chars) > 0, F.transform(chars, lambda c: F.struct(c["char"].alias("char"), _rounded(c["start"], 4).alias("start"), _rounded(c["end"], 4).alias("end"), _rounded(c["score"], 3).alias("score")))).alias("chars"))
    return words.select(*by, "index", F.to_json(F.struct(*fields)).alias("json"))


def json_file(words: DataFrame, holes: DataFrame | None = None, by: list[str] = BY, **options) -> DataFrame:
    """One JSON document a recording: words and unaligned regions."""
    out = json_words(words, by, **options).groupBy(*by).agg(ordered_concat("json", "index", ",").alias("w"))
    if holes is None:
        return out.select(*by, F.concat(F.lit('{"words":['), "w", F.lit('],"unaligned_regions":[]}')).alias("text"))
    h = holes.groupBy(*by).agg(ordered_concat(F.format_string("[%d,%d]", "start_idx", "end_idx"), "start_idx", ",").alias("h"))
    return out.join(h, by, "left").select(*by, F.concat(F.lit('{"words":['), "w", F.lit('],"unaligned_regions":['), F.coalesce("h", F.lit("")), F.lit("]}")).alias("text"))


def label_lines(words: DataFrame, by: list[str] = BY, frame_duration=FRAME_DURATION) -> DataFrame:
    """Start, end and word, by tabs, with six decimals. An empty word is its index in brackets."""
    name = F.when(F.col("word") == "", F.concat(F.lit("["), F.col("index").cast("string"), F.lit("]"))).otherwise(F.col("word"))
    return words.select(*by, "index", F.format_string("%.6f\t%.6f\t%s", seconds(F.col("start_frame"), frame_duration), seconds(F.col("end_frame"), frame_duration), name).alias("line"))


def ctm_lines(words: DataFrame, by: list[str] = BY, frame_duration=FRAME_DURATION, name: Column | None = None) -> DataFrame:
    """``<id> 1 start duration word [confidence]``, three decimals; the confidence only above 0."""
    name = F.lit("audio") if name is None else name
    sure = F.when(F.col("score") > 0, F.format_string(" %.3f", "score")).otherwise("")
    start, length = seconds(F.col("start_frame"), frame_duration), seconds(F.col("end_frame") - F.col("start_frame"), frame_duration)
    return words.select(*by, "index", F.concat(F.format_string("%s 1 %.3f %.3f %s", name, start, length, "word"), sure).alias("line"))


def lines_file(lines: DataFrame, by: list[str] = BY) -> DataFrame:
    """Lines of a recording as one text."""
    return lines.groupBy(*by).agg(ordered_concat("line", "index", "\n").alias("text"))


def clock(t: Column) -> Column:
    """HH:MM:SS,mmm with truncated milliseconds."""
    whole = F.floor(t)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ((t % 1) * 1000).cast("int"))


def clock_centi(t: Column) -> Column:
    """H:MM:SS.cc, rounded; a value just under a minute may print as 60.00."""
    whole = F.floor(t)
    return F.format_string("%d:%02d:%05.2f", F.floor(whole / 3600), F.floor(whole % 3600 / 60), t % 60)


def subtitle_cues(words: DataFrame, size: int = 10, by: list[str] = BY, frame_duration=FRAME_DURATION) -> DataFrame:
    """``by, cue, start, end, text``: a cue for every ``size`` words, numbered from 1."""
    p = with_position(words, by, "index").withColumn("cue", F.floor(F.col("position") / size).cast("int") + 1)
    start, end = seconds(F.min_by("start_frame", "position"), frame_duration), seconds(F.max_by("end_frame", "position"), frame_duration)
    out = p.groupBy(*by, "cue").agg(start.alias("_a"), end.alias("_z"), ordered_concat("word", "position", " ").alias("text"))
    return out.select(*by, "cue", clock(F.col("_a")).alias("start"), clock(F.col("_z")).alias("end"), "text")


def subtitle_file(words: DataFrame, size: int = 10, by: list[str] = BY, **options) -> DataFrame:
    cue = F.format_string("%d\n%s --> %s\n%s\n", "cue", "start", "end", "text")
    return subtitle_cues(words, size, by, **options).groupBy(*by).agg(ordered_concat(cue, "cue", "\n").alias("text"))


def textgrid_intervals(words: DataFrame, by: list[str] = BY, frame_duration=FRAME_DURATION) -> DataFrame:
    """``by, n, xmin, xmax, text`` of the word tier, numbered from 1."""
    p = with_position(words, by, "index")
    return p.select(*by, (F.col("position") + 1).alias("n"), seconds(F.col("start_frame"), frame_duration).alias("xmin"), seconds(F.col("end_frame"), frame_duration).alias("xmax"), F.col("word").alias("text"))


def textgrid_file(words: DataFrame, by: list[str] = BY, **options) -> DataFrame:
    """Interval grids with one tier, ``words``."""
    rows = textgrid_intervals(words, by, **options)
    item = F.format_string('        intervals [%d]:\n            xmin = %s\n            xmax = %s\n            text = "%s"', "n", F.col("xmin").cast("string"), F.col("xmax").cast("string"), "text")
    out = rows.groupBy(*by).agg(F.min_by("xmin", "n").alias("a"), F.max_by("xmax", "n").alias("z"), F.count("*").alias("k"), ordered_concat(item, "n", "\n").alias("items"))
    a, z = F.col("a").cast("string"), F.col("z").cast("string")
    head = F.format_string('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = %s\nxmax = %s\ntiers? <exists>\nsize = 1\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "words"\n        xmin = %s\n        xmax = %s\n        intervals: size = %d\n', a, z, a, z, "k")
    return out.select(*by, F.concat(head, "items").alias("text"))


def karaoke_lines(words: DataFrame, size: int = 8, by: list[str] = BY, frame_duration=FRAME_DURATION, style: str = "Default") -> DataFrame:
    """One dialogue line for every ``size`` words. A word's tag holds the hundredths up to the next word of the line; the last one's its own length."""
    p = with_position(words, by, "index").withColumn("line_no", F.floor(F.col("position") / size).cast("int"))
    start = seconds(F.col("start_frame"), frame_duration)
    nexts = F.lead("start_frame").over(Window.partitionBy(*by, "line_no").orderBy("position"))
    length = F.coalesce(seconds(nexts, frame_duration) - start, seconds(F.col("end_frame") - F.col("start_frame"), frame_duration))
    p = p.withColumn("tag", F.concat(F.lit("{\\kf"), (length * 100).cast("int").cast("string"), F.lit("}"), "word"))
    out = p.groupBy(*by, "line_no").agg(seconds(F.min_by("start_frame", "position"), frame_duration).alias("a"), seconds(F.max_by("end_frame", "position"), frame_duration).alias("z"), ordered_concat("tag", "position", " ").alias("tags"))
    line = F.concat(F.lit("Dialogue: 0,"), clock_centi(F.col("a")), F.lit(","), clock_centi(F.col("z")), F.lit(f",{style},,0,0,0,,"), "tags")
    return out.select(*by, "line_no", line.alias("line"))


#: The format's fields.
_STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
_EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def karaoke_file(words: DataFrame, size: int = 8, by: list[str] = BY, style: str = "Default", font: str = "Arial", font_size: int = 48, primary: str = "&H00FFFFFF", highlight: str = "&H0000FFFF", outline: str = "&H00000000", margin: int = 50, title: str = "Word timeline", **options) -> DataFrame:
    head = "\n".join([
        "[Script Info]", f"Title: {title}", "ScriptType: v4.00+", "PlayResX: 1920", "PlayResY: 1080", "Timer: 100.0000", "", "[V4+ Styles]", f"Format: {_STYLE_FIELDS}",
        f"Style: {style},{font},{font_size},{primary},{highlight},{outline},&H80000000,0,0,0,0,100,100,0,0,1,2,1,2,10,10,{margin},1", "", "[Events]", f"Format: {_EVENT_FIELDS}", "",
    ])
    out = karaoke_lines(words, size, by, style=style, **options).groupBy(*by).agg(ordered_concat("line", "line_no", "\n").alias("lines"))
    return out.select(*by, F.concat(F.lit(head), "lines").alias("text"))


def page_words(words: DataFrame, transcript: DataFrame, by: list[str] = BY, low: int = 0, high: int | None = None, frame_duration=FRAME_DURATION) -> DataFrame:
    """Every transcript word with its times, if it has any: ``by, index, word, start_s, end_s, aligned``. ``transcript(by, idx, original)``."""
    t = transcript.where(F.col("idx") >= low) if high is None else transcript.where((F.col("idx") >= low) & (F.col("idx") < high))
    w = words.select(*by, F.col("index").alias("idx"), seconds(F.col("start_frame"), frame_duration).alias("start_s"), seconds(F.col("end_frame"), frame_duration).alias("end_s"))
    return t.join(w, [*by, "idx"], "left").select(*by, F.col("idx").alias("index"), F.col("original").alias("word"), "start_s", "end_s", F.col("start_s").isNotNull().alias("aligned"))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def page_file(words: DataFrame, transcript: DataFrame, audio: str | None = None, title: str = "Word timeline", by: list[str] = BY, **options) -> DataFrame:
    """One page a recording: every transcript word as a span with its times, those without marked."""
    rows = page_words(words, transcript, by, **options)
    span = F.when(F.col("aligned"), F.format_string('<span class="word" data-start="%.3f" data-end="%.3f">%s</span>', "start_s", "end_s", _escaped(F.col("word")))).otherwise(F.format_string('<span class="gap">%s</span>', _escaped(F.col("word"))))
    player = f'<audio controls src="{audio}"></audio>' if audio else ""
    script = "<script>document.querySelectorAll('.word').forEach(w=>w.onclick=()=>{const a=document.querySelector('audio');if(a){a.currentTime=w.dataset.start;a.play()}})</script>"
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>.gap{{color:#999}}.word{{cursor:pointer}}</style></head><body>{player}<p>'
    out = rows.groupBy(*by).agg(ordered_concat(span, "index", " ").alias("spans"))
    return out.select(*by, F.concat(F.lit(head), "spans", F.lit(f"</p>{script}</body></html>")).alias("text"))


def clip_bounds(words: DataFrame, totals: DataFrame, by: list[str] = BY, padding: float = 0.05, frame_duration=FRAME_DURATION) -> DataFrame:
    """A clip for every index up to the last, holes included (``[i]``, no bounds): padded and kept within the recording. ``totals(by, duration)``."""
    span = words.groupBy(*by).agg(F.max("index").alias("_last")).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last").cast("long"))).alias("index"))
    w = words.select(*by, F.col("index").cast("long").alias("index"), "word", seconds(F.col("start_frame"), frame_duration).alias("_a"), seconds(F.col("end_frame"), frame_duration).alias("_z"))
    out = span.join(w, [*by, "index"], "left").join(totals, by)
    name = F.coalesce("word", F.concat(F.lit("["), F.col("index").cast("string"), F.lit("]")))
    return out.select(*by, "index", name.alias("word"), F.when(F.col("_a").isNotNull(), F.greatest(F.col("_a") - padding, F.lit(0.0))).alias("start_s"), F.when(F.col("_z").isNotNull(), F.least(F.col("_z") + padding, F.col("duration"))).alias("end_s"))


def save(texts: DataFrame, path: str, text: str = "text") -> None:
    """Writes one text a row, partitioned by recording, as plain text files."""
    by = [c for c in texts.columns if c != text]
    texts.select(*by, F.col(text).alias("value")).write.partitionBy(*by).text(path)
