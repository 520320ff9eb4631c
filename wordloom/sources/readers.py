"""Texts, pages, audio and alignments as DataFrames."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import html_text, keep_extracted
from ..plans.helpers import islands, range_join

#: What this package reads by itself; the others take a hook.
LOADERS = {"text": True, "html": True, "wav": True, "textgrid": True, "json": True, "pdf": False, "ocr": False, "codec": False}


def read_texts(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``source, text`` of whole text files. A missing path raises Spark's error for missing paths."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("source"), F.decode("content", encoding).alias("text"))


def read_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text``, the visible text of fetched pages."""
    return pages.withColumn("text", html_text(F.col(html)))


def read_documents(spark: SparkSession, path: str, extract, schema: str = "page int, text string") -> DataFrame:
    """Paged documents by a hook ``extract(bytes) -> list[str]``: page texts joined by one blank."""

    def run(batches):
        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                pages = extract(bytes(content))
                yield pd.DataFrame({"source": source, "text": [" ".join(pages)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source string, text string")


def text_or_scan(extracted: DataFrame, scanned: DataFrame, key: str = "source") -> DataFrame:
    """Extracted text where it is good enough, else what was read from the scan."""
    s = scanned.select(key, F.col("text").alias("_scan"))
    return extracted.join(s, key, "left").withColumn("text", F.when(keep_extracted(F.col("text")), F.col("text")).otherwise(F.coalesce("_scan", "text"))).drop("_scan")


def read_wav(spark: SparkSession, path: str, fallback=None) -> DataFrame:
    """``source, rate, channels array<array<float>>`` of PCM WAV files. ``fallback(bytes) -> (array, rate)`` decodes what isn't WAV."""

    def decode(content: bytes):
        try:
            with wave.open(io.BytesIO(content)) as w:
                width, n = w.getsampwidth(), w.getnchannels()
                raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).reshape(-1, n).T
                return (raw.astype(np.float32) - 128) / 128 if width == 1 else raw.astype(np.float32) / float(1 << (8 * width - 1)), w.getframerate()
        except (wave.Error, EOFError, KeyError):
            if fallback is None:
                raise
            return fallback(content)

    def run(batches):
        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                data, rate = decode(bytes(content))
                yield pd.DataFrame({"source": [source], "rate": [rate], "channels": [[c.tolist() for c in data]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source string, rate int, channels array<array<float>>")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono samples as a 16-bit PCM WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def parse_textgrid(grids: DataFrame, by: str = "source", text: str = "text", frame_duration: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Words and phones of interval grids.

    Words are the intervals with a mark of the tier ``words``; frames are truncated. Phones go to the
    word that holds their start, ``start <= phone < end``, the first if several do.
    """
    tiers = grids.select(by, F.posexplode(F.split(text, r"item \[\d+\]:")).alias("n", "tier")).where("n > 0")
    tiers = tiers.select(by, F.regexp_extract("tier", r'name = "([^"]*)"', 1).alias("name"), "tier")
    number = r"([-+0-9.eE]+)"
    one = rf'intervals \[\d+\]:\s*xmin = {number}\s*xmax = {number}\s*text = "([^"]*)"'
    marks = tiers.select(by, "name", F.posexplode(F.regexp_extract_all("tier", F.lit(one), F.lit(0))).alias("k", "m"))
    part = lambda i: F.regexp_extract("m", one, i)
    rows = marks.select(by, "name", "k", part(1).cast("double").alias("start_s"), part(2).cast("double").alias("end_s"), F.trim(part(3)).alias("mark")).where("mark <> ''")
    frame = lambda c: (F.col(c) / frame_duration).cast("long")
    words = rows.where("name = 'words'").select(by, (F.row_number().over(Window.partitionBy(by).orderBy("k")) - 1).alias("index"), F.col("mark").alias("word"), frame("start_s").alias("start_frame"), frame("end_s").alias("end_frame"), F.col("start_s").alias("w_start"), F.col("end_s").alias("w_end"))
    phones = rows.where("name = 'phones'").select(by, F.col("k").alias("pos"), F.col("mark").alias("phone"), "start_s", "end_s")
    held = range_join(phones, words.select(by, "index", "w_start", "w_end"), [by], "start_s", "w_start", "w_end", 1.0)
    held = held.groupBy(by, "pos", "phone", "start_s", "end_s").agg(F.min("index").alias("word_index"))
    return words.drop("w_start", "w_end"), held


#: The recogniser's JSON: words with their case, times and phones.
ALIGNED_JSON = "struct<words:array<struct<word:string,alignedWord:string,case:string,start:double,end:double,phones:array<struct<phone:string,duration:double>>>>>"


def parse_aligned_json(results: DataFrame, by: str = "source", text: str = "text", frame_duration: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words with case ``success``, runs of the other indices as holes, and phones with running starts, of aligned-word JSON."""
    rows = results.select(by, F.posexplode(F.from_json(text, ALIGNED_JSON)["words"]).alias("index", "w")).select(by, F.col("index").cast("long").alias("index"), "w.*")
    frame = lambda c: (F.col(c) / frame_duration).cast("long")
    good = rows.where(F.col("case") == "success")
    words = good.select(by, "index", "word", frame("start").alias("start_frame"), frame("end").alias("end_frame"))
    w = Window.partitionBy(by).orderBy("index")
    lost = rows.where(F.coalesce(F.col("case") != "success", F.lit(True))).withColumn("_before", F.lag("index").over(w))
    holes = islands(lost, [by], ["index"], F.col("_before").isNull() | (F.col("index") - F.col("_before") > 1), "_run").groupBy(by, "_run").agg(F.min("index").alias("start_idx"), F.max("index").alias("end_idx")).drop("_run")
    spread = good.select(by, "index", frame("start").alias("_at"), F.posexplode("phones").alias("pos", "p")).withColumn("n", (F.col("p.duration") / frame_duration).cast("long"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by, "index").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    phones = spread.select(by, F.col("index").alias("word_index"), "pos", F.col("p.phone").alias("phone"), (F.col("_at") + before).alias("start_frame"), (F.col("_at") + before + F.col("n")).alias("end_frame"))
    return words, holes, phones


def source_table(sources: DataFrame, kind: Column, readers: dict) -> DataFrame:
    """Each source by the reader of its kind, all in one table ``source, text``."""
    out = None
    for name, read in readers.items():
        part = read(sources.where(kind == name)).select("source", "text")
        out = part if out is None else out.unionByName(part)
    return out
