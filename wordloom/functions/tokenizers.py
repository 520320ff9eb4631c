"""Character, subword and phoneme tokenizers over arrays of words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import UNKNOWN, transliterate, words


@dataclass(frozen=True)
class CharTokenizer:
    """One id a character. ``labels`` in id order; single characters are the vocabulary."""

    labels: tuple[str, ...]
    blank: str = "-"
    unknown: str | None = UNKNOWN
    ids: dict = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "ids", {c: i for i, c in reversed(list(enumerate(self.labels)))})

    @property
    def characters(self) -> list[str]:
        return [c for c in self.labels if len(c) == 1 and c not in (self.blank, self.unknown)]

    def _map(self) -> Column:
        return F.create_map(*[F.lit(x) for c, i in self.ids.items() if len(c) == 1 for x in (c, i)])

    def normalize_word(self, word: Column) -> Column:
        """Lower case, plain letters, vocabulary only; the unknown label if nothing is left."""
        kept = F.regexp_replace(F.lower(transliterate(word)), "[^" + "".join("\\" + c if not c.isalnum() else c for c in self.characters) + "]", "")
        return F.when(kept == "", F.lit(self.unknown or UNKNOWN)).otherwise(kept)

    def normalize(self, text: Column) -> Column:
        return F.array_join(F.transform(words(text), self.normalize_word), " ")

    def encode_word(self, word: Column) -> Column:
        """array<int>; characters outside the vocabulary get the unknown id, or go if there is none."""
        unknown = self.ids.get(self.unknown) if self.unknown is not None else None
        found = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.try_element_at(self._map(), c))
        return F.filter(found, lambda i: i.isNotNull()) if unknown is None else F.transform(found, lambda i: F.coalesce(i, F.lit(unknown)))

    def encode(self, text: Column) -> Column:
        """array<array<int>>, one entry a word."""
        return F.transform(words(text), self.encode_word)

    def decode_word(self, ids: Column) -> Column:
        labels = F.array(*[F.lit(x) for x in self.labels])
        return F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(labels, i), F.lit(self.unknown or UNKNOWN))), "")

    def decode(self, ids: Column) -> Column:
        return F.transform(ids, self.decode_word)


def encode_flat(encoded: Column, pronunciations: bool = False) -> Column:
    """All ids of a text in order; of several pronunciations the first."""
    return F.flatten(F.transform(encoded, lambda w: F.get(w, F.lit(0))) if pronunciations else encoded)


def decode_labels(ids: Column, labels: list[str]) -> Column:
    """Ids as their labels; an unknown id raises."""
    held = F.array(*[F.lit(x) for x in labels])
    return F.transform(ids, lambda i: F.coalesce(F.get(held, i), F.raise_error(F.concat(F.lit("no label for id "), i.cast("string")))))


def group_subwords(pieces: Column, mark: str = "▁") -> Column:
    """Pieces grouped into words: a piece that begins with the mark opens the next word."""
    empty = F.array().cast("array<array<string>>")
    fresh = lambda acc, p: F.concat(acc, F.array(F.array(p)))
    longer = lambda acc, p: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.array(p))))
    return F.aggregate(pieces, empty, lambda acc, p: F.when((F.size(acc) == 0) | p.startswith(mark), fresh(acc, p)).otherwise(longer(acc, p)))


@lru_cache(maxsize=4)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass(frozen=True)
class SubwordTokenizer:
    """A sentencepiece model file. The model is loaded once a worker; texts go to it in Arrow batches."""

    path: str

    def normalize(self, text: Column) -> Column:
        bare = F.transform(words(text), lambda w: F.lower(F.regexp_replace(w, r"\p{Punct}", "")))
        return F.array_join(F.transform(bare, lambda w: F.when(w == "", F.lit(UNKNOWN)).otherwise(w)), " ")

    def encode_flat(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf("array<int>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(_model(path).encode([x or "" for x in s], num_threads=1))

        return run(text)

    def pieces(self, text: Column) -> Column:
        path = self.path

        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series(_model(path).encode([x or "" for x in s], out_type=str, num_threads=1))

        return run(text)

    def encode(self, text: Column) -> Column:
        """Ids grouped by word."""
        path = self.path

        @F.pandas_udf("array<array<int>>")
        def run(s: pd.Series) -> pd.Series:
            out = []
            for ids in _model(path).encode([x or "" for x in s], num_threads=1):
                groups: list[list[int]] = []
                for i in ids:
                    if not groups or _model(path).id_to_piece(i).startswith("▁"):
                        groups.append([])
                    groups[-1].append(i)
                out.append(groups)
            return pd.Series(out)

        return run(text)

    def decode(self, ids: Column) -> Column:
        path = self.path

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([_model(path).decode([int(i) for i in x]) for x in s])

        return run(ids)


@dataclass(frozen=True)
class PhonemeTokenizer:
    """Words to pronunciations by a lexicon table ``word, prons array<array<string>>``; others are spelled by ``fallback``."""

    labels: tuple[str, ...]
    unknown: str = UNKNOWN

    def normalize_word(self, word: Column) -> Column:
        kept = F.regexp_replace(F.lower(transliterate(word)), "[^a-z']", "")
        return F.when(kept == "", F.lit(self.unknown)).otherwise(kept)

    def pronounce(self, ws: DataFrame, lexicon: DataFrame, word: str = "word", most: int | None = None, fallback=None) -> DataFrame:
        """Adds ``prons``: distinct pronunciations in order, without stress digits, at most ``most``."""
        bare = F.array_distinct(F.transform("prons", lambda p: F.transform(p, lambda x: F.regexp_replace(x, r"\d", ""))))
        table = lexicon.select(F.col("word").alias("_word"), bare.alias("_prons"))
        spelled = fallback(F.col(word)) if fallback else F.array(F.array(F.lit(self.unknown)))
        out = ws.join(table, F.col(word) == F.col("_word"), "left").withColumn("prons", F.coalesce("_prons", spelled)).drop("_word", "_prons")
        return out if most is None else out.withColumn("prons", F.slice("prons", 1, most))

    def encode(self, prons: Column) -> Column:
        held = F.create_map(*[F.lit(x) for i, c in enumerate(self.labels) for x in (c, i)])
        unknown = self.labels.index(self.unknown) if self.unknown in self.labels else None
        return F.transform(prons, lambda p: F.filter(F.transform(p, lambda x: F.coalesce(F.try_element_at(held, x), F.lit(unknown).cast("int"))), lambda i: i.isNotNull()))

    def decode(self, ids: Column) -> Column:
        held = F.array(*[F.lit(x) for x in self.labels])
        return F.transform(ids, lambda p: F.transform(p, lambda i: F.get(held, i)))


def create_tokenizer(kind: str = "char", **options):
    """``char`` (labels), ``bpe`` (path) or ``phoneme`` (labels)."""
    kinds = {"char": CharTokenizer, "bpe": SubwordTokenizer, "phoneme": PhonemeTokenizer}
    if kind not in kinds:
        raise ValueError(f"no tokenizer {kind!r}; there are {sorted(kinds)}")
    return kinds[kind](**options)


def tokenizer_from_labels(labels: list[str], blank: str = "-", unknown: str | None = UNKNOWN) -> CharTokenizer:
    return CharTokenizer(tuple(labels), blank, unknown if unknown in labels else None)


def language_code(iso: str, scripts: dict[str, str] | None = None) -> str:
    """A three-letter language code with its script, Latin by default."""
    if re.search("_", iso):
        return iso
    return f"{iso}_{(scripts or {}).get(iso, 'Latn')}"
