"""Scripts without blanks between words, and romanised text brought back to its word count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.helpers import let
from .text import UNKNOWN, WHITE, transliterate, words

#: Punctuation beyond ASCII that splitting drops: general, CJK and full-width marks.
MARKS = r"\p{P}\p{S}"


def split_characters(text: Column, extra: str = "") -> Column:
    """Code points separated by blanks, without white space, punctuation and the ``extra`` characters."""
    quoted = "".join("\\" + c if not c.isalnum() else c for c in extra)
    bare = F.regexp_replace(F.regexp_replace(text, WHITE, ""), f"[{MARKS}{quoted}]", "")
    return F.array_join(F.filter(F.split(bare, ""), lambda c: c != ""), " ")


def align_romanized(original: Column, romanized: Column, unknown: str = UNKNOWN) -> Column:
    """``romanized`` brought to the length of ``original``.

    More romanised words than originals: neighbours are joined by proportion. Fewer: they are spread
    by proportion and the gaps are ``unknown``. None: all are ``unknown``. Both arrays are worked out once.
    """
    return let(F.struct(original.alias("o"), romanized.alias("r")), lambda s: _aligned(s["o"], s["r"], unknown))


def _aligned(original: Column, romanized: Column, unknown: str) -> Column:
    n, m = F.size(original), F.size(romanized)
    ratio = m.cast("double") / n
    fused = F.transform(original, lambda w, i: let(
        F.struct(F.floor(i * ratio).cast("int").alias("a"), F.when(i == n - 1, m).otherwise(F.floor((i + 1) * ratio).cast("int")).alias("b")),
        lambda s: let(F.array_join(F.slice(romanized, s["a"] + 1, F.greatest(s["b"] - s["a"], F.lit(0))), ""), lambda x: F.when(x == "", F.lit(unknown)).otherwise(x)),
    ))
    spread = F.transform(original, lambda w, i: let(
        F.floor(i * ratio).cast("int"), lambda k: F.when((i == 0) | (F.floor((i - 1) * ratio).cast("int") != k), F.get(romanized, k)).otherwise(F.lit(unknown)),
    ))
    return F.when(n == 0, F.array().cast("array<string>")).when(m == 0, F.transform(original, lambda w: F.lit(unknown))).when(m == n, romanized).when(m > n, fused).otherwise(spread)


def romanize(text: Column, external=None) -> Column:
    """Latin letters of a text by an external romaniser (a function of columns), or by the built-in table for marked letters."""
    return external(text) if external is not None else transliterate(text)


def romanize_aligned(text: Column, external=None, unknown: str = UNKNOWN) -> Column:
    """Romanised words, as many as the text has."""
    return align_romanized(words(text), words(romanize(text, external)), unknown)


def romanize_words(ws: Column, external, unknown: str = UNKNOWN) -> Column:
    """Each word romanised by itself; empty results are ``unknown``."""
    return F.transform(ws, lambda w: let(F.replace(F.coalesce(external(w), F.lit("")), F.lit(" "), F.lit("")), lambda x: F.when(x == "", F.lit(unknown)).otherwise(x)))


ROMANIZERS = {"latin": True, "external": False}
