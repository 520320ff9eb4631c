"""Text normalisation that keeps the number of words: a word's index joins an alignment to its source."""

from __future__ import annotations

import string
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of white space as Python's str.split() sees them.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
UNKNOWN = "*"


def _diacritics() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter, by rule from the Unicode data."""
    pairs = [(chr(i), base) for i in range(0xC0, 0x250) if len(base := unicodedata.normalize("NFD", chr(i))[0]) == 1 and base.isascii() and base.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _diacritics()
#: Letters whose plain form has two letters.
_WIDE = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE"}


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def words(text: Column) -> Column:
    """The words of a text; an empty array for blank text."""
    return F.filter(F.split(collapse(text), " "), lambda w: w != "")


def normalize_basic(text: Column) -> Column:
    return collapse(F.lower(text))


def transliterate(text: Column) -> Column:
    """Latin letters with marks as plain letters; curly quotes, backtick and acute as an apostrophe."""
    for wide, plain in _WIDE.items():
        text = F.replace(text, F.lit(wide), F.lit(plain))
    return F.translate(text, _ACCENTED + "‘’`´", _PLAIN + "''''")


def normalize_mms_word(word: Column, unknown: str = UNKNOWN, translit: bool = True) -> Column:
    """Lower-case letters and apostrophes only; ``unknown`` if nothing is left."""
    plain = transliterate(word) if translit else F.translate(word, "‘’`´", "''''")
    kept = F.regexp_replace(F.lower(plain), "[^a-z']", "")
    return F.when(kept == "", F.lit(unknown)).otherwise(kept)


def normalize_mms_words(ws: Column, unknown: str = UNKNOWN, translit: bool = True) -> Column:
    return F.transform(ws, lambda w: normalize_mms_word(w, unknown, translit))


def normalize_mms(text: Column, unknown: str = UNKNOWN, expand: bool = False, joiner: str | None = "", translit: bool = True) -> Column:
    """Each word normalised, joined by blanks; the number of words stays unless ``expand`` has no joiner."""
    from .numbers import expand_numbers

    ws = words(text)
    if expand:
        ws = expand_numbers(ws, joiner)
        if joiner is None:
            ws = words(F.array_join(ws, " "))
    return F.array_join(normalize_mms_words(ws, unknown, translit), " ")


def word_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, idx, original, normalized``: one row a word, with its stable index."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(words(F.col(text))).alias("idx", "original")).withColumn("normalized", normalize_mms_word(F.col("original")))


def recover_original(ws: Column, indices: Column) -> Column:
    """Words at the given indices; indices past the end are dropped, negative ones count from the end."""
    kept = F.filter(indices, lambda i: i < F.size(ws))
    return F.transform(kept, lambda i: F.try_element_at(ws, F.when(i < 0, i).otherwise(i + 1)))


def strip_punctuation(word: Column, but: str = "") -> Column:
    """Without ASCII punctuation at the ends, except the characters in ``but``."""
    marks = "".join(c for c in string.punctuation if c not in but)
    quoted = "".join("\\" + c for c in marks)
    return F.regexp_replace(word, f"^[{quoted}]+|[{quoted}]+$", "")


def source_kind(source: Column, override: Column | None = None) -> Column:
    """``url``, ``pdf`` or ``file`` by scheme and suffix, unless ``override`` names the kind."""
    kind = F.when(source.rlike("^https?://"), "url").when(F.lower(source).endswith(".pdf"), "pdf").otherwise("file")
    return kind if override is None else F.coalesce(F.when(override != "auto", override), kind)


def keep_extracted(text: Column) -> Column:
    """Text extraction from a scanned document is good enough: over 100 characters and 20 words."""
    return (F.length(F.trim(text)) > 100) & (F.size(words(text)) > 20)


def html_text(html: Column) -> Column:
    """Visible text of a page as one string: tags and comments out, entities decoded, line ends as \\n. Scripts and styles stay."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>", "")
    text = F.regexp_replace(text, r"(?s)</?[a-zA-Z][^>]*>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


NORMALIZERS = {"spelled": True, "basic": True, "external": False}


def apply_normalization(text: Column, external: Column | None = None, joiner: str | None = "") -> Column:
    """The first available of an external normaliser's column, the built-in number speller, and the text itself."""
    from .numbers import expand_numbers

    spelled = F.array_join(expand_numbers(words(text), joiner), " ")
    return F.coalesce(external, spelled, text) if external is not None else F.coalesce(spelled, text)
