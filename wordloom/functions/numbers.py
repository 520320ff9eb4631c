"""English number words, and the cascade that recognises numbers in words. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.helpers import let
from .text import strip_punctuation

#: English number words.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = "decillion nonillion octillion septillion sextillion quintillion quadrillion trillion billion million thousand".split()
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
#: Symbol, singular, plural, hundredth, hundredths.
CURRENCIES = [("$", "dollar", "dollars", "cent", "cents"), ("€", "euro", "euros", "cent", "cents"), ("£", "pound", "pounds", "pence", "pence"), ("¥", "yen", "yen", "sen", "sen"), ("₹", "rupee", "rupees", "paisa", "paise")]
SCALE_WORDS = ["hundred", "thousand", "million", "billion", "trillion", "quadrillion"]
_WIDTH = 3 * (len(SCALES) + 1)


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _below_hundred(n: Column) -> Column:
    tens, unit = F.get(_words(TENS), F.floor(n / 10).cast("int")), F.get(_words(UNITS), n % 10)
    return F.when(n < 20, F.get(_words(UNITS), n)).when(n % 10 == 0, tens).otherwise(F.concat(tens, F.lit("-"), unit))


def _below_thousand(n: Column) -> Column:
    hundreds = F.concat(F.get(_words(UNITS), F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return F.when(n < 100, _below_hundred(n)).when(n % 100 == 0, hundreds).otherwise(F.concat(hundreds, F.lit(" and "), _below_hundred(n % 100)))


def cardinal(digits: Column) -> Column:
    """The number word of a string of digits; null above 36 digits."""
    bare = F.regexp_replace(digits, "^0+", "")
    groups = lambda p: F.transform(F.sequence(F.lit(0), F.lit(len(SCALES))), lambda i: p.substr(i * 3 + 1, F.lit(3)).cast("int"))

    def spelled(g: Column) -> Column:
        high = F.filter(F.transform(F.slice(g, 1, len(SCALES)), lambda n, i: F.when(n > 0, F.concat(_below_thousand(n), F.lit(" "), F.get(_words(SCALES), i)))), lambda x: x.isNotNull())
        low = F.element_at(g, -1)
        return let(F.array_join(high, ", "), lambda h: F.when(h == "", _below_thousand(low)).when(low == 0, h).otherwise(F.concat(h, F.when(low < 100, " and ").otherwise(", "), _below_thousand(low))))

    return F.when(bare == "", F.lit("zero")).when(F.length(bare) <= _WIDTH, let(F.lpad(bare, _WIDTH, "0"), lambda p: let(groups(p), spelled)))


def _point(head: Column, fraction: Column) -> Column:
    """A spelled whole part and the digits behind its point; zeros at the end count once."""
    kept = F.regexp_replace(fraction, "0+$", "")
    digits = F.transform(F.filter(F.split(F.when(kept == "", F.lit("0")).otherwise(kept), ""), lambda c: c != ""), lambda c: F.get(_words(UNITS), c.cast("int")))
    return F.concat(head, F.lit(" point "), F.array_join(digits, " "))


def decimal(text: Column) -> Column:
    """A decimal such as 3.14, as "three point one four"."""
    return _point(cardinal(F.substring_index(text, ".", 1)), F.substring_index(text, ".", -1))


def _ordinal(c: Column) -> Column:
    last = F.regexp_extract(c, "([a-z]+)$", 1)
    head = F.regexp_replace(c, "[a-z]+$", "")
    irregular = F.try_element_at(F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in pair]), last)
    return F.concat(head, F.coalesce(irregular, F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))), F.concat(last, F.lit("th"))))


def ordinal(digits: Column) -> Column:
    return let(cardinal(digits), _ordinal)


def _currency(word: Column) -> Column:
    """Singular, plural, hundredth and hundredths of the currency whose symbol begins the word, else null."""
    names = F.create_map(*[x for symbol, *own in CURRENCIES for x in (F.lit(symbol), _words(own))])
    return F.try_element_at(names, word.substr(F.lit(1), F.lit(1)))


def _behind_symbol(word: Column) -> Column:
    return word.substr(F.lit(2), F.length(word))


def number_class(word: Column) -> Column:
    """The branch of the cascade that spells a word: currency, percent, integer, decimal, ordinal, grouped, mixed, or none."""
    bare = strip_punctuation(word)
    part = strip_punctuation(_behind_symbol(word), ".")
    money = _currency(word).isNotNull() & (part.rlike(r"^\d+\.\d+$") | F.replace(part, F.lit(","), F.lit("")).rlike(r"^\d+$"))
    share = strip_punctuation(word.substr(F.lit(1), F.length(word) - 1), ".")
    return (
        F.when(bare == "", "none").when(money, "currency").when(word.endswith("%") & share.rlike(r"^\d+(\.\d+)?$"), "percent")
        .when(bare.rlike("^[0-9]+$"), "integer").when(bare.rlike(r"^\d+\.\d+$"), "decimal").when(bare.rlike("(?i)^[0-9]+(st|nd|rd|th)$"), "ordinal")
        .when(bare.rlike("^[0-9,]+$") & bare.contains(","), "grouped").when(word.rlike("[0-9]") & word.rlike("[a-zA-Z]"), "mixed").otherwise("none")
    )


def _number(word: Column, kind: Column) -> Column:
    """The digits, with or without a point, that the word's class spells."""
    bare = strip_punctuation(word)
    part = strip_punctuation(_behind_symbol(word), ".")
    return (
        F.when(kind == "currency", F.replace(part, F.lit(","), F.lit(""))).when(kind == "percent", strip_punctuation(word.substr(F.lit(1), F.length(word) - 1), "."))
        .when(kind == "ordinal", F.regexp_extract(bare, "^([0-9]+)", 1)).when(kind == "grouped", F.replace(bare, F.lit(","), F.lit(""))).when(kind.isin("integer", "decimal"), bare)
    )


def _joined(value: Column, joiner: str | None) -> Column:
    return value if joiner is None else F.replace(F.replace(value, F.lit(" "), F.lit(joiner)), F.lit("-"), F.lit(joiner))


def expand_number(word: Column, joiner: str | None = "") -> Column:
    """A word with its number spelled out, or the word itself. ``joiner`` takes the place of blanks and hyphens; None keeps them.

    The speller stands in the expression three times only: for the whole part, for hundredths, and for the
    pieces of a mixed word.
    """

    def spelled(p: Column) -> Column:
        word, kind, head, whole = p["word"], p["kind"], p["head"], F.substring_index(p["number"], ".", 1)
        fraction = F.when(p["number"].contains("."), F.substring_index(p["number"], ".", -1))
        rest, names = F.rpad(fraction, 2, "0"), _currency(word)
        amount = F.concat(head, F.lit(" "), F.get(names, F.when(F.regexp_replace(whole, "^0+", "") == "1", 0).otherwise(1)))
        hundredths = F.concat(F.lit(" "), cardinal(rest), F.lit(" "), F.get(names, F.when(rest == "01", 2).otherwise(3)))
        pieces = F.transform(F.regexp_extract_all(word, F.lit("[a-zA-Z]+|[0-9]+"), F.lit(0)), lambda s: F.when(s.rlike("^[0-9]+$"), cardinal(s)).otherwise(F.lower(s)))
        plain = F.when(fraction.isNull(), head).otherwise(_point(head, fraction))
        return (
            F.when(kind == "currency", F.when(fraction.isNull() | (rest == "00"), amount).otherwise(F.concat(amount, hundredths)))
            .when(kind == "percent", F.concat(plain, F.lit(" percent"))).when(kind.isin("integer", "decimal", "grouped"), plain).when(kind == "ordinal", _ordinal(head))
            .when(kind == "mixed", F.when(~F.exists(pieces, lambda x: x.isNull()), F.array_join(pieces, " ")))
        )

    def found(p: Column) -> Column:
        return let(F.struct(p["word"].alias("word"), p["kind"].alias("kind"), _number(p["word"], p["kind"]).alias("number")), lambda q: let(
            F.struct(q["word"].alias("word"), q["kind"].alias("kind"), q["number"].alias("number"), cardinal(F.substring_index(q["number"], ".", 1)).alias("head")), spelled))

    value = let(F.struct(word.alias("word"), number_class(word).alias("kind")), found)
    return F.when(word.rlike("[0-9]"), F.coalesce(_joined(value, joiner), word)).otherwise(word)


def _scaled(word: Column, following: Column) -> Column:
    """Of a currency amount before a scale word: struct of its number and the unit, else null."""
    scale = F.regexp_replace(F.lower(following), "[\\p{Punct}]+$", "")
    part = _behind_symbol(word)
    number = F.when(part.rlike(r"^\d+\.\d+$"), part).when(F.replace(part, F.lit(","), F.lit("")).rlike(r"^\d+$"), F.replace(part, F.lit(","), F.lit("")))
    fits = F.length(F.regexp_replace(F.substring_index(number, ".", 1), "^0+", "")) <= _WIDTH
    names = _currency(word)
    return F.when(names.isNotNull() & scale.isin(SCALE_WORDS) & fits, F.struct(number.alias("number"), F.concat(scale, F.get(names, F.lit(1))).alias("unit")))


def scale_amount(word: Column, following: Column, joiner: str | None = "") -> Column:
    """Of a currency amount before a scale word, such as "$3 billion": struct of the two new words, else null."""
    spell = lambda s: F.when(s.isNotNull(), F.struct(_joined(F.when(s["number"].contains("."), decimal(s["number"])).otherwise(cardinal(s["number"])), joiner).alias("amount"), s["unit"].alias("unit")))
    return let(_scaled(word, following), spell)


def expand_numbers(ws: Column, joiner: str | None = "") -> Column:
    """All words of an array spelled out; the array keeps its length. A scale word can't begin an amount, so neighbours decide alone.

    Only words with a digit, and words behind a currency amount, are looked at closely.
    """

    def all_of(a: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            before = F.get(a, i - 1)
            after = F.when(_currency(before).isNotNull(), _scaled(before, w)["unit"])
            return F.when(w.rlike("[0-9]"), F.coalesce(scale_amount(w, F.get(a, i + 1), joiner)["amount"], expand_number(w, joiner))).otherwise(F.coalesce(after, w))

        return F.transform(a, one)

    return let(ws, all_of)
