import pytest
from pyspark.sql import functions as F

from wordloom.functions import numbers, scripts, text
from wordloom.functions.tokenizers import CharTokenizer, PhonemeTokenizer, create_tokenizer, decode_labels, group_subwords, language_code


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("digits,word", [
    ("0", "zero"), ("7", "seven"), ("21", "twenty-one"), ("100", "one hundred"), ("105", "one hundred and five"), ("1000", "one thousand"), ("1005", "one thousand and five"),
    ("1234", "one thousand, two hundred and thirty-four"), ("1000000", "one million"), ("2000100", "two million, one hundred"), ("007", "seven"), ("1" + "0" * 36, None),
])
def test_cardinals(spark, digits, word):
    assert one(spark, digits, numbers.cardinal) == word


@pytest.mark.parametrize("word,spelled", [
    ("$66", "sixtysixdollars"), ("$66.", "sixtysix"), ("$7.50", "sevendollarsfiftycents"), ("$1", "onedollar"), ("€100", "onehundredeuros"), ("50%", "fiftypercent"), ("3.14", "threepointonefour"), ("2.0.", "twopointzero"),
    ("1st", "first"), ("2nd", "second"), ("3rd", "third"), ("21st", "twentyfirst"), ("20th", "twentieth"), ("12th", "twelfth"), ("1,000", "onethousand"), ("COVID19", "covidnineteen"), ("MP3", "mpthree"), ("4K", "fourk"), ("+1", "one"),
    ("(521)", "fivehundredandtwentyone"), ("to%%%", "to%%%"), ("152.143.123.131", "152.143.123.131"), ("plain", "plain"), ("...", "..."), ("", ""),
])
def test_numbers_in_words(spark, word, spelled):
    assert one(spark, word, numbers.expand_number) == spelled


def test_amounts_with_a_scale_word(spark):
    ws = ["It", "cost", "$3", "billion.", "or", "€5.2", "million", "$4"]
    assert one(spark, ws, numbers.expand_numbers, "array<string>") == ["It", "cost", "three", "billiondollars", "or", "fivepointtwo", "millioneuros", "fourdollars"]
    assert one(spark, "66", lambda c: numbers.expand_number(c, None)) == "sixty-six"


@pytest.mark.parametrize("source", ["Hello, World! This is Q1 2025. Numbers: 123 and symbols.", "  a\tb\n c ", "", "   ", "😀 x", None])
def test_word_count_stays(spark, source):
    row = spark.createDataFrame([(source,)], "x string").select(F.size(text.words(F.col("x"))).alias("n"), text.normalize_mms(F.col("x")).alias("m")).first()
    assert (row.m is None) if source is None else len(row.m.split()) == row.n


def test_normalised_words(spark):
    for source, want in (("Meta's", "meta's"), ("Meta`s", "meta's"), ("Meta´s", "meta's"), ("Meta’s", "meta's"), ("😀", "*"), ("hello!", "hello"), ("Größe", "grosse"), ("ÉTÉ", "ete")):
        assert one(spark, source, text.normalize_mms_word) == want
    assert one(spark, "  A  B\n", text.normalize_basic) == "a b"


def test_recover_original(spark):
    ws = "Hello, World! This is Q1".split()
    got = spark.createDataFrame([(ws, [0, 1, 3, 4, 9])], "w array<string>, i array<int>").select(text.recover_original(F.col("w"), F.col("i")).alias("y")).first().y
    assert got == ["Hello,", "World!", "is", "Q1"]


def test_scripts(spark):
    for source, n in (("子曰學而時習之", 7), ("風立ちぬ", 4), ("세계 인권", 4), ("", 0), ("。、", 0)):
        assert len(one(spark, source, scripts.split_characters).split()) == n
    for a, b, want in ((["東京"], ["tou", "kyou"], ["toukyou"]), (["hello", "world"], [], ["*", "*"]), (["a", "b", "c"], ["ab"], ["ab", "*", "*"]), ([], ["x"], []), (["p", "q"], ["x", "y"], ["x", "y"])):
        got = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(scripts.align_romanized(F.col("a"), F.col("b")).alias("y")).first().y
        assert got == want


def test_char_tokenizer(spark):
    t = CharTokenizer(("-", *"abcdefghijklmnopqrstuvwxyz'", "*"))
    assert len(t.labels) == 29
    assert one(spark, "hi", t.encode) == [[8, 9]]
    assert one(spark, "h#", t.encode_word) == [8, 28]
    assert one(spark, [[8, 9], [99]], t.decode, "array<array<int>>") == ["hi", "*"]
    assert one(spark, "Hé! ??", t.normalize) == "he *"
    assert one(spark, ["a", "▁b", "c", "▁d"], group_subwords, "array<string>") == [["a"], ["▁b", "c"], ["▁d"]]
    with pytest.raises(Exception, match="no label"):
        one(spark, [1, 7], lambda c: decode_labels(c, ["a", "b"]), "array<int>")
    with pytest.raises(ValueError):
        create_tokenizer("none")
    assert language_code("eng") == "eng_Latn" and language_code("hin", {"hin": "Deva"}) == "hin_Deva"


def test_phonemes(spark):
    t = PhonemeTokenizer(("-", "T", "UW", "*"))
    lexicon = spark.createDataFrame([("two", [["T", "UW1"], ["T", "UW2"]])], "word string, prons array<array<string>>")
    ws = spark.createDataFrame([("two",), ("zz",)], "word string")
    rows = {r.word: r.ids for r in t.pronounce(ws, lexicon).select("word", t.encode(F.col("prons")).alias("ids")).collect()}
    assert rows == {"two": [[1, 2]], "zz": [[3]]}


def test_sources_and_pages(spark):
    kinds = [one(spark, s, text.source_kind) for s in ("https://a/b.pdf", "a.PDF", "a.txt")]
    assert kinds == ["url", "pdf", "file"]
    assert one(spark, "<p>a &amp; b</p>\r\n<!-- x --><b>c</b>", text.html_text) == "a & b\nc"
