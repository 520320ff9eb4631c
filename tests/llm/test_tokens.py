"""Token operators and URL rules, against the tokenizer itself and brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import textkit, token_binary, token_counts, tokens
from wordloom.llm.queries import tokenizer_path
from wordloom.llm.url_filter import filter_urls

pytest.importorskip("public_tokenizers")
import pyarrow as pa  # noqa: E402

TEXTS = ["", None, " a", "a  b", "é  x y", "x  y z", "<|endoftext|> a <|endoftext|>", "日本 語 text", "a\n b\t c", "'s it's  I'll", "\u0085 q \u0085q", "emoji 😀 😀x ", " ", "tail ", "à \u3000b ünï cödé", "a" * 5000, "x y " * 4000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab É\n\t\u00a0\u3000'1.😀<|>")), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    path = tokenizer_path()
    whole = tokens.load(path)[0]
    for column in (pa.array(texts, pa.string()), pa.array(TEXTS)):
        for first, ids, at, begin, end in tokens.encode(column, path, spans=True):
            for i in range(len(at) - 1):
                x = whole.encode(column[first + i].as_py() or "", add_special_tokens=False)
                assert x.ids == ids[at[i] : at[i + 1]].tolist()
                assert x.offsets == list(zip(begin[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist(), strict=True))


PARTS = ["he", "É", "à", "×", "÷", "ñ", "'s", "'", "''ll", "7", ".", "!!", "$#", "\n", "\n\n", " ", "\u00a0", "\u0085", "語", "<|endoftext|>", "<|endoftext", "|>", "e\u0301"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), max_size=4))
def test_fine_pieces_encode_like_whole_texts(texts):
    """Signs, line feeds and added tokens between letters, marks and blanks of all kinds."""
    whole = tokens.load(tokenizer_path())[0]
    for first, ids, at, *_ in tokens.encode(pa.array(texts, pa.string()), tokenizer_path()):
        for i in range(len(at) - 1):
            assert whole.encode(texts[first + i], add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist()


def test_words_are_encoded_without_their_signs(monkeypatch):
    """A word is encoded once, whatever sign or line follows it."""
    held = tokens.Pieces(tokens.load(tokenizer_path())[0])
    monkeypatch.setattr(tokens, "_held", lambda path: held)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    text = "".join(f" {w}{s}" for s in ("", ",", ".", "!!", ".\nAnd") for w in words)
    list(tokens.encode(pa.array([text]), tokenizer_path()))
    assert len(held.base) < 2 * len(words)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=400), st.integers(0, 400), st.integers(0, 400))
def test_grammar_round_trip(ids, a, b):
    ids = np.array(ids, np.uint32)
    base, rules, sizes, s = token_binary.compress(ids)
    assert (token_binary.expand(s, base, rules) == ids).all() and (token_binary.expand(s, base, rules, sizes) == ids).all()
    block = {"base": base, "rules": rules.tobytes(), "sizes": sizes.tobytes(), "sequence": s.tobytes()}
    low, high = sorted((min(a, len(ids)), min(b, len(ids))))
    if high > low:
        assert (token_binary.decode_range(block, low, high) == ids[low:high]).all()


def test_pieces_of_one_hash(monkeypatch):
    """Pieces of over eight bytes that share their hash are told apart by their bytes."""
    monkeypatch.setattr(tokens, "span_hash", lambda buf, a, z, fold=False: np.where(z - a > 8, np.uint64(7), textkit.span_hash(buf, a, z)))
    held = tokens.Pieces(tokens.load(tokenizer_path())[0])
    monkeypatch.setattr(tokens, "_held", lambda path: held)
    texts = ["one two threethreethree one threethreefour", "two threethreethree " + "x" * 200 + " " + "x" * 199 + "y", "four one"]
    for first, ids, at, *_ in tokens.encode(pa.array(texts), tokenizer_path()):
        for i, t in enumerate(texts[first:]):
            assert held.tokenizer.encode(t, add_special_tokens=False).ids == ids[at[i] : at[i + 1]].tolist()


def test_hashes_of_self_similar_words():
    """Thue-Morse words, on which polynomials modulo a power of two agree."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    one, other = a[:1024], a[1024:]
    text = np.frombuffer((one + other).encode(), np.uint8)
    h = textkit.span_hash(text, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    words = np.frombuffer((" ".join(one) + " " + " ".join(other)).encode(), np.uint8)
    starts, ends, _ = textkit.word_spans(words, np.array([0, len(words)]))
    data, place = textkit.joined_words(words, starts, ends)
    d = textkit.digests(data, place[[0, 1024]], place[[1024, 2048]])
    assert (d[0] != d[1]).any()


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    for ids in (np.tile(np.arange(7), 40_000), rng.zipf(1.3, 60_000) % 500, np.zeros(5000)):
        ids = ids.astype(np.uint32)
        base, rules, sizes, s = token_binary.compress(ids)
        assert (token_binary.expand(s, base, rules) == ids).all() and (token_binary.expand(s, base, rules, sizes) == ids).all()
        seen = {}
        last = None
        for i, pair in enumerate(zip(s[:-1].tolist(), s[1:].tolist(), strict=True)):
            if last == (i - 1, pair):
                last = None
                continue
            seen[pair] = seen.get(pair, 0) + 1
            last = (i, pair)
        assert not seen or max(seen.values()) < token_binary.LEAST_COUNT
    base, rules, sizes, s = token_binary.compress(np.tile(np.arange(7), 40_000).astype(np.uint32))
    assert len(s) < 64 and len(rules) < 100


def test_grammar_shrinks():
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.integers(0, 50_000, 200), np.tile(rng.integers(0, 50_000, 64), 400)]).astype(np.uint32)
    base, rules, sizes, s = token_binary.compress(ids)
    assert len(s) < len(ids) / 6 and sizes.max() >= 8


def test_token_file(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), " ".join(rng.choices(["alpha", "beta", "Gamma,", "été", "x9"], k=rng.randint(0, 300)))) for _ in range(120)] + list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("h", F.lit(1))
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 2000)
    got = {r.doc_id: r for r in token_binary.tokenise(df, tokenizer_path()).collect()}
    whole, at = tokens.load(tokenizer_path())[0], 0
    for k, t in sorted(rows):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_binary.tokenise(df.limit(0), tokenizer_path()).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.start) for r in token_binary.tokenise(twice, tokenizer_path()).collect()) == [("1", 0), ("1", 3), ("None", 6)]


def brute_counts(text, rule):
    text = text or ""
    bounds = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    n = [0] * len(bounds)
    enc = tokens.load(tokenizer_path())[0].encode(text, add_special_tokens=False)
    for a, z in enc.offsets:
        inside = [sum(1 for p in range(a, z) if b <= p < (bounds[i + 1] if i + 1 < len(bounds) else len(text))) for i, b in enumerate(bounds)]
        touched = [i for i, k in enumerate(inside) if k]
        n[{"start": touched[0], "end": touched[-1], "most": inside.index(max(inside))}[rule]] += 1
    return n, len(enc.ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_counts(spark, rule):
    texts = [*TEXTS, "a\n\n\nb", "\n", "x\n \n  y\n\n", "end.\n\nNext"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.lit("x")).withColumn("bounds", F.lit(1))
    got = {}
    for r in token_counts.count_tokens(df, tokenizer_path(), rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_tokens, r.doc_tokens)
    for k, t in enumerate(texts):
        n, total = brute_counts(t, rule)
        assert [got[k][i][0] for i in range(len(n))] == n and got[k][0][1] == total == sum(n)
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, tokenizer_path(), rule="half")


def test_counts_of_given_sections(spark):
    df = spark.createDataFrame([(1, "title body text", [0, 6]), (None, "ab", [0])], "doc_id long, text string, b array<long>")
    rows = sorted((str(r.doc_id), r.section, r.n_tokens) for r in token_counts.count_tokens(df, tokenizer_path(), F.col("b")).collect())
    # The blank before "body" belongs to its token, which begins in the first section.
    assert rows == [("1", 0, 2), ("1", 1, 1), ("None", 0, 1)]
    assert token_counts.count_tokens(df.limit(0), tokenizer_path()).count() == 0


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.b/x*/y/", "block"), ("c.d/pre", "block"), ("/only/", "block"), (None, "block")]


def brute_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, verdict in RULES:
        if rule is None:
            continue
        h, _, p = rule.partition("/")
        p = "/" + p
        fits = (not h or host == h or host.endswith("." + h)) and re.match("(?s)" + re.escape(p).replace(r"\*", ".*"), path)
        if fits and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_url_rules(spark):
    hosts = ["net", "x.net", "example.net", "b.Example.NET", "example.com", "q.org", "a.b", "z.a.b", "c.d", "ab", "notnet", ""]
    paths = ["", "/", "/en/", "/en", "/de/a", "/fr/1", "/x1/y/2", "/x/y", "/prefix", "/pre", "/only/1", "//", "/\n/"]
    urls = [f"{s}://{h}{p}{q}" for s in ("http", "") for h in hosts for p in paths for q in ("", "?a=/en/", "#x")] + [None, "", "nothing", "a://b://c.net/", "http://"]
    df = spark.createDataFrame(list(enumerate([*urls, urls[0]])), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, spark.createDataFrame(RULES, "rule string, verdict string")).collect()}
    for k, u in enumerate([*urls, urls[0]]):
        assert got[k] == brute_rule(u), u
    none = spark.createDataFrame([], "rule string, verdict string")
    assert filter_urls(df, none, "block").where("verdict = 'block' and rule is null").count() == len(urls) + 1 and filter_urls(df.limit(0), none).count() == 0
    plan = filter_urls(df, none)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_texts_have_the_library_s_spans_without_asking_for_them(monkeypatch):
    """Spans of whole texts follow from the ids' bytes: the encoding without offsets is enough, and equals the one with them."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé ß日本🙂👍🏽́‍\n\t  x1.,'\u0000ÿ") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "a <|endoftext|> b", "plain words, and more"]
    path = tokenizer_path()
    tokenizer, bytewise = tokens.load(path)
    assert bytewise

    class Fast:
        def __getattr__(self, name):
            assert name != "encode_batch"
            return getattr(tokenizer, name)

    monkeypatch.setattr(tokens, "load", lambda p: (Fast(), True))
    monkeypatch.setattr(tokens, "WHOLE_BYTES", 500)
    seen = 0
    for low, ids, at, begin, end in tokens.encode_whole(pa.array(texts, pa.string()), path):
        for i in range(len(at) - 1):
            want = tokenizer.encode(texts[low + i] or "", add_special_tokens=False)
            assert ids[at[i] : at[i + 1]].tolist() == want.ids
            assert list(zip(begin[at[i] : at[i + 1]].tolist(), end[at[i] : at[i + 1]].tolist(), strict=True)) == want.offsets
            seen += 1
    assert seen == len(texts)
