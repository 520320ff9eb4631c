"""The registered queries of this subpackage and their SQL. Each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path() -> str:
    """The public byte-level BPE file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify
    from .shared import held_out

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(found.doc_id).alias("held_out"), "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


#: A stated set of URL rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    return score(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import tokenise

    return tokenise(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passage_dedup import dedup_passages

    return dedup_passages(_table(spark, sf_dir, "documents"), min_words=1)


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_ngram_join": op6_ngram_join,
    "op7_toxicity": op7_toxicity,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_token_binary": op9_token_binary,
    "op10_substring_dedup": op10_substring_dedup,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_WORDS = "'[^\\x20\\x09-\\x0D]+'"
_TOKENS = "'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+'"
_TAIL = "'[\\x20\\x09-\\x0D]*$'"

SQL = {
    "op1_url_filters": f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule, verdict, h, p) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/'))
SELECT page_id, host, path, rule, verdict FROM (
  SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.verdict, 'allow') AS verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) WHERE k = 1
""",
    "op10_substring_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
s AS (
  SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
    regexp_extract_all(translate(line, {_AZ}), {_WORDS}) AS w FROM l),
u AS (SELECT doc_id, n, row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, n) > 1 AS later FROM s WHERE len(w) > 0),
t AS (
  SELECT doc_id, n, a, unnest(regexp_extract_all(line, {_TOKENS})) AS t, generate_subscripts(regexp_extract_all(line, {_TOKENS}), 1) AS k FROM s),
w AS (
  SELECT *, row_number() OVER d - 1 AS p, regexp_extract(t, {_WORDS}) AS word,
    a + CAST(sum(length(t)) OVER (PARTITION BY doc_id, n ORDER BY k) AS BIGINT) AS z FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY n, k)),
v AS (
  SELECT doc_id, p, string_agg(translate(word, {_AZ}), ' ') OVER d AS x, count(*) OVER d AS c FROM w
  WINDOW d AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT doc_id, p, first_value(doc_id) OVER d AS fd, first_value(p) OVER d AS fp FROM v WHERE c = 50 WINDOW d AS (PARTITION BY x ORDER BY doc_id, p)),
g AS (SELECT doc_id, p FROM f WHERE (doc_id, p) <> (fd, fp) AND NOT (doc_id = fd AND p < fp + 50)),
m AS (
  SELECT w.*, later, max(g.p IS NOT NULL) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS inside
  FROM w JOIN u USING (doc_id, n) LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p),
o AS (
  SELECT *, later OR inside AS gone, lag(later OR inside, 1, false) OVER (PARTITION BY doc_id, n ORDER BY k) AS before,
    lag(inside, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS inside_before FROM m),
r AS (SELECT *, sum(CASE WHEN gone AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, n ORDER BY k) AS run FROM o),
e AS (
  SELECT doc_id, n, bool_and(gone) AS whole, count(DISTINCT CASE WHEN gone THEN run END) AS runs, sum(CASE WHEN inside AND NOT inside_before THEN 1 ELSE 0 END) AS passages,
    string_agg(CASE WHEN gone AND before THEN '' WHEN gone THEN left(t, length(t) - length(word)) ELSE t END, '' ORDER BY k) AS rest FROM r GROUP BY doc_id, n),
y AS (
  SELECT doc_id, n, run, min(z - length(word)) AS b, max(z) AS z FROM r WHERE gone GROUP BY doc_id, n, run),
x AS (
  SELECT y.doc_id, string_agg((CASE WHEN whole THEN s.a ELSE b END) || '-' || (CASE WHEN whole THEN s.a + length(line) ELSE z END), ',' ORDER BY b) AS removed
  FROM y JOIN e USING (doc_id, n) JOIN s USING (doc_id, n) GROUP BY y.doc_id),
q AS (
  SELECT s.doc_id, string_agg(CASE WHEN e.n IS NULL THEN line WHEN NOT whole THEN rest || regexp_extract(line, {_TAIL}) END, chr(10) ORDER BY s.n) AS text, count(*) AS n_lines,
    CAST(coalesce(sum(runs), 0) AS BIGINT) AS n_removed, CAST(coalesce(sum(passages), 0) AS BIGINT) AS n_passages FROM s LEFT JOIN e USING (doc_id, n) GROUP BY s.doc_id)
SELECT doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(q.text, '') END AS text, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_removed, 0) AS n_removed, coalesce(n_passages, 0) AS n_passages, coalesce(removed, '') AS removed
FROM documents LEFT JOIN q USING (doc_id) LEFT JOIN x USING (doc_id)
""",
    "op6_ngram_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
