"""The registered queries in SQL, for DuckDB, over the same tables. Queries that SQL has no words for have none."""

from __future__ import annotations

_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"
_TRIM = f"trim(regexp_replace(text, '{_WHITE}', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_TRIM}, ' '), lambda w: w <> '')"


def _mms(word: str) -> str:
    plain = f"strip_accents(translate(replace({word}, 'ß', 'ss'), '‘’`´', ''''''''''))"
    return f"coalesce(nullif(regexp_replace(lower({plain}), '[^a-z'']', '', 'g'), ''), '*')"


_MMS_LIST = f"list_transform({_WORDS}, lambda w: {_mms('w')})"

_EVENTS = """
ew AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS index, event_type AS word,
  CAST(floor(epoch_us(ts) / 1e9) AS BIGINT) AS start_frame, value AS score, CASE WHEN event_id % 3 = 0 THEN upper(event_type) END AS original FROM events),
eg AS (SELECT *, lead(start_frame) OVER (PARTITION BY recording_id ORDER BY index) - start_frame AS gap FROM ew),
er AS (SELECT *, coalesce(avg(CASE WHEN gap > 0 AND gap <= 50 AND length(word) > 0 THEN gap / length(word) END) OVER (PARTITION BY recording_id), 2.5) AS rate FROM eg),
tw AS (SELECT recording_id, index, word, start_frame, score, original, start_frame + CASE WHEN gap <= 50 THEN gap
  ELSE greatest(5, least(CAST(trunc(length(word) * rate) AS BIGINT), 50)) END AS end_frame FROM er)"""

_SMALL = """, sw AS (SELECT *, (start_frame % 300000) AS a, (end_frame % 300000) AS z, row_number() OVER (PARTITION BY recording_id ORDER BY index) - 1 AS k FROM tw)"""


def _tokens(modulo: str = " % 128") -> str:
    return f"""
it AS (SELECT l_suppkey AS recording_id, l_orderkey AS segment_index, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
  l_partkey AS token_id, CAST(l_orderkey % 50 * 10 + l_linenumber AS BIGINT) AS frame, CASE WHEN l_linenumber % 4 <> 0 THEN l_partkey{modulo} END AS wid FROM lineitem)"""


_INTERVALS = """
oi AS (SELECT o_custkey AS recording_id, CAST(floor(epoch_us(o_orderdate) / 86400000000) % 2500 AS DOUBLE) AS s,
  CAST(floor(epoch_us(o_orderdate) / 86400000000) % 2500 + 1 + o_orderkey % 60 AS DOUBLE) AS e FROM orders),
om AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM oi),
orun AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM om),
mi AS (SELECT recording_id, min(s) AS s, max(e) AS e FROM orun GROUP BY recording_id, run),
ot AS (SELECT o_custkey AS recording_id, o_orderkey, CAST(o_orderkey % 2500 AS DOUBLE) AS t FROM orders),
tm AS (SELECT recording_id, sum(s - before) OVER (PARTITION BY recording_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS new_time, e AS original FROM (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY recording_id ORDER BY s), 0) AS before FROM mi)),
mc AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY recording_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM mi),
tn AS (SELECT ot.*, CASE WHEN mc.s IS NULL THEN t ELSE t - cut - (least(t, e) - s) END AS new_time, mc.e AS cut_end FROM ot ASOF LEFT JOIN mc ON ot.recording_id = mc.recording_id AND ot.t >= mc.s)"""

_PUNCT = r"'^[[:punct:]]+|[[:punct:]]+$'"
_PUNCT_DOT = r"'^[!-\-/:-@\[-`{-~]+|[!-\-/:-@\[-`{-~]+$'"

_NUMBER_CLASS = f"""CASE WHEN bare = '' THEN 'none'
  WHEN substr(word, 1, 1) IN ('$', '€', '£', '¥', '₹') AND (regexp_full_match(money, '[0-9]+\\.[0-9]+') OR regexp_full_match(replace(money, ',', ''), '[0-9]+')) THEN 'currency'
  WHEN word LIKE '%\\%' ESCAPE '\\' AND regexp_full_match(share, '[0-9]+(\\.[0-9]+)?') THEN 'percent'
  WHEN regexp_full_match(bare, '[0-9]+') THEN 'integer' WHEN regexp_full_match(bare, '[0-9]+\\.[0-9]+') THEN 'decimal'
  WHEN regexp_full_match(lower(bare), '[0-9]+(st|nd|rd|th)') THEN 'ordinal' WHEN regexp_full_match(bare, '[0-9,]+') AND contains(bare, ',') THEN 'grouped'
  WHEN regexp_matches(word, '[0-9]') AND regexp_matches(word, '[a-zA-Z]') THEN 'mixed' ELSE 'none' END"""


def _clock(t: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', CAST(floor({t} / 3600) AS BIGINT), CAST(floor(floor({t}) % 3600 / 60) AS BIGINT), CAST(floor({t}) % 60 AS BIGINT), CAST(trunc(({t} % 1) * 1000) AS BIGINT))"


def _centi(t: str) -> str:
    return f"printf('%d:%02d:%05.2f', CAST(floor({t} / 3600) AS BIGINT), CAST(floor(floor({t}) % 3600 / 60) AS BIGINT), {t} % 60)"


_HTML = "html"
for _p in (r"(?s)<!--.*?-->|<![^>]*>|<\?[^>]*>", r"(?s)</?[a-zA-Z][^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_HTML = f"replace(replace({_HTML}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"

_VF = "vf AS (SELECT label, vec_id AS frame, embedding[1:4] AS logp, embedding FROM embeddings), vk AS (SELECT *, list_position(logp, list_max(logp)) - 1 AS k FROM vf), vl AS (SELECT *, lag(k) OVER (PARTITION BY label ORDER BY frame) AS b FROM vk), vg AS (SELECT label, frame, k, row_number() OVER (PARTITION BY label ORDER BY frame) - 1 AS pos FROM vl WHERE (b IS NULL OR b <> k) AND k <> 0)"

_ALPHABET = "-abcdefghijklmnopqrstuvwxyz''*"
_BT = f"""
bw AS (SELECT item_id AS doc_id, generate_subscripts(w, 1) - 1 AS wid, unnest(w) AS word FROM (SELECT item_id, {_MMS_LIST} AS w FROM benchmark)),
bc AS (SELECT doc_id, wid, unnest(range(1, length(word) + 1)) AS p, word FROM bw),
bt AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY wid, p) - 1 AS BIGINT) AS c, wid, CAST(strpos('{_ALPHABET}', substr(word, p, 1)) - 1 AS BIGINT) AS id, p = 1 AS f, p = length(word) AS l, count(*) OVER (PARTITION BY doc_id) AS n FROM bc),
bx AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY c) AS before, lag(wid) OVER (PARTITION BY doc_id ORDER BY c) AS before_word, max(wid) OVER (PARTITION BY doc_id) AS last_word FROM bt)"""


def _arcs(rows: list[tuple[str, str, str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {s} AS src, {d} AS dst, {lab} AS label, {aux} AS aux, CAST({score} AS DOUBLE) AS score FROM bx WHERE {when}" for when, s, d, lab, aux, score in rows)


_H, _B = "2 * c + 1", "2 * c + 2"
_FACTOR = [
    ("c > 0 AND id <> before", "2 * c - 1", _H, "id", "c + 1", "0"), ("c > 0", "2 * c", _H, "id", "c + 1", "0"), ("true", _H, _H, "id", "0", "0"), ("true", _H, _B, "0", "0", "0"), ("true", _B, _B, "0", "0", "0"),
    ("f", "0", _H, "id", "c + 1", "0"), ("l AND c < n - 1", _H, "2 * n + 1", "0", "c + 2", "0"), ("l AND c < n - 1", _H, "2 * n + 1", "id", "c + 2", "0"), ("c = n - 1", _B, "2 * n + 1", "0", "n + 1", "0"),
    ("c = 0", "0", "0", "0", "0", "0"), ("c = 0", "2 * n + 1", "2 * n + 1", "0", "0", "0"), ("c = 0", "2 * n + 1", "2 * n + 2", "-1", "-1", "0"), ("l", _H, "0", "0", "2 * n + 2", "-18"),
    ("before_word = wid AND NOT (wid = last_word AND c = n - 1)", "2 * c", _B, "0", "2 * n + 1", "-0.5"),
]
_CTC = [
    ("c = 0", "0", "0", "0", "0", "0"), ("c = 0", "0", _H, "id", "c + 1", "0"), ("c > 0 AND id <> before", "2 * c - 1", _H, "id", "c + 1", "0"), ("c > 0", "2 * c", _H, "id", "c + 1", "0"),
    ("true", _H, _H, "id", "0", "0"), ("true", _H, _B, "0", "0", "0"), ("true", _B, _B, "0", "0", "0"), ("c = n - 1", _H, "2 * n + 1", "-1", "-1", "0"), ("c = n - 1", _B, "2 * n + 1", "-1", "-1", "0"),
]

_HOLES = """
hn AS (SELECT recording_id, v, lead(v) OVER (PARTITION BY recording_id ORDER BY v) AS x FROM ids),
ho AS (SELECT recording_id, v + 1 AS s, x - 1 AS e FROM hn WHERE x - v > 1)"""


def _merged(rows: str, threshold: int) -> str:
    return f"""hm AS (SELECT *, max(e) OVER (PARTITION BY recording_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {rows}),
hr AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM hm)
SELECT recording_id, min(s) AS start_idx, max(e) AS end_idx FROM hr GROUP BY recording_id, run"""


_TURNS = f"""
tt AS (SELECT conv_id AS recording_id, string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'user') AS ua, string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'assistant') AS ub
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
tp AS (SELECT recording_id, {_WORDS.replace('text', "coalesce(ua, '')")} AS a, {_WORDS.replace('text', "coalesce(ub, '')")} AS b FROM tt)"""

_FLIPPED = "fl AS (SELECT recording_id, e AS a, coalesce(lead(s) OVER (PARTITION BY recording_id ORDER BY s), 2600.0) AS z FROM mi UNION ALL SELECT recording_id, 0.0, min(s) FROM mi GROUP BY recording_id)"
_CODES = "list_transform(embedding[1:12], lambda v: CAST(((CAST(floor(CAST(v AS FLOAT) * 100) AS BIGINT) % 4) + 4) % 4 AS INTEGER))"


def _decoded(offset: int) -> str:
    return f"array_to_string(list_transform(ids, lambda i: coalesce(['a', '|', '▁', 'b'][i + 1 - {offset}], '')), '')"


def _blanked(decoded: str, mark: str) -> str:
    return f"trim(regexp_replace(replace({decoded}, '{mark}', ' '), ' +', ' ', 'g'))"


SQL = {
    "pad_samples": "SELECT vec_id, 64 AS n, CASE WHEN vec_id % 60 + 1 >= 64 THEN CAST(embedding[64] AS DOUBLE) ELSE 0.0::DOUBLE END AS last, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings",
    "mono_channels": "SELECT vec_id, i, round((CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[i + 33] AS DOUBLE)) / 2, 6) AS v FROM embeddings, range(0, 32) t(i)",
    "resample_samples": "SELECT vec_id, 8000 AS rate, 32 AS n FROM embeddings",
    "frame_peaks": "SELECT vec_id, k AS frame, round(list_max(list_transform(embedding[k * 5 + 1:k * 5 + 10], lambda v: abs(CAST(v AS DOUBLE)))), 6) AS peak FROM embeddings, range(0, 11) t(k)",
    "speech_cuts": f'WITH {_INTERVALS}, {_FLIPPED} SELECT recording_id, CAST(a + 2 AS DOUBLE) AS start, CAST(z - 2 AS DOUBLE) AS "end" FROM fl WHERE z > a AND z - a - 4 >= 5',
    "phones_in_words": f"WITH {_EVENTS}, p AS (SELECT user_id AS recording_id, event_id, epoch_us(ts) / 1e6 + 2000 AS t FROM events) SELECT p.recording_id, event_id, index FROM p JOIN tw ON p.recording_id = tw.recording_id AND t >= start_frame * 1000.0::DOUBLE AND t < end_frame * 1000.0::DOUBLE",
    "pronounce": f"WITH k AS (SELECT DISTINCT unnest({_MMS_LIST}) AS word FROM benchmark), w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_MMS_LIST}) AS word FROM documents) GROUP BY word) SELECT w.word, n, CASE WHEN k.word IS NULL THEN 1 ELSE least(2, len(list_distinct([w.word, reverse(w.word)]))) END AS n_prons, CASE WHEN k.word IS NULL THEN '*' ELSE array_to_string(string_split(w.word, ''), ' ') END AS first FROM w LEFT JOIN k ON k.word = w.word",
    "decode_styles": f"SELECT vec_id, {_decoded(0)} AS plain, {_blanked(_decoded(0), '|')} AS pipe, {_blanked(_decoded(0), '▁')} AS subword, {_blanked(_decoded(1), '▁')} AS shifted FROM (SELECT vec_id, {_CODES} AS ids FROM embeddings)",
    "normalize_basic": f"SELECT doc_id, {_TRIM.replace('text', 'lower(text)')} AS text FROM documents",
    "mms_words": f"SELECT doc_id, idx, original, {_mms('original')} AS normalized FROM (SELECT doc_id, generate_subscripts(w, 1) - 1 AS idx, unnest(w) AS original FROM (SELECT doc_id, {_WORDS} AS w FROM documents))",
    "mms_text": f"SELECT doc_id, array_to_string({_MMS_LIST}, ' ') AS text FROM documents",
    "unknown_rate_by_lang": f"SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n_words, CAST(sum(len(list_filter(w, lambda x: x = '*'))) AS BIGINT) AS n_unknown, round(sum(len(list_filter(w, lambda x: x = '*'))) / sum(len(w)), 9) AS rate FROM (SELECT lang, {_MMS_LIST} AS w FROM documents) GROUP BY lang",
    "word_count_invariant": f"SELECT doc_id, len({_WORDS}) AS n_original, len({_MMS_LIST}) AS n_normalized FROM documents",
    "number_classes": f"""WITH w AS (SELECT lang, unnest({_WORDS}) AS word FROM documents),
b AS (SELECT *, regexp_replace(word, {_PUNCT}, '', 'g') AS bare, regexp_replace(substr(word, 2), {_PUNCT_DOT}, '', 'g') AS money, regexp_replace(substr(word, 1, length(word) - 1), {_PUNCT_DOT}, '', 'g') AS share FROM w)
SELECT lang, {_NUMBER_CLASS} AS class, count(*) AS n FROM b GROUP BY 1, 2""",
    "split_characters": "SELECT item_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '" + _WHITE + "', '', 'g'), '[\\p{P}\\p{S}]', '', 'g'), ''), lambda c: c <> ''), ' ') AS text FROM benchmark",
    "char_encode": f"""WITH w AS (SELECT doc_id, {_MMS_LIST} AS w FROM documents),
i AS (SELECT doc_id, len(w) AS n_words, list_transform(list_filter(string_split(array_to_string(w, ''), ''), lambda c: c <> ''), lambda c: CAST(strpos('{_ALPHABET}', c) - 1 AS BIGINT)) AS ids FROM w)
SELECT doc_id, n_words, len(ids) AS n_ids, list_reduce(list_prepend(CAST(0 AS BIGINT), ids), lambda acc, x: (acc * 31 + x) % 1000000007) AS code FROM i""",
    "char_roundtrip": f"SELECT item_id, idx, w AS normalized, w AS decoded FROM (SELECT item_id, generate_subscripts(w, 1) - 1 AS idx, unnest(w) AS w FROM (SELECT item_id, {_MMS_LIST} AS w FROM benchmark))",
    "html_text": f"SELECT page_id, {_HTML} AS text FROM pages",
    "source_kinds": f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN 'url' WHEN ends_with(lower(url), '.pdf') THEN 'pdf' ELSE 'file' END AS kind, length(trim(html)) > 100 AND len({_WORDS.replace('text', 'html')}) > 20 AS keep FROM pages",
    "recover_original": f"SELECT doc_id, array_to_string(list_filter([CASE WHEN len(w) > 0 THEN w[1] END, w[4], w[6], CASE WHEN len(w) > 0 THEN w[-1] END], lambda x: x IS NOT NULL), ' ') AS words FROM (SELECT doc_id, {_WORDS} AS w FROM documents)",
    "vocabulary": f"SELECT CAST(strpos('{_ALPHABET}', label) - 1 AS INTEGER) AS id, label, n FROM (SELECT c AS label, count(*) AS n FROM (SELECT unnest(string_split(array_to_string({_MMS_LIST}, ''), '')) AS c FROM documents) WHERE c <> '' GROUP BY c) WHERE strpos('{_ALPHABET}', label) > 0",
    "statistics_by_source": f"SELECT lang, source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM (SELECT lang, source, len({_WORDS}) AS n FROM documents) GROUP BY CUBE (lang, source)",
    "segment_windows": "SELECT doc_id, n AS n_samples, CAST(k AS INTEGER) AS segment_index, k * 208000 AS offset, least(240128, n - k * 208000) AS length, k * 650 AS frame_offset FROM (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 240128) / 208000) AS BIGINT)))) AS k FROM (SELECT doc_id, length(text) * 400 AS n FROM documents)) WHERE least(240128, n - k * 208000) >= 3200",
    "sliding_counts": "SELECT s * 46800000000 AS start_us, s * 46800000000 + 54000000000 AS end_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, unnest(range(CAST(floor((u - 54000000000) / 46800000000) AS BIGINT) + 1, CAST(floor(u / 46800000000) AS BIGINT) + 1)) AS s FROM (SELECT *, epoch_us(ts) AS u FROM events)) GROUP BY s, event_type",
    "event_sessions": "WITH e AS (SELECT user_id, epoch_us(ts) AS u FROM events), g AS (SELECT *, CASE WHEN u - lag(u) OVER (PARTITION BY user_id ORDER BY u) < 129600000000 THEN 0 ELSE 1 END AS o FROM e), r AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(u) AS start_us, max(u) + 129600000000 AS end_us, count(*) AS n FROM r GROUP BY user_id, run",
    "silent_runs": "WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, value < 10 AS s FROM events), r AS (SELECT *, frame - row_number() OVER (PARTITION BY user_id, s ORDER BY frame) AS run FROM f) SELECT user_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM r WHERE s GROUP BY user_id, run",
    "silence_cuts": "WITH f AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value / 1000 < pow(10.0, -36.0 / 20) AS s FROM events), r AS (SELECT *, frame - row_number() OVER (PARTITION BY recording_id, s ORDER BY frame) AS run FROM f), i AS (SELECT recording_id, min(frame) * 0.25::DOUBLE AS a, (max(frame) + 1) * 0.25::DOUBLE AS z FROM r WHERE s GROUP BY recording_id, run) SELECT recording_id, round(a + 0.1::DOUBLE, 6) AS start, round(z - 0.1::DOUBLE, 6) AS \"end\" FROM i WHERE z - a >= 0.2 AND (z - 0.1::DOUBLE) - (a + 0.1::DOUBLE) >= 0.4",
    "merge_intervals": f'WITH {_INTERVALS} SELECT recording_id, s AS start, e AS "end" FROM mi',
    "flip_intervals": f'WITH {_INTERVALS}, fl AS (SELECT recording_id, e AS a, coalesce(lead(s) OVER (PARTITION BY recording_id ORDER BY s), 2600.0) AS z FROM mi UNION ALL SELECT recording_id, 0.0, min(s) FROM mi GROUP BY recording_id) SELECT recording_id, CAST(a AS DOUBLE) AS start, CAST(z AS DOUBLE) AS "end" FROM fl WHERE z > a',
    "time_map": f"WITH {_INTERVALS} SELECT recording_id, new_time, original FROM tm",
    "map_to_original": f"WITH {_INTERVALS}, tq AS (SELECT recording_id, new_time, max(original) AS original FROM tm GROUP BY ALL) SELECT ot.recording_id, o_orderkey, t AS time, CASE WHEN new_time IS NULL THEN t ELSE original + t - new_time END AS original_time FROM ot ASOF LEFT JOIN tq ON ot.recording_id = tq.recording_id AND ot.t >= tq.new_time",
    "map_to_new": f"WITH {_INTERVALS} SELECT recording_id, o_orderkey, t AS time, new_time FROM tn",
    "asof_events": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type FROM events), c AS (SELECT user_id, us AS click_us, max(event_id) AS click_id FROM e WHERE event_type = 'click' GROUP BY ALL) SELECT e.user_id, event_id, us, click_us, click_id FROM (SELECT * FROM e WHERE event_type <> 'click') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.us >= c.click_us",
    "normalize_peak": "SELECT user_id, event_id, round(CASE WHEN p > 0 THEN value * pow(10.0, -3.0 / 20) / p ELSE value END, 6) AS value FROM (SELECT *, max(abs(value)) OVER (PARTITION BY user_id) AS p FROM events)",
    "to_mono": "SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL",
    "word_end_frames": f"WITH {_EVENTS} SELECT recording_id, index, word, start_frame, end_frame FROM tw",
    "word_gaps": f"WITH {_EVENTS} SELECT recording_id, index, start_frame - lag(end_frame) OVER (PARTITION BY recording_id ORDER BY index) AS gap FROM tw",
    "word_statistics": f"""WITH {_EVENTS}, g AS (SELECT *, start_frame - lag(end_frame) OVER (PARTITION BY recording_id ORDER BY index) AS b FROM tw), s AS (SELECT *, (end_frame - start_frame) * 1000.0::DOUBLE AS d, CASE WHEN b > 0 THEN b * 1000.0::DOUBLE END AS h, CASE WHEN score > 0 THEN score END AS c FROM g)
SELECT recording_id, count(*) AS num_words, arg_min(start_frame, index) * 1000.0::DOUBLE AS start, arg_max(end_frame, index) * 1000.0::DOUBLE AS "end", round(avg(d), 6) AS duration_mean, round(min(d), 6) AS duration_min, round(max(d), 6) AS duration_max, round(list_sort(list(d))[count(*) // 2 + 1], 6) AS duration_median,
round(avg(c), 6) AS confidence_mean, round(min(c), 6) AS confidence_min, round(max(c), 6) AS confidence_max, count(c) AS words_with_score, count(h) AS gap_count, round(sum(h), 6) AS gap_total, round(avg(h), 6) AS gap_mean, round(max(h), 6) AS gap_max FROM s GROUP BY recording_id""",
    "word_coverage": f"""WITH {_EVENTS}, k AS (SELECT recording_id, index FROM ew WHERE index % 3 <> 1), h AS (SELECT recording_id, count(*) AS n FROM (SELECT recording_id, lead(index) OVER (PARTITION BY recording_id ORDER BY index) - index AS x FROM k) WHERE x > 1 GROUP BY 1),
m AS (SELECT recording_id, count(*) AS n FROM k GROUP BY 1), t AS (SELECT recording_id, count(*) AS n FROM ew GROUP BY 1)
SELECT m.recording_id, m.n AS num_words, t.n AS total_words, round(100.0 * m.n / t.n, 6) AS coverage_percent, coalesce(h.n, 0) AS num_unaligned_regions FROM m JOIN t USING (recording_id) LEFT JOIN h USING (recording_id)""",
    "word_seconds": f"WITH {_EVENTS} SELECT recording_id, index, start_frame * 1000.0::DOUBLE AS start_s, end_frame * 1000.0::DOUBLE AS end_s, (end_frame - start_frame) * 1000.0::DOUBLE AS duration_s, end_frame - start_frame AS duration_frames, score AS confidence, CASE WHEN original <> '' AND original <> word THEN original || ' (' || word || ')' ELSE word END AS display FROM tw",
    "words_at_time": f"WITH {_EVENTS}, t AS (SELECT DISTINCT recording_id, (start_frame + index % 40) * 1000.0::DOUBLE AS time FROM tw) SELECT recording_id, time, min(index) AS index, arg_min(word, index) AS word FROM t JOIN tw USING (recording_id) WHERE time >= start_frame * 1000.0::DOUBLE AND time <= end_frame * 1000.0::DOUBLE GROUP BY recording_id, time",
    "words_in_range": f"WITH {_EVENTS} SELECT recording_id, index, word FROM tw WHERE start_frame * 1000.0::DOUBLE BETWEEN 1.705e9 AND 1.71e9",
    "words_by_index": f"WITH {_EVENTS}, x AS (SELECT recording_id, index % 7 - 1 AS i, word, start_frame, score, row_number() OVER (PARTITION BY recording_id, index % 7 ORDER BY start_frame DESC, score DESC) AS k FROM ew) SELECT recording_id, i AS index, word, start_frame, score FROM x WHERE i >= 0 AND k = 1",
    "timeline_text": f"WITH {_EVENTS} SELECT recording_id, string_agg(word, ' ' ORDER BY index) AS text, (arg_max(end_frame, index) - arg_min(start_frame, index)) * 1000.0::DOUBLE AS duration, count(*) AS num_words FROM tw GROUP BY recording_id",
    "preview_segment": f"WITH {_EVENTS}, p AS (SELECT recording_id, min(start_frame) AS a, max(end_frame) AS z, string_agg(word, ' ' ORDER BY index) AS text, count(*) AS n FROM tw WHERE index BETWEEN 5 AND 24 GROUP BY 1) SELECT recording_id, text, n, greatest(a * 1000.0::DOUBLE - 100, 0) AS start_s, z * 1000.0::DOUBLE + 100 AS end_s, CAST(greatest(a * 1000.0::DOUBLE - 100, 0) * 16 AS BIGINT) AS start_sample, CAST((z * 1000.0::DOUBLE + 100) * 16 AS BIGINT) AS end_sample FROM p",
    "sequential_clips": f"WITH {_EVENTS} SELECT recording_id, index AS position, word, start_frame * 1000.0::DOUBLE AS start_s, coalesce(lead(start_frame) OVER (PARTITION BY recording_id ORDER BY index) * 1000.0::DOUBLE, end_frame * 1000.0::DOUBLE + 0.3::DOUBLE) AS end_s FROM tw WHERE index BETWEEN 2 AND 13",
    "first_words": f"WITH {_EVENTS} SELECT recording_id, index, word FROM tw WHERE index < 50",
    "iou_metrics": f"""WITH {_EVENTS}, m AS (SELECT *, start_frame + index % 7 AS a, end_frame + index % 5 AS z FROM tw), o AS (SELECT *, greatest(least(z, end_frame) - greatest(a, start_frame), 0) AS meet FROM m)
SELECT recording_id, round(avg(abs(a - start_frame)) * 0.02::DOUBLE * 1000, 6) AS start_error_ms, round(avg(CASE WHEN (z - a) + (end_frame - start_frame) - meet > 0 THEN meet / ((z - a) + (end_frame - start_frame) - meet) ELSE 0 END), 6) AS mean_iou, count(*) AS n FROM o GROUP BY recording_id""",
    "label_lines": f"WITH {_EVENTS} SELECT recording_id, index, printf('%.6f', start_frame * 1000.0::DOUBLE) || chr(9) || printf('%.6f', end_frame * 1000.0::DOUBLE) || chr(9) || word AS line FROM tw",
    "ctm_lines": f"WITH {_EVENTS} SELECT recording_id, index, recording_id || ' 1 ' || printf('%.3f', start_frame * 1000.0::DOUBLE) || ' ' || printf('%.3f', (end_frame - start_frame) * 1000.0::DOUBLE) || ' ' || word || CASE WHEN score > 0 THEN ' ' || printf('%.3f', score) ELSE '' END AS line FROM tw",
    "subtitle_cues": f"WITH {_EVENTS}{_SMALL}, c AS (SELECT recording_id, k // 10 + 1 AS cue, arg_min(a, k) * 0.25::DOUBLE AS s, arg_max(z, k) * 0.25::DOUBLE AS e, string_agg(word, ' ' ORDER BY k) AS text FROM sw GROUP BY 1, 2) SELECT recording_id, cue, {_clock('s')} AS start, {_clock('e')} AS \"end\", text FROM c",
    "karaoke_lines": f"""WITH {_EVENTS}{_SMALL}, t AS (SELECT *, k // 8 AS line_no, lead(a) OVER (PARTITION BY recording_id, k // 8 ORDER BY k) AS x FROM sw), g AS (SELECT *, '{{\\kf' || CAST(CAST(trunc(coalesce(x * 0.25::DOUBLE - a * 0.25::DOUBLE, (z - a) * 0.25::DOUBLE) * 100) AS BIGINT) AS VARCHAR) || '}}' || word AS tag FROM t),
c AS (SELECT recording_id, line_no, arg_min(a, k) * 0.25::DOUBLE AS s, arg_max(z, k) * 0.25::DOUBLE AS e, string_agg(tag, ' ' ORDER BY k) AS tags FROM g GROUP BY 1, 2) SELECT recording_id, line_no, 'Dialogue: 0,' || {_centi('s')} || ',' || {_centi('e')} || ',Default,,0,0,0,,' || tags AS line FROM c""",
    "textgrid_intervals": f"WITH {_EVENTS} SELECT recording_id, index + 1 AS n, start_frame * 1000.0::DOUBLE AS xmin, end_frame * 1000.0::DOUBLE AS xmax, word AS text FROM tw",
    "json_words": f"WITH {_EVENTS}, j AS (SELECT *, score - 20 AS sc FROM tw) SELECT recording_id, index AS i, word, start_frame * 0.25::DOUBLE AS start, end_frame * 0.25::DOUBLE AS \"end\", CASE WHEN original <> '' AND original <> word THEN original END AS original, CASE WHEN sc > 0 THEN round_even(sc, 3) END AS score, index FROM j",
    "page_words": f"WITH {_EVENTS}, t AS (SELECT recording_id, index, coalesce(original, word) AS word FROM ew WHERE index >= 1 AND index < 200), a AS (SELECT * FROM (SELECT recording_id, index AS i, start_frame, end_frame FROM tw) WHERE i % 3 <> 1) SELECT t.recording_id, t.index, t.word, a.start_frame * 1000.0::DOUBLE AS start_s, a.end_frame * 1000.0::DOUBLE AS end_s, a.i IS NOT NULL AS aligned FROM t LEFT JOIN a ON a.recording_id = t.recording_id AND a.i = t.index",
    "clip_bounds": f"WITH {_EVENTS}, k AS (SELECT * FROM tw WHERE index % 4 <> 2), m AS (SELECT recording_id, max(index) AS top, max(end_frame) * 1000.0::DOUBLE - 500 AS d FROM k GROUP BY 1), s AS (SELECT recording_id, d, unnest(range(0, top + 1)) AS index FROM m) SELECT s.recording_id, s.index, coalesce(word, '[' || s.index || ']') AS word, CASE WHEN start_frame IS NOT NULL THEN greatest(start_frame * 1000.0::DOUBLE - 900, 0) END AS start_s, CASE WHEN end_frame IS NOT NULL THEN least(end_frame * 1000.0::DOUBLE + 900, d) END AS end_s FROM s LEFT JOIN k ON k.recording_id = s.recording_id AND k.index = s.index",
    "flatten_tokens": f"WITH {_tokens()} SELECT recording_id, segment_index, pos, token_id, frame FROM it WHERE segment_index % 5 <> 0",
    "dedupe_by_position": f"WITH {_tokens()} SELECT recording_id, frame, segment_index, pos, token_id FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY segment_index, pos) AS k FROM it) WHERE k = 1",
    "lis_length": f"""WITH {_tokens()}, l AS (SELECT recording_id, list([wid] ORDER BY segment_index, pos) AS v FROM it WHERE wid IS NOT NULL GROUP BY 1)
SELECT recording_id, len(list_reduce(v, lambda acc, x: list_filter(acc, lambda y: y < x[1]) || x || list_filter(acc, lambda y: y >= x[1])[2:])) AS length FROM l""",
    "remove_outliers": f"""WITH {_tokens('')}, i AS (SELECT DISTINCT recording_id, wid FROM it WHERE wid IS NOT NULL), w AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY wid) - 1 AS rn, count(*) OVER (PARTITION BY recording_id) AS n, wid - lag(wid) OVER (PARTITION BY recording_id ORDER BY wid) AS gap FROM i),
c AS (SELECT *, least(100, n // 2 - 1) AS sc FROM w), h AS (SELECT *, coalesce(max(CASE WHEN gap > 60 AND rn >= 1 AND rn <= sc THEN rn END) OVER (PARTITION BY recording_id), 0) AS l, coalesce(min(CASE WHEN gap > 60 AND rn >= n - sc THEN rn END) OVER (PARTITION BY recording_id), n) AS r FROM c)
SELECT recording_id, wid FROM h WHERE n <= 10 OR (rn >= l AND rn < r)""",
    "unaligned_holes": f"WITH {_tokens('')}, ids AS (SELECT DISTINCT recording_id, wid AS v FROM it WHERE wid IS NOT NULL), {_HOLES}, {_merged('ho', 3)}",
    "merge_holes": f"WITH {_INTERVALS}, ho AS (SELECT recording_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM oi), {_merged('ho', 20)}",
    "edit_distance": f"""WITH {_TURNS}, k AS (SELECT recording_id, list_transform(a, lambda w: lower(w)) AS a, list_transform(b, lambda w: lower(w)) AS b FROM tp WHERE len(a) + len(b) > 0)
SELECT recording_id, CAST(list_last(list_reduce(list_prepend(CAST(range(0, len(b) + 1) AS BIGINT[]), list_transform(range(1, len(a) + 1), lambda i: [CAST(i AS BIGINT)])), lambda acc, x: list_transform(range(1, len(b) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda q: j - q + CASE WHEN q = 1 THEN x[1] ELSE least(acc[q] + 1, acc[q - 1] + CASE WHEN a[x[1]] = b[q - 1] THEN 0 ELSE 1 END) END))))) AS DOUBLE) AS distance FROM k""",
    "log_softmax": "WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings), z AS (SELECT vec_id, e, top + ln(list_sum(list_transform(e, lambda x: exp(x - top)))) AS z FROM m) SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, round(unnest(e) - z, 5) AS v FROM z",
    "greedy_labels": f"WITH {_VF} SELECT label AS recording, pos, frame, k AS token FROM vg",
    "greedy_text": f"WITH {_VF} SELECT label, string_agg(substr('-abc', CAST(k AS INTEGER) + 1, 1), '' ORDER BY pos) AS text FROM vg GROUP BY label",
    "star_and_roll": "SELECT vec_id, 5 AS n, round(CAST(embedding[4] AS DOUBLE), 6) AS first, round(CAST(embedding[1] AS DOUBLE), 6) AS second, -5.0::DOUBLE AS star FROM embeddings",
    "factor_arcs": f"WITH {_BT} {_arcs(_FACTOR)}",
    "ctc_arcs": f"WITH {_BT} {_arcs(_CTC)}",
    "viterbi_words": f"WITH {_BT} SELECT doc_id, wid, c * 3 AS frame FROM bt WHERE f",
    "preset_families": "SELECT * FROM (VALUES ('conformer', 'conformer-ctc,fastconformer-hybrid', 2), ('pipeline', 'mms-fa,wav2vec2-base,wav2vec2-large', 3), ('transformer', 'mms-1b-all', 1)) t(family, names, n)",
}

#: Right, but cubic in the words of a conversation: too slow for whole tables, so tests alone run it on small ones.
SLOW = {"edit_distance": SQL.pop("edit_distance")}
