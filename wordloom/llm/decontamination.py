"""Benchmark decontamination by latent semantic retrieval, with subsequence and answer checks.

Space. Words are hashed to features and weighed by their inverse document frequency over all documents.
All passages of ``FIT_WORDS`` words of all documents are unit TF-IDF vectors; a randomised SVD that runs over
tasks (a range finder with one power step, then a small eigenproblem) gives their ``RANK`` leading right
singular vectors. A text is the sum of its words' vectors in this space, so words that occur in the same
passages are near each other.
Features that no passage has get fixed random directions.

Search. Every text is cut into overlapping passages of several sizes; an item is compared with those of
the least size that holds it. All passages are compared with all items in one pass over the documents, in
blocks. Two cosines make candidates: one of latent vectors as they are, where frequent subjects lead, of
``SUBJECT`` or more, and one with each dimension divided by its singular value, where details count as much,
of ``COSINE`` or more. A candidate counts if the longest
common subsequence of words, from half a passage before to half a passage behind, covers ``SURE`` of the
item, or ``LIKELY`` of it and half of the item's answer, which is its last quarter. Candidates that share too
few words with the item for that aren't aligned, nor are those of a run of passages that all its words
together don't suffice for.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled, small_batches, swept, written
from .textkit import U64, distinct, rows, shingles, trim, word_hashes

WIDTH_BITS = 14
WIDTH = 1 << WIDTH_BITS
RANK, OVERSAMPLE = 96, 16
#: Words of the passages that the space is fitted on.
FIT_WORDS = 64
#: Passages of a row of their table, and rows of an Arrow batch.
FIT_ROW, FIT_BATCH = 512, 32
#: Rows that are worked on at once: the more, the fewer times a feature is visited, and the more memory it takes.
FIT_ROWS = 64
#: Features of a slice of the matrix that a task hands over; the slices of several tasks meet in one.
FIT_SLICE = 1024
#: Tasks of the fit, at least, and words of the corpus for each: a task hands over a matrix of features times rank.
FIT_TASKS, TASK_WORDS = 8, 1 << 22
TERMS = "part int, data binary, terms binary, counts binary, sizes binary"
SIZES = (12, 16, 24, 32, 48, 64)  # and on in this way, up to the longest item
#: Words whose latent vectors a task holds at a time, besides those of one passage.
BLOCK_WORDS = 1 << 13
#: Words of a column of running sums, a power of two.
COLUMN = 64
#: Words of passages that are compared with one item at a time, about.
ALIGN_WORDS = 1 << 18
#: Words of the items that one pass over the documents takes at most, or one item.
PASS_WORDS = 1 << 23
COSINE, SUBJECT, SURE, LIKELY, ANSWER = 0.5, 0.7, 0.75, 0.55, 0.5
#: Items with fewer words are found by their exact words only.
LEAST_WORDS = 8
LEAKS = "doc_id long, item_id long, start int, cosine double, common double, answer double"


def _feature(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - WIDTH_BITS)).astype(np.int64)


def _sizes(longest: int) -> list[int]:
    """Passage sizes up to the first that holds ``longest`` words."""
    out = list(SIZES)
    while out[-1] < longest:
        out.append(2 * out[-2])
    return out


def _short(words: np.ndarray) -> np.ndarray:
    """Word hashes of 32 bits, enough to tell the words of a passage apart."""
    return (words >> U64(32)).astype("<u4")


def _terms(batches):
    """The distinct features and their counts of all passages of ``FIT_WORDS`` words, with the passages' numbers of features, in rows of ``FIT_ROW`` passages.

    Last, the number of documents with each feature, in slices of the features; part -1 has the numbers of documents and words.
    """
    names = [x.split()[0] for x in TERMS.split(", ")]
    total, documents, count = np.zeros(WIDTH, np.int64), 0, 0
    for batch in batches:
        for first, last, buf, offsets in rows(batch.column("text")):
            words, at = word_hashes(buf, offsets)
            documents += last - first
            count += len(words)
            if not len(words):
                continue
            length = np.diff(at)
            number = -(-length // FIT_WORDS)
            base = np.cumsum(number) - number
            row = np.repeat(np.arange(last - first), length)
            passage = base[row] + (np.arange(len(words)) - at[row]) // FIT_WORDS
            key = np.sort(passage << WIDTH_BITS | _feature(words))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, often = key[begin], np.diff(np.append(begin, len(key)))
            term, passage = key & (WIDTH - 1), key >> WIDTH_BITS
            total += np.bincount(distinct(np.repeat(np.arange(last - first), number)[passage] << WIDTH_BITS | term) & (WIDTH - 1), minlength=WIDTH)
            size = np.bincount(passage)
            edge = np.searchsorted(passage, np.arange(0, len(size) + FIT_ROW, FIT_ROW)).tolist()
            parts = [[x[a:b].tobytes() for a, b in itertools.pairwise(edge)] for x in (term.astype("<u2"), often.astype(np.uint8))]
            parts.append([size[k : k + FIT_ROW].astype(np.uint8).tobytes() for k in range(0, len(size), FIT_ROW)])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(parts[0]), pa.int32()), pa.nulls(len(parts[0]), pa.binary()), *(pa.array(x, pa.binary()) for x in parts)], names=names)
    parts = total.astype("<i8").reshape(16, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 16, dtype=np.int32)), pa.array([np.array([documents, count], "<i8").tobytes(), *(p.tobytes() for p in parts)], pa.binary()), *(pa.nulls(17, pa.binary()) for _ in range(3))], names=names)
    trim()


def _sum_parts(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums ``part, data`` by part: first those of every 64th task, then these sums."""

    def add(key, pdf):
        total = np.frombuffer(pdf["data"].iloc[0], kind).copy()
        for x in pdf["data"].iloc[1:]:
            total += np.frombuffer(x, kind)
        return pd.DataFrame({"part": [key[0]], "data": [total.tobytes()]})

    some = parts.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(64)).alias("lane")).applyInPandas(add, "part int, data binary")
    with swept(parts.sparkSession):
        return {r.part: np.frombuffer(r.data, kind) for r in some.groupBy("part").applyInPandas(add, "part int, data binary").collect()}


def inverse_frequencies(terms: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency of every feature, over all documents, and the number of words, from a table of ``_terms``."""
    got = _sum_parts(terms.where("part is not null").select("part", "data"), "<i8")
    documents, count = got.pop(-1, np.zeros(2, np.int64)).tolist()
    df = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(WIDTH)
    return (np.log((1 + documents) / (1 + df)) + 0.1).astype(np.float32), count


def _weighed(pdf: pd.DataFrame, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of passages: their distinct features, the weights of these in the unit vectors, and each passage's number of features. Row by row, so that little is held besides."""
    term, size = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("terms", "<u2"), ("sizes", np.uint8)))
    out, at = np.empty(len(term), np.float32), 0
    for counts, sizes in zip(pdf["counts"], pdf["sizes"], strict=True):
        often, own = np.frombuffer(counts, np.uint8), np.frombuffer(sizes, np.uint8).astype(np.int64)
        value = idf[term[at : at + len(often)]] * often
        norm = np.sqrt(np.add.reduceat(np.square(value, dtype=np.float64), np.cumsum(own) - own))
        out[at : at + len(often)] = value / np.repeat(np.maximum(norm, 1e-9), own)
        at += len(often)
    return term, out, size.astype(np.int64)


def _joined(batches):
    """The frames in runs of about ``FIT_ROWS`` rows."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= FIT_ROWS:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def _times(term: np.ndarray, value: np.ndarray, size: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The passages' vectors times ``basis``. A few at a time, in the same memory."""
    out = np.empty((len(size), 1, basis.shape[1]), np.float32)
    held = np.empty((32, FIT_WORDS, basis.shape[1]), np.float32)
    edge = np.concatenate([[0], np.cumsum(size)])
    for low in range(0, len(size), FIT_ROW):
        high = min(low + FIT_ROW, len(size))
        at = np.arange(FIT_WORDS) < size[low:high, None]
        index, weight = np.zeros(at.shape, np.int64), np.zeros((high - low, 1, FIT_WORDS), np.float32)
        index[at], weight[:, 0][at] = term[edge[low] : edge[high]], value[edge[low] : edge[high]]
        for k in range(0, high - low, 32):
            part = index[k : k + 32]
            np.matmul(weight[k : k + 32], np.take(basis, part, axis=0, out=held[: len(part)], mode="clip"), out=out[low + k : low + k + len(part)])
    return out[:, 0]


def _add_transposed(out: np.ndarray, term: np.ndarray, value: np.ndarray, size: np.ndarray, low: np.ndarray) -> None:
    """Adds the transposed passages' vectors times ``low`` to ``out``, feature by feature."""
    order = np.argsort(term.astype("<u2", copy=False), kind="stable")
    row, value, term = np.repeat(np.arange(len(size), dtype=np.int32), size)[order], value[order], term[order]
    del order
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    held = np.empty((256, low.shape[1]), np.float32)
    for t, a, z in zip(term[begin].tolist(), begin.tolist(), np.append(begin[1:], len(term)).tolist(), strict=True):
        for k in range(a, z, len(held)):
            stop = min(z, k + len(held))
            out[t] += value[k:stop] @ np.take(low, row[k:stop], axis=0, out=held[: stop - k], mode="clip")


def _gathered(batches, idf: np.ndarray, basis: np.ndarray, square: bool):
    """The sum over passages p of p p' basis, or of its product with basis', in slices ``part, data`` of ``FIT_SLICE`` features."""
    wide = basis.shape[1]
    out = np.zeros((wide, wide) if square else (WIDTH, wide), np.float64 if square else np.float32)

    def add(pdf: pd.DataFrame) -> None:
        term, value, size = _weighed(pdf, idf)
        low = _times(term, value, size, basis)
        if square:
            np.add(out, low.T @ low, out=out)
        else:
            _add_transposed(out, term, value, size, low)

    for pdf in _joined(batches):
        add(pdf)
    kind = "<f8" if square else "<f4"
    for k in range(0, len(out), FIT_SLICE):
        yield pd.DataFrame({"part": [k], "data": [out[k : k + FIT_SLICE].astype(kind).tobytes()]})
    trim()


def latent_space(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A latent vector of each feature (features, rank), over the singular values, and these, from ``passages(terms, counts, sizes)``."""
    spark = passages.sparkSession
    wide = rank + OVERSAMPLE

    def product(basis: np.ndarray, square: bool) -> np.ndarray:
        sent = spark.sparkContext.broadcast(basis)
        with small_batches(spark, FIT_BATCH):
            sums = _sum_parts(passages.mapInPandas(lambda it: _gathered(it, idf, sent.value, square), "part int, data binary"), "<f8" if square else "<f4")
        sent.destroy()
        out = np.zeros((wide, wide) if square else (WIDTH, wide), np.float64 if square else np.float32)
        for k, x in sums.items():
            out[k : k + FIT_SLICE] = x.reshape(-1, wide)
        return out

    basis = np.random.default_rng(seed).standard_normal((WIDTH, wide)).astype(np.float32)
    for _ in range(2):
        basis = np.linalg.qr(product(basis, False))[0].astype(np.float32)
    values, vectors = np.linalg.eigh(product(basis, True))
    known = np.flatnonzero(values > 1e-6 * max(values[-1], 1e-30))[-rank:]
    space = basis @ (vectors[:, known] / np.sqrt(values[known])).astype(np.float32) * idf[:, None]
    del basis
    norm = np.linalg.norm(space, axis=1)
    unknown = np.flatnonzero(norm < 1e-6 * max(norm.max(initial=0), 1e-30))
    out = np.zeros((WIDTH, rank), np.float32)
    out[:, : space.shape[1]] = space
    if len(unknown):
        # Without any passage, all features are unknown: then the space is a random projection.
        scale = np.median(norm[norm > 0]) if (norm > 0).any() else 1.0
        random = np.random.default_rng(seed + 1).standard_normal((len(unknown), rank))
        out[unknown] = random / np.linalg.norm(random, axis=1, keepdims=True) * scale
    singular = np.ones(rank, np.float32)
    singular[: len(known)] = np.sqrt(values[known] / max(values[-1], 1e-30))
    return out, singular


class Items:
    """Benchmark items: their words and their unit latent vectors, by passage size."""

    def __init__(self, ids: list[int], texts: list[str], space: np.ndarray, singular: np.ndarray):
        self.ids, self.words, self.features, vectors = ids, [], [], []
        for _, _, buf, offsets in rows(pa.array(texts, pa.large_string())):
            words, at = word_hashes(buf, offsets)
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                self.words.append(_short(words[a:z]))
                self.features.append(np.unique(_feature(words[a:z]), return_counts=True))
                v = space[_feature(words[a:z])].sum(0, dtype=np.float64)
                vectors.append(v)
        answers = [w[-max(1, len(w) // 4) :] for w in self.words]
        self.places = [(len(w), places(w), len(x), places(x)) for w, x in zip(self.words, answers, strict=True)]
        sizes = _sizes(max(map(len, self.words)))
        #: The least passage size that holds an item.
        size = np.array([next(s for s in sizes if s >= len(w)) for w in self.words])
        self.of_size = {s: np.flatnonzero(size == s) for s in sorted(set(size.tolist()))}
        #: For the squared lengths of a passage's vectors: as it is, and with the singular values.
        self.squares = np.stack([np.ones(len(singular)), np.square(singular)], 1).astype(np.float32)
        unit = lambda x: (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
        details = {s: unit(np.stack([vectors[j] for j in own])) for s, own in self.of_size.items()}
        subjects = {s: unit(np.stack([vectors[j] for j in own]) * singular) * singular[:, None] for s, own in self.of_size.items()}
        #: By size, a column for each item's details and then one for each item's subject.
        self.columns = {s: np.concatenate([details[s], subjects[s]], 1).astype(np.float32) for s in self.of_size}


def _windows(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the overlapping passages of ``size`` words of all rows."""
    count, step = np.diff(at), size // 4
    number = np.where(count > 0, 1 + np.maximum(0, -(-(count - size) // step)), 0)
    row = np.repeat(np.arange(len(count)), number)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)) * step + at[:-1][row]
    return row, begin, np.minimum(begin + size, at[1:][row])


class _Sums:
    """Running sums of a block of words' latent vectors, in columns of ``COLUMN`` words; its memory is used again."""

    def __init__(self, space: np.ndarray):
        self.space, self.held = space, np.zeros((1, space.shape[1]), np.float32)
        self.ends = np.empty((2, 0, space.shape[1]), np.float32)

    def fill(self, feature: np.ndarray) -> None:
        self.columns = -(-len(feature) // COLUMN)
        n, rank = self.columns * COLUMN, self.space.shape[1]
        if len(self.held) <= n:
            self.held = np.empty((n + 1, rank), np.float32)
        #: Before the first word.
        self.zero = n
        self.held[n] = 0
        index = np.zeros(n, np.int64)
        index[: len(feature)] = feature
        np.take(self.space, index.reshape(-1, COLUMN).T.ravel(), axis=0, out=self.held[:n], mode="clip")
        sums = self.held[:n].reshape(COLUMN, self.columns * rank)
        for k in range(1, COLUMN):
            np.add(sums[k], sums[k - 1], out=sums[k])
        before = np.zeros((self.columns, rank), np.float32)
        np.cumsum(sums[-1].reshape(self.columns, rank)[:-1], axis=0, out=before[1:])
        sums += before.ravel()

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The sums of the words from ``begin`` up to ``end``, until the next call."""
        if self.ends.shape[1] < len(begin):
            self.ends = np.empty((2, len(begin), self.space.shape[1]), np.float32)
        for x, out in zip((end, begin), self.ends, strict=True):
            x = x - 1
            place = (x & COLUMN - 1) * self.columns + (x >> COLUMN.bit_length() - 1)
            place[x < 0] = self.zero
            np.take(self.held, place, axis=0, out=out[: len(x)], mode="clip")
        return np.subtract(self.ends[0, : len(begin)], self.ends[1, : len(begin)], out=self.ends[0, : len(begin)])


def _near(feature: np.ndarray, at: np.ndarray, sums: _Sums, items: Items) -> tuple[np.ndarray, ...]:
    """``item, row, begin, low, high, cosine`` of all passages near an item, by item and place; low and high are the words to align."""
    windows = {s: _windows(at, s) for s in items.of_size}
    out = [(np.zeros(0, np.int64),) * 5 + (np.zeros(0, np.float32),)]
    for origin in range(0, len(feature), BLOCK_WORDS):
        mine = {s: slice(*np.searchsorted(begin, [origin, origin + BLOCK_WORDS])) for s, (_, begin, _) in windows.items()}
        stop = max([origin, *(int(end[mine[s]].max()) for s, (_, _, end) in windows.items() if mine[s].stop > mine[s].start)])
        if stop == origin:
            continue
        sums.fill(feature[origin:stop])
        for size, (row, begin, end) in windows.items():
            row, begin, end = row[mine[size]], begin[mine[size]], end[mine[size]]
            own = items.of_size[size]
            for k in range(0, len(begin), 1024):
                part = slice(k, k + 1024)
                z = sums.between(begin[part] - origin, end[part] - origin)
                alike = z @ items.columns[size]
                length = np.maximum(np.sqrt(np.maximum(np.square(z, out=z) @ items.squares, 0)), 1e-9)
                alike = alike.reshape(len(z), 2, len(own))
                hit = np.flatnonzero(alike >= (length * (COSINE, SUBJECT)).astype(np.float32)[:, :, None])
                if len(hit):
                    i, j = np.divmod(hit, 2 * len(own))
                    i, j = np.divmod(distinct(i * len(own) + j % len(own)), len(own))
                    r, b, e = row[part][i], begin[part][i], end[part][i]
                    near = (alike[i, :, j] / length[i]).max(1)
                    out.append((own[j], r, b, np.maximum(at[r], b - size // 2), np.minimum(at[r + 1], e + size // 2), near))
    found = [np.concatenate(x) for x in zip(*out, strict=True)]
    order = np.argsort(found[0], kind="stable")
    return tuple(x[order] for x in found)


def _aligned(feature: np.ndarray, short: np.ndarray, at: np.ndarray, sums: _Sums, items: Items):
    """``item, row, begin, cosine, share, answer's share`` of all passages that leak an item.

    Runs of passages of a text whose words to align meet are looked at first: what all words of a run don't have, none of its passages has.
    """
    item, row, begin, low, high, near = _near(feature, at, sums, items)
    if not len(item):
        return
    slot = np.full(WIDTH, -1, np.int16)
    opens = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1])]))
    ends = np.append(opens[1:], len(item))
    edge = np.flatnonzero(np.concatenate([[True], item[opens[1:]] != item[opens[:-1]], [True]]))
    for a, z in itertools.pairwise(edge.tolist()):
        own = int(item[opens[a]])
        known, count = items.features[own]
        size, words_at, _, _ = items.places[own]
        need = np.ceil(LIKELY * size - 1e-9)
        slot[known] = np.arange(len(known))
        for run, words in _sharing(feature, slot, low[opens[a:z]], high[ends[a:z] - 1], count, need):
            mine = slice(opens[a + run], ends[a + run])
            if ends[a + run] - opens[a + run] > 1 and covered(words_at, size, short[words].tolist()) < need:
                continue
            for k, words in _sharing(feature, slot, low[mine], high[mine], count, need):
                share, last_share = aligned(items.places[own], short[words].tolist())
                if share >= SURE or share >= LIKELY and last_share >= ANSWER:
                    i = mine.start + k
                    yield own, int(row[i]), int(begin[i]), float(near[i]), share, last_share
        slot[known] = -1


def _sharing(feature: np.ndarray, slot: np.ndarray, low: np.ndarray, high: np.ndarray, count: np.ndarray, need: float):
    """The spans that share ``need`` words with an item at least, and the places of their words with its features.

    ``slot`` has each feature's number in the item, or -1; ``count`` is how often the item has it.
    """
    step = max(1, ALIGN_WORDS // int((high - low).max()))
    for k in range(0, len(low), step):
        first, length = low[k : k + step], (high - low)[k : k + step]
        place = np.arange(length.sum()) + np.repeat(first - np.cumsum(length) + length, length)
        which = slot[feature[place]]
        good = np.flatnonzero(which >= 0)
        span, place = np.repeat(np.arange(len(first)), length)[good], place[good]
        shared = np.bincount(span * len(count) + which[good], minlength=len(first) * len(count)).reshape(len(first), -1)
        bound = np.searchsorted(span, np.arange(len(first) + 1))
        for i in np.flatnonzero(np.minimum(shared, count).sum(1) >= need).tolist():
            yield k + i, place[bound[i] : bound[i + 1]]


def _search(batches, items: Items, space: np.ndarray):
    """Leaks of each batch: of a document and an item the best passage."""
    sums = _Sums(space)
    for batch in batches:
        best: dict = {}
        for first, last, buf, offsets in rows(batch.column("text")):
            words, at = word_hashes(buf, offsets)
            ids = batch.column("doc_id").slice(first, last - first).to_pylist()
            for own, r, b, near, share, last_share in _aligned(_feature(words), _short(words), at, sums, items):
                if ids[r] is not None:
                    value = (share, last_share, near, -(b - int(at[r])))
                    best[ids[r], items.ids[own]] = max(value, best.get((ids[r], items.ids[own]), value))
        trim()
        out = [(d, i, -back, near, share, last_share) for (d, i), (share, last_share, near, back) in best.items()]
        yield _leaks(out)


def _leaks(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in LEAKS.split(", ")])


def places(item: np.ndarray) -> dict[int, int]:
    """The positions of each word of an item, as the bits of a number."""
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def covered(at: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item, by its ``places`` and size, and ``words``: a row of the table in one number."""
    whole = (1 << size) - 1
    row = whole
    for w in words:
        if hit := at.get(w):
            hit &= row
            row = (row + hit | row - hit) & whole
    return size - row.bit_count()


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    return covered(places(item), len(item), words.tolist())


def aligned(item: tuple, words: list[int]) -> tuple[float, float]:
    """The shares of an item and of its answer that common subsequences with ``words`` cover; too little of the item ends it."""
    size, at, last_size, last = item
    share = covered(at, size, words) / size
    return share, covered(last, last_size, words) / last_size if share >= LIKELY else 0.0


def _brief(items: list) -> dict[int, dict[int, list[int]]]:
    """Ids of items by their number of words and the hash of all of them."""
    out: dict = {}
    for _, _, buf, offsets in rows(pa.array([r.text for r in items], pa.large_string())):
        words, at = word_hashes(buf, offsets)
        for r, a, z in zip(items, at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = int(shingles(words[a:z], np.array([0, z - a]), z - a)[0][0])
            out.setdefault(z - a, {}).setdefault(key, []).append(r.item_id)
    return out


def _exact(batches, items: dict[int, dict[int, list[int]]]):
    """The first place of every brief item in every text."""
    for batch in batches:
        out = {}
        for first, last, buf, offsets in rows(batch.column("text")):
            words, at = word_hashes(buf, offsets)
            ids = batch.column("doc_id").slice(first, last - first).to_pylist()
            for size, known in items.items():
                grams, begin = shingles(words, at, size)
                for i in np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64))).tolist():
                    row = int(np.searchsorted(begin, i, "right")) - 1
                    if ids[row] is not None:
                        for item in known[int(grams[i])]:
                            out.setdefault((first + row, item), (ids[row], item, i - int(begin[row]), 1.0, 1.0, 1.0))
        yield _leaks(list(out.values()))


def _blocks(asked: DataFrame):
    """Items in runs of ``PASS_WORDS`` words at most, or one item."""
    block, weight = [], 0
    for r in asked.orderBy("item_id", "text").toLocalIterator():
        if block and weight + r.n > PASS_WORDS:
            yield block
            block, weight = [], 0
        block.append(r)
        weight += r.n
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """``doc_id, item_id, start, cosine, common, answer`` of every document and item that it leaks, with its best passage.

    ``start`` is the passage's first word; ``rank`` should suit the number of subjects. Null and blank texts leak nothing; items that are null or
    blank are not looked for, those shorter than ``LEAST_WORDS`` words by their exact words; repeated items
    count once for each id. Rows that share a doc_id are looked at one by one and reported together; null
    ids are not reported. Other columns are ignored; empty tables give an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = F.size(F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct().withColumn("n", count)
    found, space = None, None
    brief = asked.where((F.col("n") > 0) & (F.col("n") < LEAST_WORDS)).collect()
    if brief:
        known = _brief(brief)
        found = docs.mapInArrow(lambda it: _exact(it, known), LEAKS)
    for block in _blocks(asked.where(F.col("n") >= LEAST_WORDS)):
        if space is None:
            terms = written(docs.select("text").mapInArrow(_terms, TERMS), "passages")
            idf, words = inverse_frequencies(terms)
            passages = terms.where("part is null").select("terms", "counts", "sizes")
            space, singular = latent_space(passages.coalesce(max(FIT_TASKS, -(-words // TASK_WORDS))), idf, rank)
            trim()
        sent = spark.sparkContext.broadcast((Items([r.item_id for r in block], [r.text for r in block], space, singular), space))
        part = docs.mapInArrow(lambda it, sent=sent: _search(it, *sent.value), LEAKS)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], LEAKS)
    best = F.max(F.struct("common", "answer", "cosine", (-F.col("start")).alias("back"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.cosine", "b.common", "b.answer")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id leaks no item; all columns stay, and so do null ids."""
    gone = settled(docs.sparkSession, lambda: find_leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
