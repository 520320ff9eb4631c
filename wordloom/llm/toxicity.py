"""Toxicity by weak supervision.

Voters. ``VOTERS`` names them: fixed lists of English words by theme, several words of the lists, a list's word
addressed to the reader, lexicons of terms (words, and the first four and five bytes of longer words) that
are far commoner in toxic than in clean labelled documents, patterns of shape (shouting, runs of exclamation
marks, masked words), and polite words. Each votes for its side or abstains.

Label model. The votes of all documents, labelled or not, are counted by pattern. A latent class with a tree
of dependencies explains them: given the label, each voter depends on one other; a maximum spanning tree of
the pairs' conditional mutual information chooses which, and so correlated voters share their weight.
Expectation maximisation estimates accuracies and dependencies. Labelled documents keep their label, which
tells the sides apart and gives the prior; all others together weigh as much as they do at most.

A linear classifier is then trained on the posterior labels of a bounded sample, and scores whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, written
from .textkit import BLANK, rows, span_hash, trim

#: Rows of each label that the lexicon and the classifier are fitted on.
SAMPLE_ROWS = 4000
#: Terms of the lexicon at most, the least share of toxic documents that a term is in, and how much commoner it is there.
TERMS, SUPPORT, LIFT = 1024, 0.02, 20.0
THRESHOLD = 0.7
#: Common English insults by theme, threats, words that address the reader, and polite words.
LISTS = {
    "stupidity": ("idiot", "moron", "stupid", "dumb", "imbecile", "fool", "clown"),
    "worth": ("loser", "scum", "trash", "worthless", "pathetic", "filth", "vermin"),
    "disgust": ("disgusting", "revolting", "repulsive", "ugly", "gross"),
    "threat": ("kill", "murder", "hurt", "destroy", "hate"),
    "address": ("you", "your", "youre", "u"),
    "polite": ("please", "thanks", "thank", "sorry", "welcome"),
}
#: The voters, in order; the last two vote clean, the others toxic.
VOTERS = ("stupidity", "worth", "disgust", "threat", "several insults", "insulted reader", "words", "stems of 4", "stems of 5", "several terms", "many terms", "shouting", "exclamations", "masked", "no term", "polite")
_WORD = ~BLANK
_WORD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = False
_WORD[:33] = False



def _terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of all terms, the row and the kind of each (0 words, 1 and 2 stems of four and five bytes), and the number of words."""
    solid = _WORD[buf]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < len(buf)]
    first[edge] = solid[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    parts, owner, kind = [span_hash(buf, starts, ends, fold=True)], [row], [np.zeros(len(row), np.int8)]
    for j, k in ((1, 4), (2, 5)):
        long = ends - starts > k
        parts.append(span_hash(buf, starts[long], starts[long] + k, fold=True) ^ np.uint64(k))
        owner.append(row[long])
        kind.append(np.full(len(owner[-1]), j, np.int8))
    return np.concatenate(parts), np.concatenate(owner), np.concatenate(kind), len(starts)


def term_hash(word: str, prefix: int = 0) -> int:
    """The hash of a word, or of the first ``prefix`` bytes of a longer one, as the texts' terms have it."""
    data = np.frombuffer(word.encode()[: prefix or None], np.uint8)
    return int(span_hash(data, np.array([0]), np.array([len(data)]), fold=True)[0] ^ np.uint64(prefix))


_LISTED = {theme: np.sort(np.array([term_hash(w) for w in words], np.uint64)) for theme, words in LISTS.items()}
_INSULTS = np.sort(np.concatenate([_LISTED[t] for t in ("stupidity", "worth", "disgust")]))
_UPPER, _LETTER, _MASK = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = 1
_MASK[list(b"*#$%&@")] = True


def _sampled_terms(batches):
    """Distinct terms of each sampled text."""
    for batch in batches:
        for first, last, buf, offsets in rows(batch.column("text")):
            terms, row, _, _ = _terms(buf, offsets)
            pairs = np.unique(np.stack([row.astype(np.uint64), terms], 1), axis=0)
            toxic = batch.column("toxic").slice(first, last - first).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)), pa.array(toxic[pairs[:, 0].astype(np.int64)].astype(np.int32))], names=["term", "toxic"])


def lexicon(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms that mark toxic documents, of ``sample(text, toxic)``."""
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    counts = sample.select("text", "toxic").mapInArrow(_sampled_terms, "term long, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    lift = (F.col("t") / toxic) / ((F.col("n") - F.col("t") + 0.5) / clean)
    least = max(3, round(SUPPORT * toxic))
    kept = counts.where((F.col("t") >= least) & (lift >= min(LIFT, clean / toxic * least))).orderBy(F.desc("t"), "term").limit(TERMS)
    return np.sort(np.array([r.term for r in kept.select("term").collect()], np.int64).view(np.uint64))


@dataclass
class Found:
    """What a chunk of texts holds: lexicon hits as (row, term, count), words a row, and the votes that fire (rows, voters)."""

    n: int
    row: np.ndarray
    term: np.ndarray
    count: np.ndarray
    words: np.ndarray
    fired: np.ndarray


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _found(column: pa.Array, terms: np.ndarray):
    """A ``Found`` for each chunk of a string column; ``terms`` is the sorted lexicon."""
    for first, last, buf, offsets in rows(column):
        n = last - first
        hashes, row, kind, number = _terms(buf, offsets)
        word, owner = hashes[:number], row[:number]
        words = np.bincount(owner, minlength=n)
        fired = np.zeros((n, len(VOTERS)), bool)
        vote = lambda name, at: fired.__setitem__((at, VOTERS.index(name)), True)  # noqa: E731, B023
        for theme in ("stupidity", "worth", "disgust", "threat", "polite"):
            vote(theme, owner[np.isin(word, _LISTED[theme])])
        insult = np.flatnonzero(np.isin(word, _INSULTS))
        pairs = np.unique(np.stack([owner[insult].astype(np.uint64), word[insult]], 1), axis=0)
        vote("several insults", np.bincount(pairs[:, 0].astype(np.int64), minlength=n) > 1)
        reader = np.isin(word, _LISTED["address"])
        for back in (1, 2, 3):
            near = insult[insult >= back]
            vote("insulted reader", owner[near[reader[near - back] & (owner[near - back] == owner[near])]])
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(terms):
            place = np.searchsorted(terms, hashes)
            place[place == len(terms)] = 0
            good = terms[place] == hashes
            for k, name in enumerate(("words", "stems of 4", "stems of 5")):
                vote(name, row[good & (kind == k)])
            code, count = np.unique(row[good] * len(terms) + place[good], return_counts=True)
            held = code // len(terms), code % len(terms), count
        vote("several terms", np.bincount(held[0], minlength=n) > 1)
        vote("many terms", np.bincount(held[0], held[2], n) > 0.01 * np.maximum(words, 1))
        letters = _per_row(_LETTER[buf], offsets)
        vote("shouting", (letters >= 20) & (_per_row(_UPPER[buf], offsets) > 0.3 * letters))
        inside = np.ones(len(buf), bool)
        inside[offsets[1:][offsets[1:] > 0] - 1] = False
        for name, mark in (("exclamations", buf == 33), ("masked", _MASK[buf])):
            vote(name, _per_row(inside & mark & np.append(mark[1:], False), offsets) > 0)
        none = np.ones(n, bool)
        none[held[0]] = none[owner[insult]] = False
        vote("no term", none)
        yield Found(n, *held, words, fired)


def _codes(fired: np.ndarray) -> np.ndarray:
    return fired @ (1 << np.arange(fired.shape[1]))


def votes(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """``doc_id, code`` of every row: bit j of the code says whether voter j fires."""

    def run(batches):
        for batch in batches:
            codes = [_codes(f.fired) for f in _found(batch.column("text"), terms)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int64))], names=["doc_id", "code"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, code long")


@dataclass
class LabelModel:
    """Prior, each voter's parent in the tree (-1 at the root), and its firing rates (label, parent fires, voter)."""

    prior: float
    parent: np.ndarray
    rate: np.ndarray

    def likelihood(self, fired: np.ndarray) -> np.ndarray:
        """Logarithm of P(votes | label), (rows, labels)."""
        given = np.where(self.parent >= 0, fired[:, self.parent], False).astype(np.int64)
        out = []
        for label in (0, 1):
            p = self.rate[label][given, np.arange(fired.shape[1])]
            out.append(np.log(np.where(fired, p, 1 - p)).sum(1))
        return np.stack(out, 1)

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        x = self.likelihood(fired)
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + x[:, 1] - x[:, 0], -30, 30)))


def _pairs(fired: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """P(a, b) of every pair of voters, (2, 2, voters, voters), smoothed."""
    x = np.stack([~fired, fired]).astype(float)
    counts = np.einsum("ani,n,bnj->abij", x, weight, x, optimize=True) + 0.5
    return counts / counts.sum((0, 1))


def dependencies(fired: np.ndarray, weights: tuple[np.ndarray, np.ndarray], prior: float) -> np.ndarray:
    """The mutual information of every pair of voters given the label."""
    out = np.zeros((fired.shape[1],) * 2)
    for share, weight in zip((1 - prior, prior), weights, strict=True):
        p = _pairs(fired, weight)
        out += share * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum((0, 1))
    return out


def _tree(strength: np.ndarray) -> np.ndarray:
    """Parents in the maximum spanning tree, from voter 0."""
    n = len(strength)
    parent, best, source = np.full(n, -1), strength[0].copy(), np.zeros(n, np.int64)
    left = set(range(1, n))
    while left:
        j = max(left, key=lambda k: best[k])
        left.discard(j)
        parent[j] = source[j]
        closer = strength[j] > best
        best[closer], source[closer] = strength[j][closer], j
    return parent


def label_model(fired: np.ndarray, unlabelled: np.ndarray, clean: np.ndarray, toxic: np.ndarray, rounds: int = 40) -> LabelModel:
    """The model of vote patterns ``fired`` that so many unlabelled, clean and toxic documents have.

    Without labels of both kinds the side of the voters' names is the start, and the prior is estimated too.
    """
    known = clean.sum() > 0 and toxic.sum() > 0
    side = np.array([*[1] * (len(VOTERS) - 2), -1, -1])[: fired.shape[1]] if fired.shape[1] == len(VOTERS) else np.ones(fired.shape[1])
    share = min(1.0, (clean.sum() + toxic.sum()) / max(1.0, unlabelled.sum())) if known else 1.0
    unlabelled = unlabelled * share
    prior = (toxic.sum() + 1) / (clean.sum() + toxic.sum() + 2) if known else 0.1
    q = np.full(len(fired), prior) if known else np.clip(0.1 + 0.8 * (fired @ side > 0), 0.1, 0.9)
    model = None
    for step in range(rounds):
        used = np.zeros_like(unlabelled) if known and step == 0 else unlabelled
        weights = used * (1 - q) + clean, used * q + toxic
        parent = _tree(dependencies(fired, weights, prior)) if step < rounds // 2 else model.parent
        rate = np.empty((2, 2, fired.shape[1]))
        for label, weight in enumerate(weights):
            given = np.where(parent >= 0, fired[:, parent], False)
            for state in (0, 1):
                w = weight[:, None] * (given == bool(state))
                rate[label, state] = ((w * fired).sum(0) + 0.5) / (w.sum(0) + 1)
        model = LabelModel(float(prior), parent, rate)
        q = model.posterior(fired)
        if not known:
            prior = float(np.clip((unlabelled @ q + 1) / (unlabelled.sum() + 2), 1e-4, 0.5))
    return model


@dataclass
class ToxicityModel:
    terms: np.ndarray
    weights: np.ndarray
    bias: float


def _dense(f: Found, width: int) -> np.ndarray:
    """Features: hits of each term, of any term, and the votes."""
    x = np.zeros((f.n, width + 1 + len(VOTERS)), np.float32)
    x[f.row, f.term] = np.log1p(f.count)
    x[:, width] = np.log1p(np.bincount(f.row, f.count, f.n))
    x[:, width + 1 :] = f.fired
    return x


def _train(x: np.ndarray, q: np.ndarray, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    n = len(x)
    step = 4 / (np.square(x).sum(1).max() + 1)
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    for k in range(rounds):
        g = 1 / (1 + np.exp(-(x @ vw + vb))) - q
        nw, nb = vw - step * (x.T @ g / n + l2 * vw), vb - step * g.mean()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from the votes of all documents and the labels of those that aren't held out.

    A document with several labels counts as toxic if one says so. Without labels of both kinds the
    lexicon is empty and nothing scores as toxic.
    """
    usable = labels.where("toxic in (0, 1)")
    sample = written(labelled_sample(docs, usable, "toxic", SAMPLE_ROWS).select("text", "toxic"), "toxic-sample")
    terms = lexicon(sample)
    silent = ToxicityModel(terms, np.zeros(len(terms) + 1 + len(VOTERS)), -5.0)
    if not len(terms):
        return silent
    cast = written(votes(docs, terms), "votes")
    marked = usable.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # A code has one bit a voter: there are never more than 2 ** 16 of them.
    counts = cast.join(marked, "doc_id", "left").groupBy("code").agg(*[F.count(F.when(F.col("toxic").eqNullSafe(v), 1)).alias(n) for n, v in (("u", None), ("c", 0), ("t", 1))]).collect()
    code, *number = (np.array([r[k] for r in counts]) for k in range(4))
    fired = (code[:, None] >> np.arange(len(VOTERS)) & 1).astype(bool)
    model = label_model(fired, *(x.astype(float) for x in number))

    def features(batches):
        for batch in batches:
            for f in _found(batch.column("text"), terms):
                yield pa.RecordBatch.from_arrays([pa.array([_dense(f, len(terms)).astype(np.float16).tobytes()], pa.binary()), pa.array([_codes(f.fired).astype("<i4").tobytes()], pa.binary())], names=["x", "code"])
        trim()

    chunks = sample.select("text").mapInArrow(features, "x binary, code binary").collect()
    x = np.concatenate([np.frombuffer(c.x, np.float16).reshape(-1, len(terms) + 1 + len(VOTERS)) for c in chunks]).astype(np.float32)
    code = np.concatenate([np.frombuffer(c.code, "<i4") for c in chunks])
    return ToxicityModel(terms, *_train(x, model.posterior((code[:, None] >> np.arange(len(VOTERS)) & 1).astype(bool))))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from the whole text alone.

    Null and empty texts have no hit and get the score of a clean text. Null ids stay and aren't held
    out. Other columns are ignored; an empty table gives an empty table.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        width = len(m.terms)
        for batch in batches:
            scores = []
            for f in _found(batch.column("text"), m.terms):
                value = np.full(f.n, m.bias) + np.bincount(f.row, np.log1p(f.count) * m.weights[:width][f.term], f.n)
                value += m.weights[width] * np.log1p(np.bincount(f.row, f.count, f.n)) + f.fired @ m.weights[width + 1 :]
                scores.append(1 / (1 + np.exp(-value)))
            got = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
