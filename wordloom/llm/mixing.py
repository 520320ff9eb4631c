"""Mixing to target weights with soft domain membership.

A classifier that is fitted on the labelled table predicts each document's posterior over domains.
Every document gets a nonnegative rate: how often it is expected to be taken. The rates minimise the
squared distance between the expected token totals of the domains, sum(rate * tokens * posterior),
and the targets. They are found by accelerated projected gradient steps from rate 1. A step needs the
domains' totals only; each document's rate follows from its own tokens and posterior and the history of
those totals, so no rate is kept between steps.

One pass over all documents adds up tokens and posteriors by cell of the simplex of posteriors. The steps
are taken on the cells first, then on all documents, whose totals all tasks add up: as the cells are fine,
one or two such passes meet the tolerance. The outcome says whether they did.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import calibrate, softmax, train_ftrl
from .shared import labelled_sample, written
from .textkit import mix as mixed
from .textkit import rows, trim, word_hashes

WIDTH = 1 << 15
#: Labelled rows a domain that the classifier is fitted on.
SAMPLE_ROWS = 2000
#: The domains, in the order of their codes, and their target shares of all tokens.
TARGETS = {"low": 0.10, "good": 0.83, "toxic": 0.07}
#: Tokens taken, as a multiple of all tokens.
BUDGET = 1.25
#: Targets are met if no domain's share is off by more.
TOLERANCE = 1e-4
#: Steps end when they change no share by more than this; so do passes over all documents.
STILL = 1e-7
#: Cells of the simplex of posteriors, at most.
CELLS = 4096


def domain_code(quality, toxic):
    """The domain of a labelled row: toxic before quality. Null if neither label is known."""
    return F.when(toxic == 1, 2).when(quality == 1, 1).when(quality == 0, 0)


@dataclass
class DomainModel:
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    prior: np.ndarray


def _features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique((words >> np.uint64(49)).astype(np.int64), return_counts=True)
    return index, np.log1p(count)


def _weigh(index: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = value * idf[index]
    return value / max(np.sqrt(value @ value), 1e-12)


def fit(docs: DataFrame, labels: DataFrame, domains: int = len(TARGETS)) -> DomainModel:
    """A multinomial classifier of hashed words. Domains without labelled rows get next to no posterior; without any, all are alike."""
    coded = labels.select("doc_id", domain_code(F.col("quality"), F.col("toxic")).alias("domain"))
    sample = labelled_sample(docs, coded, "domain", SAMPLE_ROWS).select("text", "domain")

    def sampled(batches):
        for batch in batches:
            for first, last, buf, offsets in rows(batch.column("text")):
                words, at = word_hashes(buf, offsets)
                found = [_features(words[at[i] : at[i + 1]]) for i in range(last - first)]
                yield pa.RecordBatch.from_arrays([batch.column("domain").slice(first, last - first), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], names=["domain", "index", "value"])

    got = sorted((r.domain, bytes(r["index"]), bytes(r.value)) for r in sample.mapInArrow(sampled, "domain int, index binary, value binary").collect())
    if not got:
        return DomainModel(np.ones(WIDTH), np.zeros((WIDTH + 1, domains)), 1.0, np.full(domains, 1 / domains))
    got = [got[i] for i in np.random.default_rng(3).permutation(len(got))]
    x = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, i, v in got]
    y = np.array([d for d, _, _ in got])
    df = np.zeros(WIDTH)
    for i, _ in x:
        df[i] += 1
    idf = np.log((1 + len(x)) / (1 + df)) + 1
    x = [(i, _weigh(i, v, idf)) for i, v in x]
    seen = len(x) - len(x) // 5
    weights = train_ftrl(x[:seen], np.eye(domains)[y[:seen]], WIDTH)
    logits = np.array([v @ weights[i] + weights[-1] for i, v in x[seen:]]).reshape(-1, domains)
    # The sample is balanced; the corpus has the labelled table's shares.
    whole = {r.domain: r["count"] for r in coded.where("domain is not null").groupBy("domain").count().collect()}
    drawn = np.bincount(y, minlength=domains) + 0.5
    share = np.array([whole.get(d, 0) for d in range(domains)]) + 0.5
    return DomainModel(idf, weights, calibrate(logits, y[seen:]), share / share.sum() / (drawn / drawn.sum()))


def _soft(column: pa.Array, m: DomainModel):
    """For each chunk of texts: first row, number of words and posterior of each row."""
    for first, last, buf, offsets in rows(column):
        words, at = word_hashes(buf, offsets)
        out = np.empty((last - first, m.weights.shape[1]))
        for i in range(last - first):
            index, value = _features(words[at[i] : at[i + 1]])
            out[i] = (_weigh(index, value, m.idf) @ m.weights[index] + m.weights[-1]) / m.temperature + np.log(m.prior)
        yield first, np.diff(at), softmax(out)
    trim()


def posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """``doc_id, tokens, posterior``: words of the whole text, and array<double> over domains."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for first, tokens, p in _soft(batch.column("text"), held.value):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(p)), pa.array(tokens.astype(np.int64)), lists], names=["doc_id", "tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def _rates(p: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rates and look-ahead rates after the steps in ``history`` (one scaled gradient over domains each), from rate 1."""
    rate = ahead = np.ones(len(p))
    for k, g in enumerate(history):
        new = np.maximum(0.0, ahead - p @ g)
        ahead = new + k / (k + 3) * (new - rate)
        rate = new
    return rate, ahead


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("tokens").to_numpy().astype(float), batch.column("posterior").flatten().to_numpy().reshape(-1, k)


@dataclass
class Rates:
    """The scaled gradients of all steps, the domains' expected totals as shares of the target total, and whether they meet the targets."""

    history: np.ndarray
    reached: np.ndarray
    met: bool


def levels(domains: int) -> int:
    """Steps of each posterior, so that the simplex has ``CELLS`` cells at most."""
    n = 1
    while comb(n + 2 * domains - 1, domains - 1) <= CELLS and n < 1 << 10:
        n += 1
    return n


def _cells(batches, k: int):
    """Tokens, and tokens times posterior, of each cell of the posteriors."""
    n = levels(k)
    held: dict[bytes, np.ndarray] = {}
    for batch in batches:
        t, p = _arrays(batch, k)
        cell, back = np.unique(np.rint(p * n).astype(np.int16), axis=0, return_inverse=True)
        sums = np.zeros((len(cell), k + 1))
        np.add.at(sums, back.ravel(), np.column_stack([t, p * t[:, None]]))
        for key, x in zip(cell, sums, strict=True):
            held[key.tobytes()] = held.get(key.tobytes(), 0) + x
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array([x[i] for x in held.values()], pa.float64()) for i in range(k + 1))], names=["cell", *(f"x{i}" for i in range(k + 1))])


def _steps(t: np.ndarray, p: np.ndarray, target: np.ndarray, step: float) -> np.ndarray:
    """Scaled gradients of projected gradient steps on weighted posteriors, until the shares meet the target or stand still."""
    rate = ahead = np.ones(len(p))
    history, last, total = [], None, target.sum()
    while True:
        now = (t * rate) @ p
        if np.abs(now - target).max() <= TOLERANCE / 10 * total or last is not None and np.abs(now - last).max() <= STILL * total:
            return np.array(history).reshape(-1, p.shape[1])
        g, k = step * ((t * ahead) @ p - target), len(history)
        new = np.maximum(0.0, ahead - p @ g)
        ahead = new + k / (k + 3) * (new - rate)
        rate, last = new, now
        history.append(g)


def fit_rates(soft: DataFrame, shares: list[float], budget: float = 1.0) -> Rates:
    """Rates for ``soft(tokens, posterior)``; the target total is ``budget`` times all tokens.

    In the scale of each document's tokens the least-squares problem has the Hessian M = sum(tokens *
    posterior * posterior'), a matrix over domains; its largest eigenvalue sets the step. Targets that no
    nonnegative rates reach end when the steps change nothing more, and aren't met.
    """
    k = len(shares)
    names = [f"x{i}" for i in range(k + 1)]
    parts = soft.select("tokens", "posterior").mapInArrow(lambda it: _cells(it, k), f"cell binary, {', '.join(f'{n} double' for n in names)}")
    cells = np.array(sorted(tuple(r[n] for n in names) for r in parts.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names]).collect())).reshape(-1, k + 1)
    cells = cells[cells[:, 0] > 0]
    if not len(cells):
        return Rates(np.zeros((0, k)), np.zeros(k), False)
    t, p = cells[:, 0], cells[:, 1:] / cells[:, :1]
    target = np.array(shares) / sum(shares) * t.sum() * budget
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p)[-1]
    history, last = _steps(t, p, target, step), None

    def reached(past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def sums(batches):
            at, ahead = np.zeros(k), np.zeros(k)
            for batch in batches:
                t, p = _arrays(batch, k)
                rate, look = _rates(p, past)
                at += (t * rate) @ p
                ahead += (t * look) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, *ahead)], names=[f"x{i}" for i in range(2 * k)])

        one = soft.select("tokens", "posterior").mapInArrow(sums, ", ".join(f"x{i} double" for i in range(2 * k))).agg(*[F.sum(f"x{i}") for i in range(2 * k)]).first()
        return np.array(one[:k]), np.array(one[k:])

    while True:
        now, look = reached(history)
        met = bool(np.abs(now - target).max() <= TOLERANCE * target.sum())
        if met or last is not None and np.abs(now - last).max() <= TOLERANCE / 10 * target.sum():
            return Rates(history, now / target.sum(), met)
        history, last = np.vstack([history, step * (look - target)]), now


def _copies(rate: np.ndarray, ids: list) -> np.ndarray:
    """Rates rounded up or down by a hash of the id, so that their expectation is the rate."""
    known = np.array([x is not None for x in ids], bool)
    code = np.array([x if x is not None else 0 for x in ids], np.int64).view(np.uint64)
    draw = (mixed(code + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(11)).astype(float) / float(1 << 53)
    return (np.floor(rate) + (np.where(known, draw, 0.5) < rate - np.floor(rate))).astype(np.int32)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """``doc_id, tokens, p_<domain>..., rate, copies, met`` of every row; ``met`` says whether the expected shares meet the targets.

    Null and empty texts have no tokens and don't count in the totals; their rate is what their
    posterior gives. Rows that repeat have the same rate. A null id is rounded at one half. Other
    columns are ignored; an empty table gives an empty table. Targets that no nonnegative rates reach
    are met as nearly as least squares can.
    """
    soft = written(posteriors(docs, fit(docs, labels, len(targets))), "posteriors")
    fitted = fit_rates(soft, list(targets.values()), budget)
    names = [f"p_{d}" for d in targets]

    def run(batches):
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, len(names))
            rate = _rates(p, fitted.history)[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tokens"), *(pa.array(x) for x in p.T), pa.array(rate), pa.array(_copies(rate, batch.column("doc_id").to_pylist())), pa.array(np.full(len(rate), fitted.met))], names=["doc_id", "tokens", *names, "rate", "copies", "met"])

    return soft.mapInArrow(run, f"doc_id long, tokens long, {', '.join(f'`{n}` double' for n in names)}, rate double, copies int, met boolean")


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, each as often as its copies say; all columns stay. The texts aren't shuffled: rates are worked out again where they are."""
    model = fit(docs, labels, len(targets))
    soft = written(posteriors(docs, model).select("tokens", "posterior"), "posteriors")
    history = fit_rates(soft, list(targets.values()), budget).history
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, _, p in _soft(batch.column("text"), held.value):
                copies = _copies(_rates(p, history)[0], ids[first : first + len(p)])
                yield batch.take(pa.array(np.repeat(np.arange(first, first + len(p)), copies)))

    return docs.mapInArrow(run, docs.schema)
