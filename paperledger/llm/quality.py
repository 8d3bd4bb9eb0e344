"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of hashed n-grams: words, pairs of words, triples of bytes, and n-grams of one word
repeated, for n of 2, 4, 8 and so on. Each indicator is scaled by its log-count ratio between the classes, a row is scaled to length
1, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve over the margins of held-back
folds turns margins into scores, with the classes in the proportion of all labels that may be learnt from.

The model is fitted on the driver from a bounded sample: of each class, the ``PER_CLASS`` labelled rows whose ids have
the least hashes, and of these, in the same order and each class for itself, as many as have ``PER_CLASS_FEATURES``
features in all, the first whatever its size; all are read whole. Both bounds are parameters of ``fit``, and neither
rests on the files' layout. The model is ``1 << BITS`` weights. Every text is scored whole. The sample lies in memory
that goes back to the system after the fit.

Defined cases: a null or empty text has no features, and its margin is the bias alone; without labels of both classes
every score is the share of label 1 among the labels that there are, or 0.5 without any; repeated labels count each;
null labels do not count; rows that repeat a doc_id are scored each; very long texts pass in slices, so that a worker
holds a few bytes for each of their words; ties of score are equal; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch, wordhash

BITS = 18
SAME = 16
PER_CLASS = 3000
PER_CLASS_FEATURES = 12_000_000
SMOOTH = 1.0
COST = 1.0
EPOCHS = 20
FOLDS = 3
BLOCK = 4 << 20


@dataclass(frozen=True)
class Model:
    """``ratio``: log-count ratios; ``weight``: the linear model over scaled rows; ``bias``, ``slope``, ``shift``."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float


_MASK = np.uint64((1 << BITS) - 1)


def _words(h: np.ndarray) -> np.ndarray:
    return np.maximum((h & _MASK).astype(np.int32), SAME)


def _pairs(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _words(wordhash.mix(h[:-1] * wordhash.GOLDEN + h[1:]))


def _triples(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.uint32)
    return np.maximum(((d[:-2] | d[1:-1] << 8 | d[2:] << 16) * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int32), SAME)


def _repeats(most: int) -> np.ndarray:
    """Features of a word that stands ``most`` times in a row, at most."""
    return np.arange(1, min(int(most).bit_length(), SAME), dtype=np.int32)


def _of_long(data: np.ndarray) -> np.ndarray:
    """The features of one long text, marked slice by slice."""
    h = wordhash.words(data, np.array([0, len(data)]), lower=False)[0]
    marked = np.zeros(1 << BITS, bool)
    step = wordhash.SLICE
    for s in range(0, len(h), step):
        marked[_words(h[s : s + step])] = True
        marked[_pairs(h[s : s + step + 1])] = True
    for s in range(0, len(data) - 2, step):
        marked[_triples(data[s : s + step + 2])] = True
    new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    marked[_repeats(np.diff(np.r_[new, len(h)]).max(initial=1))] = True
    return np.flatnonzero(marked).astype(np.int32)


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each text's row and its sorted distinct features."""
    for a, b, data, offsets in wordhash.chunks(texts):
        if b - a == 1 and len(data) > wordhash.CHUNK:
            yield a, _of_long(data)
            continue
        h, first, _, _ = wordhash.words(data, offsets, lower=False)
        one, two, three = _words(h), _pairs(h), _triples(data)
        # How many of a word's repeats stand in a row: 1 for a run's first word, which no other feature is.
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][first[:-1] < len(h)]] = False
        number = np.arange(len(h))
        run = number - np.maximum.accumulate(np.where(again, 0, number)) + 1 if len(h) else number
        for i in range(b - a):
            w, e = first[i], first[i + 1]
            s, t = offsets[i], offsets[i + 1]
            yield a + i, np.unique(np.concatenate([_repeats(run[w:e].max(initial=1)), one[w:e], two[w : max(w, e - 1)], three[s : max(s, t - 2)]]))


def stored(arrays: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Copies of ``arrays``, laid one after another into anonymous maps of ``BLOCK`` bytes or more. A map is given back when
    nothing refers to it; thousands of small arrays by themselves would leave their memory with the process."""
    block, at = np.empty(0, np.uint8), 0
    for a in arrays:
        if at + a.nbytes > len(block):
            block, at = np.frombuffer(mmap.mmap(-1, max(BLOCK, a.nbytes), flags=mmap.MAP_PRIVATE), np.uint8), 0
        own = block[at : at + a.nbytes].view(a.dtype)
        own[:] = a
        yield own
        at += -(-a.nbytes // 8) * 8


def log_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {k: np.full(1 << BITS, SMOOTH) for k in (1, -1)}
    for r, c in zip(rows, y, strict=True):
        counts[int(c)][r] += 1  # a row's features are distinct
    return np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))


def _scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[row]
    return x / (np.sqrt((x * x).sum()) or 1.0)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """The hinge-loss model's weights and bias; the bias is the weight of a constant feature."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float((v * v).sum()) for v in values]) + 1.0
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gap = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gap / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with softened labels."""
    target = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y < 0).sum()))
    p = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (s - target)) + 1e-3 * (p - [1.0, 0.0])
        h = (x * (weight * s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, share: float) -> Model:
    """``y`` is 1 or -1; ``share``: that of label 1 among all labels."""

    def fit(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own, labels = [rows[i] for i in keep], y[keep]
        ratio = log_ratio(own, labels)
        each = {k: COST * len(keep) / (2 * max((labels == k).sum(), 1)) for k in (1, -1)}
        w, bias = dual_coordinate_descent(own, list(stored(_scaled(r, ratio) for r in own)), labels, np.array([each[int(c)] for c in labels]))
        return ratio, w, bias

    fold = np.random.default_rng(5).permutation(len(rows)) % FOLDS
    margin = np.zeros(len(rows))
    for f in range(FOLDS):
        ratio, w, bias = fit(np.flatnonzero(fold != f))
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i]] @ _scaled(rows[i], ratio) + bias
    weight = np.where(y > 0, share / (y > 0).sum(), (1 - share) / (y < 0).sum()) * len(rows)
    slope, shift = logistic(margin, y, weight)
    return Model(*fit(np.arange(len(rows))), slope, shift)


def _featured(docs: DataFrame) -> DataFrame:
    """label, the hash of the id and each text's features as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for _, r in features(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["label", "by", "row"])

    return docs.select("label", "by", "text").mapInArrow(run, "label int, by long, row binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    may_learn: Column | None = None,
    per_class: int = PER_CLASS,
    per_class_features: int = PER_CLASS_FEATURES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """A model of ``labels[label]`` (0 or 1). ``may_learn``: a condition on ``labels``."""
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    own = (own if may_learn is None else own.where(may_learn)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / (sum(counts.values()) or 1) if counts else 0.5
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    sample = own.where("label = 1").orderBy(*by_hash).limit(per_class).unionAll(own.where("label = 0").orderBy(*by_hash).limit(per_class))
    sample = sample.withColumn("by", F.xxhash64("doc_id"))
    # At most two times per_class ids: a fixed bound.
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    chosen = scratch.table(_featured(texts.join(F.broadcast(sample), "doc_id")).withColumn("n", F.length("row") / 4), "features")
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("by", "row")) - F.col("n")
    # Written, it comes in a job for each of its few files, not for each partition of the shuffle.
    held = scratch.table(chosen.withColumn("before", upto).where(F.col("before") <= per_class_features).select("label", "row"), "sample")
    y = []

    def sent() -> Iterator[np.ndarray]:
        for r in held.toLocalIterator():
            y.append(1 if r.label else -1)
            yield np.frombuffer(r.row, np.int32)

    rows = list(stored(sent()))
    signs = np.array(y)
    for made in (chosen, held):
        scratch.drop(made)
    if not len(rows) or not (signs > 0).any() or not (signs < 0).any():
        odds = np.clip(share, 1e-6, 1 - 1e-6)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, float(np.log(odds / (1 - odds))))
    order = np.lexsort((signs, [len(r) for r in rows], [int(r.sum(dtype=np.int64)) for r in rows]))
    return fit_rows([rows[i] for i in order], signs[order], share)


def _scorer(model: Model):
    """From a string array to scores."""
    scale, square = (model.weight * model.ratio), model.ratio**2

    def scores(texts: pa.Array) -> np.ndarray:
        margin = np.full(len(texts), model.bias)
        for i, row in features(texts):
            margin[i] += scale[row].sum() / (np.sqrt(square[row].sum()) or 1.0)
        return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the chance of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; ids of remainder 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def drop_low(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score below ``least``, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)
