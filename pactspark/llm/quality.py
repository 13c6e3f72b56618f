"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on text features;
the training minimises the non-negative unbiased risk
``prior * E_p[l(g, +)] + max(0, E_u[l(g, -)] - prior * E_p[l(g, -)])``
under an estimated class prior. Labelled negatives are never read. The prior comes
from positives and unlabelled text alone: a scorer that tells the two apart is
trained on half of the positives, and the prior is the least ratio of the shares of
unlabelled texts and of the other positives above a threshold, where its bound is
best. Positives come to the driver as a bounded sample. Unlabelled texts start the
training as a sample; the prior and the last steps of the training take all of them,
as sums over partitions.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, save, small_batches

MAX_LABELLED = 20_000  # positives that the model is fitted on, about
START = 20_000  # unlabelled texts that start the training, about
STEPS = 8  # steps of the training that take all unlabelled texts
HIDDEN = 24
EPOCHS = 60
BATCH = 512
RATE = 0.01
DECAY = 1e-4
BINS = 1000
LEAST_POSITIVES = 20  # with fewer the prior is taken for one half
N_FEATURES = 25


def _classes() -> np.ndarray:
    """One row per code point below 256 and one for the rest: the class sums that features use."""
    out = np.zeros((257, 10))
    for c in range(256):
        x = chr(c)
        out[c] = (x.isalpha(), x.isupper(), x.isdigit(), x in " \t", x in "\r\n", x == "!", x in "#$%&*@^~<>{}[]\\=+_/", x == "|", x in ".,", x in "?;:'\"()-")
    out[256, 0] = 1
    return out


_CLASSES = _classes()


def features(text: str | None) -> np.ndarray:
    """Of the whole text; an empty text has zeros."""
    text = text or ""
    n = len(text)
    words = text.split()
    if not words:
        return np.zeros(N_FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    histogram = np.bincount(np.minimum(codes, 256), minlength=257)
    letters, upper, *rest = histogram @ _CLASSES
    p = histogram[histogram > 0] / n
    m = len(words)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, m)
    tri = max(m - 2, 1)
    lines = [x for x in text.split("\n") if x.strip()]
    top = [x for _, x in counts.most_common(3)]
    body = text.encode("utf-8", "surrogatepass")
    same = [sum(map(eq, words, words[k:])) / m for k in (1, 2, 3, 4)]
    return np.array(
        [
            np.log1p(n), upper / max(letters, 1), letters / n, *(x / n for x in rest), -(p * np.log2(p)).sum(),
            lengths.mean(), lengths.std(), len(counts) / m, np.log(len(counts)) / np.log(m + 1), top[0] / m, sum(top) / m,
            len(set(zip(words, words[1:], words[2:]))) / tri, *same, len(set(lines)) / len(lines), len(zlib.compress(body, 1)) / (len(body) + 16),
        ]
    )


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float = 0.5

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.tanh(self.scaled(x) @ a + b) @ c + d)[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sums(weights: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """Rows, the sum of s, and its gradient, over rows z: s is the loss of calling a row negative, 1 - s that of calling it positive."""
    a, b, c, d = weights
    h = np.tanh(z @ a + b)
    s = _sigmoid((h @ c + d)[:, 0])
    dg = (s * (1 - s))[:, None]
    dh = dg * c.T * (1 - h * h)
    return np.concatenate([[len(z), s.sum()], (z.T @ dh).ravel(), dh.sum(0), (h.T @ dg).ravel(), dg.sum(0)])


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and the step's direction, from sums; where the negative part is below zero the step undoes that instead."""
    p, u = positive[1:] / positive[0], unlabelled[1:] / unlabelled[0]
    rest = u[0] - prior * p[0]
    if rest >= 0:
        return prior * (1 - p[0]) + rest, u[1:] - 2 * prior * p[1:]
    return prior * (1 - p[0]), prior * p[1:] - u[1:]


class _Adam:
    def __init__(self, weights: list[np.ndarray]):
        self.weights, self.t = weights, 0
        n = sum(w.size for w in weights)
        self.m1, self.m2 = np.zeros(n), np.zeros(n)
        self.decay = np.concatenate([np.full(w.size, DECAY if w.ndim == 2 else 0.0) for w in weights])

    def step(self, gradient: np.ndarray, rate: float) -> None:
        gradient = gradient + self.decay * np.concatenate([w.ravel() for w in self.weights])
        self.t += 1
        self.m1 += 0.1 * (gradient - self.m1)
        self.m2 += 0.001 * (gradient * gradient - self.m2)
        move, at = rate * (self.m1 / (1 - 0.9**self.t)) / (np.sqrt(self.m2 / (1 - 0.999**self.t)) + 1e-8), 0
        for w in self.weights:
            w -= move[at : at + w.size].reshape(w.shape)
            at += w.size


def start(both: np.ndarray, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    n = both.shape[1]
    return Model(both.mean(0), both.std(0) + 1e-6, [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, times: np.ndarray | None = None, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Minimise the non-negative risk with the sigmoid loss, by Adam on mini-batches; ``times`` says how often each unlabelled row stands.

    Without a prior, tell positives from unlabelled rows.
    """
    rng = np.random.default_rng(seed)
    model = start(np.vstack([positive, unlabelled]), seed)
    model.prior = prior or 0.5
    zp, zu = model.scaled(positive), model.scaled(unlabelled)
    adam, share = _Adam(model.weights), None if times is None else times / times.sum()
    steps = max(1, len(zu) // BATCH)
    for epoch in range(epochs):
        order = rng.permutation(len(zu)) if share is None else rng.choice(len(zu), len(zu), p=share)
        for part in np.array_split(order, steps):
            p, u = sums(model.weights, zp[rng.integers(0, len(zp), len(part))]), sums(model.weights, zu[part])
            direction = u[2:] / u[0] - p[2:] / p[0] if prior is None else risk(p, u, prior)[1]
            adam.step(direction, RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4)
    return model


def best_ratio(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from counts of scores by ascending bins: the ratio of shares above the threshold at which its upper bound is least."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (positive, unlabelled))
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (n_p**-0.5 + n_u**-0.5)
    used = above_p > 0
    bound = (above_u[used] + 1.01 * slack) / above_p[used]
    k = int(np.argmin(bound))
    return float(np.clip((above_u[used] / above_p[used])[k], 0.02, 0.98))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            rows = [features(x).tolist() for x in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*part.schema.names[:-1], "x"])


def held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def featurise(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns to keep, or all), ``key`` (doc_id), ``held_out`` and ``x`` (features of the whole text) of each row, as a table."""
    small_batches(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    rows = docs.select(row.alias("row"), F.col("doc_id").try_cast("long").alias("key"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return save(rows.mapInArrow(released(_featured), f"row {rows.schema['row'].dataType.simpleString()}, key long, held_out boolean, x array<double>"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(rows: DataFrame, of) -> np.ndarray:
    """The sum of ``of(x)`` over all batches of rows; few numbers a task come to the driver."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [of(_matrix(b.column(0))) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tolist()], pa.list_(pa.float64()))], ["v"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(0)).sum(0) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tolist()], pa.list_(pa.float64()))], ["v"])

    found = rows.select("x").mapInArrow(released(first), "v array<double>").repartition(16).mapInArrow(released(second), "v array<double>").collect()
    return np.sum(sorted(r["v"] for r in found), axis=0)


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, started_on: int = START, steps: int = STEPS) -> Model:
    """Fit on rows of featurise outside the held-out fold; held-out labels are never read.

    Positives are the ids whose labels are all 1; ids with another or no label, null
    ids and null labels are none. Null texts count as empty ones, and of a labelled
    id that is repeated one row is taken. Without positives or without
    documents every score is one half. ``max_labelled`` bounds the positives and ``started_on`` the unlabelled
    rows that come to the driver, as features of N_FEATURES numbers.
    """
    web = rows.where("NOT held_out AND key IS NOT NULL").select("key", "x")
    known = labels.select(F.col("doc_id").try_cast("long").alias("key"), F.col(label).try_cast("int").alias("y")).where("key IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("key")))
    good = known.groupBy("key").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo = 1 AND hi = 1").select("key")
    n_good, n_web = good.count(), web.count()

    def some(df: DataFrame, n: int, most: int, *by: str) -> DataFrame:
        """About ``most`` of n rows, by a hash, so that partitions do not matter."""
        return df if n <= most else df.where(F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(2**31)) < int(most / n * 2**31))

    # About max_labelled ids at most, hence the broadcast.
    positive = web.join(F.broadcast(some(good, n_good, max_labelled, "key")), "key").groupBy("key").agg(F.min("x").alias("x")).select("x", F.lit(0).cast("long").alias("n"))
    unlabelled = some(web, n_web, started_on, "key", "x").groupBy("key", "x").agg(F.count("*").alias("n")).select("x", "n")
    found = positive.unionByName(unlabelled).toPandas()
    n = found["n"].to_numpy()
    if not (n == 0).any() or not (n > 0).any():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)])
    x = np.array(found["x"].tolist(), dtype=np.float64)
    order = np.lexsort((*x.T, n))  # the order in which tasks ended doesn't matter
    x, n = x[order], n[order]
    p, u, times = x[n == 0], x[n > 0], n[n > 0]
    prior = 0.5
    if len(p) >= LEAST_POSITIVES:
        scorer = fit(p[::2], u, None, times)

        def counted(z: np.ndarray) -> np.ndarray:
            return np.histogram(scorer.score(z), BINS, (0, 1))[0].astype(float)

        prior = best_ratio(counted(p[1::2]), _totals(web, counted))
    model = fit(p, u, prior, times)
    zp, adam = model.scaled(p), _Adam(model.weights)
    for _ in range(steps):
        adam.step(risk(sums(model.weights, zp), _totals(web, lambda z: sums(model.weights, model.scaled(z))), prior)[1], 1e-3)
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rounded, as the last digits go by a row's place in its batch.
            s = model.score(_matrix(batch.column(batch.num_columns - 1))).round(12) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_documents(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of featurise.

    Null texts are scored as empty ones; repeated rows stay; other columns are
    ignored and never inputs; an id that is no number becomes null.
    """
    scored = rows.select(F.col("key").alias("doc_id"), "held_out", "x").mapInArrow(released(_scored(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(rows: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose text scores ``least`` or more, with all the columns that featurise kept."""
    schema = f"row {rows.schema['row'].dataType.simpleString()}, score double"
    return rows.select("row", "x").mapInArrow(released(_scored(model)), schema).where(F.col("score") >= least).select("row.*")
