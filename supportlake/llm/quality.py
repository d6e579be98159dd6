"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has two features, its letters and its shape (case, marks). A feature is a row number
of a fixed table. Each row has a random index vector of few +1/-1; a feature's context vector is
the sum of the index vectors of what stands near it, over all documents. A document is the
frequency-weighted mean of the context vectors of its words and of its shapes. A two-layer
network reads that, and one temperature, fitted on rows that training did not see, turns its
output into a probability.

Tasks send sums of the table's size, no text; the table, ROWS x DIMS numbers, is the same size
for any corpus. The network is fitted on a bounded sample of labelled rows (SAMPLE), context
vectors and counts on all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map, lean, materialize

#: Rows of the table: the first SHAPES for shapes, the others for words.
SHAPE_BITS = 10
ROWS, SHAPES = 8192, 1 << SHAPE_BITS
DIMS = 128
NONZERO = 2
NEAR = 2
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 20_000
HIDDEN = 64
EPOCHS = 40
SEED = 11
KEPT_FROM = 0.3
CACHED_WORDS = 400_000

_CAPITALS, _SMALL, _DIGITS = range(65, 91), (*range(97, 123), *range(128, 256)), range(48, 58)
_NO_LETTERS = bytes(b for b in range(256) if b not in _CAPITALS and b not in _SMALL)
_LOWER = bytes(b + 32 if b in _CAPITALS else b for b in range(256))
_KINDS = bytes(
    65 if b in _CAPITALS else 97 if b in _SMALL else 48 if b in _DIGITS else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def index_vectors(rows: int = ROWS, dims: int = DIMS, seed: int = SEED):
    """Places and signs of each row's non-zero parts."""
    draw = np.random.default_rng(seed)
    return (
        draw.integers(0, dims, (rows, NONZERO)),
        draw.choice(np.array([-1.0, 1.0]), (rows, NONZERO)),
    )


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters, digits and marks, each run once; marks as they are."""
    return _RUN.sub(rb"\1", word.translate(_KINDS))


class _Known(dict):
    """Word -> row numbers of its letters and its shape in one number; learns what it is asked."""

    def __missing__(self, word: bytes) -> int:
        letters = word.translate(_LOWER, _NO_LETTERS)
        a = SHAPES + zlib.crc32(letters) % (ROWS - SHAPES)
        code = self[word] = a * SHAPES + zlib.crc32(shape(word)) % SHAPES
        return code


class Features:
    """Row numbers of the words and shapes of texts."""

    def __init__(self):
        self.known = _Known()

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        words = text.split()
        both = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return both >> SHAPE_BITS, both & (SHAPES - 1)


def context_sums(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(context vectors, counts) of all features over all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, count = np.zeros(ROWS * DIMS), np.zeros(ROWS, np.int64)
        features = Features()
        held: list[tuple] = []
        size = 0

        def add() -> None:
            if held:
                # Documents are apart by more than a window.
                gap = np.full(NEAR, -1)
                w, s = (
                    np.concatenate([p for d in held for p in (d[k], gap)]) for k in (0, 1)
                )
                ok = w >= 0
                count[:] += np.bincount(w[ok], minlength=ROWS)
                count[:] += np.bincount(s[ok], minlength=ROWS)
                _add_contexts(total, w, s, places, signs)
                held.clear()

        for batch in batches:
            for text in batch.column(0):
                one = features.of(text.as_py() or b"")
                held.append(one)
                size += one[0].size
                if size > 500_000:
                    add()
                    size = 0
        add()
        at = np.flatnonzero(count)
        rows = total.reshape(ROWS, DIMS).astype("<f4")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at, pa.int64()), pa.array(count[at]),
                pa.array([rows[i].tobytes() for i in at], pa.binary()),
            ],
            ["row", "n", "vector"],
        )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for row, n, vector in zip(*(batch.column(c).to_pylist() for c in range(3))):
                v = np.frombuffer(vector, "<f4").astype(np.float64)
                sums[row] = sums[row] + v if row in sums else v
                counts[row] = counts.get(row, 0) + n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int64()), pa.array([counts[r] for r in sums], pa.int64()),
                pa.array([sums[r].astype("<f4").tobytes() for r in sums], pa.binary()),
            ],
            ["row", "n", "vector"],
        )

    kind = "row long, n long, vector binary"
    parts = arrow_map(docs.select(F.col("text").cast("binary")), lean(task), kind)
    found = arrow_map(parts.repartition("row"), add_up, kind).toArrow()
    vectors, counts = np.zeros((ROWS, DIMS)), np.zeros(ROWS, np.int64)
    for row, n, v in zip(*(found.column(c).to_pylist() for c in range(3))):
        vectors[row], counts[row] = np.frombuffer(v, "<f4"), n
    return vectors, counts


def _add_contexts(total: np.ndarray, words: np.ndarray, shapes: np.ndarray, places, signs) -> None:
    """Adds each feature's neighbours' index vectors to its row of `total` (flat). Negative
    numbers stand between documents."""
    pairs = [(words, shapes), (shapes, words)]
    for step in range(1, NEAR + 1):
        for x in (words, shapes):
            pairs += [(x[:-step], x[step:]), (x[step:], x[:-step])]
    for a, b in pairs:
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        for k in range(NONZERO):
            total += np.bincount(a * DIMS + places[b, k], signs[b, k], total.size)


@dataclass
class Table:
    """Unit context vectors and pooling weights of all features."""

    vectors: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, counts: np.ndarray) -> Table:
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
        weights = np.zeros(ROWS)
        for part in (slice(0, SHAPES), slice(SHAPES, ROWS)):
            share = counts[part] / max(1, counts[part].sum())
            weights[part] = 1e-3 / (1e-3 + share)
        return Table(unit.astype(np.float32), weights.astype(np.float32))

    def pool(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * DIMS + 1, np.float32)
        for k, x in enumerate((words, shapes)):
            if x.size:
                n = np.bincount(x, minlength=ROWS)
                at = np.flatnonzero(n)
                w = n[at] * (self.weights[at] if k == 0 else 1.0)
                out[k * DIMS : (k + 1) * DIMS] = w @ self.vectors[at] / max(w.sum(), 1e-9)
        out[-1] = np.log1p(words.size) / 10
        return out


def pooled(docs: DataFrame, shared, columns: list[str]) -> DataFrame:
    """`columns` of `docs` and the pooled vector (binary float32)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            vectors = [
                shared.value.pool(*features.of(t.as_py() or b"")).tobytes()
                for t in batch.column(batch.num_columns - 1)
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(len(columns))), pa.array(vectors, pa.binary())],
                [*columns, "vector"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(
        docs.select(*columns, F.col("text").cast("binary")), lean(task), f"{schema}, vector binary"
    )


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.logits(x) / self.temperature, -60, 60)
        return 1 / (1 + np.exp(-z))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """Two layers by Adam on four fifths of the rows, the temperature on the others."""
    draw = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    order = draw.permutation(len(x))
    held, rows = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[rows].mean(0), x[rows].std(0) + 1e-3
    net = Network(
        mean, scale, draw.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), 0.0,
    )
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, step = (x - mean) / scale, 0
    for _ in range(EPOCHS):
        shuffled = draw.permutation(rows)
        for at in range(0, len(shuffled), 128):
            part = shuffled[at : at + 128]
            a = z[part] @ params[0] + params[1]
            h = np.maximum(a, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60)))
            d = (p - y[part]) / len(part)
            back = np.outer(d, params[2]) * (a > 0)
            grads = [z[part].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d, d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= (
                    2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                )
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held):
        out, best = net.logits(x[held]), (np.inf, 1.0)
        for t in np.geomspace(0.25, 8, 60):
            q = np.clip(out / t, -60, 60)
            loss = float(np.mean(np.logaddexp(0, q) - y[held] * q))
            best = min(best, (loss, float(t)))
        net.temperature = best[1]
    return net


def held_out(doc_id: Column) -> Column:
    """True for ids whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass
class Classifier:
    """What scoring needs: the table of features and the network; `flat` where there is none."""

    table: Table
    net: Network | None
    flat: float

    def scores(self, features: Features, texts: Iterator[bytes]) -> np.ndarray:
        vectors = [self.table.pool(*features.of(t)) for t in texts]
        if self.net is None or not vectors:
            return np.full(len(vectors), self.flat)
        return self.net.scores(np.array(vectors))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learned from `labels` (doc_id, quality) of at most `sample` ids that are not held out, in
    the order of the ids' hash, and from the texts of all documents. Null labels and null ids
    teach nothing; repeated labels count as often as they stand; of the texts that share an id,
    the one with the least hash is learned from."""
    table = Table.of(*context_sums(docs))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    usable = labels.filter(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # `sample` rows are a proven bound, so they may be broadcast.
    chosen = materialize(
        usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample), "quality-sample"
    )
    # One text per id, whatever the order of the rows, so that no more than `sample` are learned.
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
        .select("doc_id", "least.text")
    )
    rows = texts.join(F.broadcast(chosen), "doc_id")
    learned = pooled(rows, shared, ["doc_id", "quality"]).toArrow().sort_by(
        [("doc_id", "ascending"), ("quality", "ascending")]
    )
    y = np.array(learned["quality"].to_pylist(), np.float64)
    x = np.array([np.frombuffer(v, np.float32) for v in learned["vector"].to_pylist()])
    flat = float(y.mean()) if len(y) else 0.5
    return Classifier(table, fit_network(x, y) if 0 < flat < 1 and len(y) else None, flat)


def score_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = KEPT_FROM
) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document.

    A null text counts as empty; a document without words is scored by its (zero) vector like
    any other. Without both labels among the rows to learn from, every score is the share of
    label 1 there, or 0.5 if there is none. Repeated rows are scored each. An empty table
    gives no rows. Columns other than doc_id and text are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            score = shared.value.scores(features, (t.as_py() or b"" for t in batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(score, pa.float64()),
                    pa.array((score >= least).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        docs.select(
            "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)),
            F.col("text").cast("binary"),
        ),
        lean(task),
        f"doc_id {kind}, held_out boolean, score double, predicted int",
    )


def filter_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = KEPT_FROM
) -> DataFrame:
    """The rows of `docs`, all columns, that score at least `least`; scored where they lie."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            score = shared.value.scores(features, ((t.as_py() or "").encode() for t in texts))
            yield batch.filter(pa.array(score >= least))

    return arrow_map(docs, lean(task), docs.schema)
