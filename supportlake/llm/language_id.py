"""Language identification by a blended-spectrum string kernel.

Two texts are as alike as the share of character n-grams (n = 1..4) that both hold, each
length of n-gram with the same weight; how often they stand does not count. All n-grams of a
text count in its norm, also those that no landmark holds. Texts of a bounded
number of landmarks span the Nystroem space; kernel ridge regression, one class against the
rest, is solved there. A document is scored by products of matrices: which n-grams of the
landmarks it holds, times the landmarks, times the weights, a batch of documents at once.

Learning takes a bounded sample (`SAMPLE` rows over all languages, `LANDMARKS` of them); the
model's size does not grow with the corpus. Every document's whole text is scored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map, materialize

#: From 1 on, without a gap.
ORDERS = (1, 2, 3, 4)
LANDMARKS = 128
SAMPLE = 3000
RIDGE = 1e-3
#: Entries of a table of steps, at most; longer ones are looked up in a sorted list.
STEPS = 1 << 22
#: Of the hashes that tell a text's n-grams apart.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Documents in one product.
BATCH = 128
UNKNOWN = "und"

BLANK = 32


@functools.cache
def _folded() -> np.ndarray:
    """Each code point's lower case, BLANK if it is no letter."""
    out = np.full(0x110000, BLANK, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalnum() and not c.isdecimal():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), "<u4")


def _single_blanks(x: np.ndarray, blank: int) -> np.ndarray:
    """`x` without the blanks that follow a blank."""
    is_blank = x == blank
    is_blank[1:] &= is_blank[:-1].copy()
    is_blank[0] = False
    return x[~is_blank]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """The columns' n-grams lie in a trie, a table per length: `steps[k]` leads from a node of
    k letters and a letter to a node of k + 1, `columns[k]` from there to a column (the last,
    unused one for nodes that are only on the way). Where `listed[k]`, `steps[k]` is the sorted
    list of the steps that lead on. Node and letter 0 stand for all others.
    orders: columns' lengths, in order."""

    folded: np.ndarray  # code point -> lower case
    letters: np.ndarray  # lower case -> letter
    listed: list[bool]
    steps: list[np.ndarray]
    columns: list[np.ndarray]
    orders: np.ndarray
    landmarks: np.ndarray  # (landmark, column), scaled
    weights: np.ndarray  # (landmark, language)
    languages: list[str]

    def presence(self, texts: list[str]) -> np.ndarray:
        """(document, column) 0/1: which of the landmarks' n-grams a text holds."""
        return self._held(texts)[0]

    def _held(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """presence(), and how many n-grams of each length a text has, columns or not."""
        held = np.zeros((len(texts), self.orders.size + 1), np.float32)
        counts = np.zeros((len(texts), len(ORDERS)), np.float32)
        width = self.columns[0].size
        for row, count, text in zip(held, counts, texts):
            points = _single_blanks(self.folded[_points(text)], BLANK)
            letters = self.letters[points].astype(np.int64)
            node = letters
            row[self.columns[0][node]] = 1
            code = points = points.astype(np.uint64)
            count[0] = np.unique(code).size
            for k, (step, column) in enumerate(zip(self.steps, self.columns[1:]), 1):
                node = node[:-1] * width + letters[k:]
                if self.listed[k - 1]:
                    at = np.searchsorted(step, node)
                    there = step[np.minimum(at, step.size - 1)] == node if step.size else False
                    node = np.where(there, at + 1, 0)
                else:
                    node = step[node]
                row[column[node]] = 1
                code = (code[:-1] ^ (code[:-1] >> np.uint64(31))) * SPREAD + points[k:]
                count[k] = np.unique(code).size
        return held[:, :-1], counts

    def scaled(self, texts: list[str]) -> np.ndarray:
        """Presence, each length of n-gram divided by the norm of the text's whole spectrum."""
        held, counts = self._held(texts)
        for k, order in enumerate(ORDERS):
            first, last = np.searchsorted(self.orders, [order, order + 1])
            held[:, first:last] /= np.sqrt(np.maximum(counts[:, k : k + 1], 1))
        return held

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Similarity of each text to each landmark."""
        return self.scaled(texts) @ self.landmarks.T

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights


def _commonest(sets: list[np.ndarray], most: int | None) -> np.ndarray:
    """What is in most of the sets, or all; ties go to the least."""
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    return values[np.lexsort((values, -n))[:most]]


def _trie(grams: list[np.ndarray], width: int) -> tuple[list, list, list]:
    """Steps, listed and columns of `Model`; `grams[k]` are numbers of k + 1 digits to base `width`."""
    nothing = sum(g.size for g in grams)
    first = np.full(width, nothing)
    first[grams[0]] = np.arange(grams[0].size)
    steps, listed, columns = [], [], [first]
    before, at = np.arange(width), grams[0].size
    for k, own in enumerate(grams[1:], 1):
        # All beginnings of this and of longer n-grams; `before` holds those one shorter.
        nodes = np.unique(np.concatenate(
            [g // width ** (j - k) for j, g in enumerate(grams) if j >= k]
        ))
        step = np.searchsorted(before, nodes // width) * width + nodes % width
        listed.append(before.size * width > STEPS)
        if not listed[-1]:
            led = np.zeros(before.size * width, np.int64)
            led[step] = np.arange(nodes.size) + 1
            step = led
        column = np.full(nodes.size + 1, nothing)
        column[np.searchsorted(nodes, own) + 1] = at + np.arange(own.size)
        steps.append(step)
        columns.append(column)
        # Node 0 has no way on.
        before, at = np.concatenate([[-1], nodes]), at + own.size
    return steps, listed, columns


def fit(
    texts: list[str], languages: list[str], landmarks: int = LANDMARKS,
    features: int | None = None, ridge: float = RIDGE,
) -> Model:
    """The first texts of each language in turn are landmarks, all of them teach. `features`:
    columns at most, those in most landmarks; all n-grams of the landmarks if it is None."""
    names = sorted(set(languages))
    turns: dict[str, list[int]] = {n: [] for n in names}
    for i, name in enumerate(languages):
        turns[name].append(i)
    chosen: list[int] = []
    for k in range(max(map(len, turns.values()))):
        chosen += [rows[k] for rows in turns.values() if k < len(rows)]
    chosen = chosen[: max(landmarks, len(names))]

    # Letters that are no column are letter 0; n-grams with such a letter are none either.
    each = features and max(1, features // len(ORDERS))
    folded = _folded()
    spelled = [_single_blanks(folded[_points(texts[i])], BLANK) for i in chosen]
    alphabet = _commonest([np.unique(x) for x in spelled], each)
    width = alphabet.size + 1
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(1, width)
    spelled = [number[x].astype(np.int64) for x in spelled]
    grams = []
    for order in ORDERS:
        sets = []
        for x in spelled:
            g, ok = np.zeros(max(0, x.size - order + 1), np.int64), True
            for j in range(order):
                part = x[j : j + g.size]
                g, ok = g * width + part, ok & (part > 0)
            sets.append(np.unique(g[ok]))
        grams.append(_commonest(sets, each))
    steps, listed, columns = _trie(grams, width)
    orders = np.repeat(ORDERS, [g.size for g in grams])
    model = Model(
        folded, number, listed, steps, columns, orders, np.zeros((1, orders.size), np.float32),
        np.zeros((1, 1)), names,
    )
    model.landmarks = model.scaled([texts[i] for i in chosen]) / np.float32(len(ORDERS))
    own = model.kernel([texts[i] for i in chosen]).astype(np.float64)
    values, axes = np.linalg.eigh((own + own.T) / 2)
    good = values > 1e-6 * values.max()
    root = axes[:, good] / np.sqrt(values[good])
    x = np.concatenate(
        [model.kernel(texts[at : at + BATCH]) for at in range(0, len(texts), BATCH)]
    ).astype(np.float64) @ root
    at = {n: i for i, n in enumerate(names)}
    y = -np.ones((len(texts), len(names)))
    y[np.arange(len(texts)), [at[n] for n in languages]] = 1
    solved = np.linalg.solve(x.T @ x + ridge * len(x) * np.eye(x.shape[1]), x.T @ y)
    model.weights = root @ solved
    return model


def held_out(doc_id: Column) -> Column:
    """True for ids that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learning_rows(docs: DataFrame, sample: int) -> tuple[list[str], list[str]]:
    """Texts and languages of about `sample` rows, the same number for each language as far as
    there are. Chosen by a hash of the id, so no language is gathered whole."""
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
        & F.col("text").rlike("\\p{L}")
    )
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample)
    found = {r["lang"]: r["count"] for r in counts.collect()}
    if not found:
        return [], []
    each = max(1, sample // len(found))
    # A share of each language that gives at least `each` rows almost surely.
    share = [
        (name, min(1.0, (each + 4 * each**0.5 + 4) / n)) for name, n in sorted(found.items())
    ]
    shares = docs.sparkSession.createDataFrame(share, "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    rows = (
        usable.join(F.broadcast(shares), "lang")
        .filter(place < F.col("share"))
        .select(place.alias("place"), "doc_id", "lang", "text")
        .toLocalIterator()
    )
    by_lang: dict[str, list] = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append((row["place"], row["doc_id"], row["text"]))
    texts, names = [], []
    for name, held in sorted(by_lang.items()):
        for _, _, text in sorted(held)[:each]:
            texts.append(text)
            names.append(name)
    return texts, names


def identify(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per document.

    Learned from text and lang of rows that are not held out; null languages, null ids and
    texts without a letter teach nothing. A null text and one without letters is `und` with
    score 0, as are all if there is nothing to learn from. score is the winner's regression
    value, brought from -1..1 to 0..1. Ties go to the first language by name. Repeated rows
    are answered each; an empty table gives no rows. Other columns are not used.
    """
    texts, names = learning_rows(docs, sample)
    model = fit(texts, names, landmarks) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(2).to_pylist()]
                known = np.array([model is not None and has_letter(t) for t in texts], bool)
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if known.any():
                    values = model.scores(texts)
                    best = values.argmax(1)
                    pred = [
                        model.languages[b] if k else UNKNOWN for b, k in zip(best, known)
                    ]
                    score = np.where(known, np.clip((values.max(1) + 1) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(pred), pa.array(score, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        docs.select(
            "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)), "text"
        ),
        task,
        f"doc_id {kind}, held_out boolean, lang_pred string, score double",
    )
