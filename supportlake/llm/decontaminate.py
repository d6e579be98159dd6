"""Benchmark decontamination over an FM-index per training shard.

A shard is a bounded stretch of the documents' words. Its words become numbers, its suffixes are
sorted, and the Burrows-Wheeler transform goes into a wavelet matrix, whose ranks drive the
backward search of all test phrases at once. A phrase's rows are turned into positions by
walking back to sampled suffix positions. The hit words of a document are merged into spans.

Documents are never shuffled: shards are cut where the rows lie, texts longer than a shard
overlap by the longest phrase less one word. Phrases come in blocks of bounded size; every
block is searched in the same index.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map, lean

PHRASE_WORDS = 10
SHARD_WORDS = 1_000_000
SAMPLE = 8
#: Columns that are added; input columns of these names are left out.
ADDED, CHANGED = ("_n_words", "_spans", "_items"), "_changed"
#: Bytes of item text in one block of phrases, and blocks in one pass over the documents.
BLOCK_BYTES = 16 * 1024 * 1024
BLOCKS = 4

_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: letters and digits of ASCII, and all beyond it."""
    return text.translate(_KEEP).split()


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of `ranks` (>= 1; the end counts as 0). Sorts by three symbols at once,
    then by tripled lengths, and from then on only what is still tied."""
    n = ranks.size
    if n == 0:
        return np.zeros(0, np.int64)
    rank, width = ranks.astype(np.int64), 1
    tied = np.arange(n)
    order = np.zeros(n, np.int64)
    slot = np.arange(n)  # places in `order` that the tied suffixes share
    while True:
        base = int(rank.max()) + 1
        padded = np.concatenate([rank, np.zeros(2 * width, np.int64)])
        key = (padded[tied] * base + padded[tied + width]) * base + padded[tied + 2 * width]
        by = np.argsort(key)
        order[slot] = tied = tied[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        # A group's rank is one more than the place of its first member.
        first = np.maximum.accumulate(np.where(new, slot, 0))
        rank[tied] = first + 1
        single = new & np.concatenate([new[1:], [True]])
        if single.all():
            return order
        tied, slot = tied[~single], slot[~single]
        width *= 3


class WaveletMatrix:
    """Ranks over a sequence of small numbers, for arrays of symbols and positions at once."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            count = np.zeros(values.size + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(values.size - int(count[-1]))
            set_ = bit.astype(bool)
            values = np.concatenate([values[~set_], values[set_]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        low = np.zeros_like(at)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[k], self.zeros[k]
            set_ = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[at]
            low = np.where(set_, zeros + a, low - a)
            at = np.where(set_, zeros + b, at - b)
        return at - low


class FMIndex:
    """Index of one shard. Symbols 1.. are the words that some phrase has; all others and the
    document ends are 0. A suffix position is kept where it is a multiple of `sample` or comes
    after a 0, so no walk has to pass one."""

    def __init__(self, words: np.ndarray, symbol_of: np.ndarray, symbols: int, sample: int):
        """words: >= 1, with a new and smaller number at each document's end than any word."""
        order = suffix_order(words)
        symbol = symbol_of[words]
        before = np.concatenate([[0], symbol[:-1]])[order].astype(np.int32)
        self.matrix = WaveletMatrix(before, symbols)
        self.before = before
        starts = symbol[order]
        # Rows whose suffix starts with a symbol are one stretch, as equal words sort together.
        self.first = np.zeros(symbols, np.int64)
        self.last = np.zeros(symbols, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1]]))
        ends = np.concatenate([edge[1:], [starts.size]])
        self.first[starts[edge]] = edge
        self.last[starts[edge]] = ends
        kept = (order % sample == 0) | (before == 0)
        self.kept = kept
        self.at = np.concatenate([[0], np.cumsum(kept, dtype=np.int32)])
        self.position = order[kept].astype(np.int32)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases are right-aligned rows of symbols."""
        width = phrases.shape[1]
        last = phrases[:, -1]
        low, high = self.first[last].copy(), self.last[last].copy()
        for step in range(2, width + 1):
            go = np.flatnonzero((sizes >= step) & (low < high))
            if not go.size:
                break
            s = phrases[go, width - step]
            low[go], high[go] = (
                self.first[s] + self.matrix.rank(s, x[go]) for x in (low.copy(), high.copy())
            )
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        steps = np.zeros(rows.size, np.int64)
        rows, out = rows.copy(), np.zeros(rows.size, np.int64)
        open_ = np.arange(rows.size)
        while open_.size:
            found = self.kept[rows[open_]]
            done = open_[found]
            out[done] = self.position[self.at[rows[done]]] + steps[done]
            open_ = open_[~found]
            s = self.before[rows[open_]].astype(np.int64)
            rows[open_] = self.first[s] + self.matrix.rank(s, rows[open_])
            steps[open_] += 1
        return out


@dataclass
class Phrases:
    """A block of test phrases: distinct windows, and the items each stands for."""

    words: dict[bytes, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    sizes: np.ndarray | None = None
    item_of: np.ndarray | None = None  # item numbers, one for each (window, item)
    item_at: np.ndarray | None = None  # where each window's items begin
    items: list[str] = field(default_factory=list)
    longest: int = 1


def phrase_block(items: list[tuple[str, bytes]], size: int = PHRASE_WORDS) -> Phrases:
    """Windows of `size` words of each item; an item of fewer words is one window."""
    out = Phrases()
    number: dict[tuple[int, ...], int] = {}
    pairs: dict[tuple[int, int], None] = {}
    for name, text in items:
        ids = [out.words.setdefault(w, len(out.words) + 1) for w in words_of(text)]
        if not ids:
            continue
        at = len(out.items)
        out.items.append(name)
        for i in range(max(1, len(ids) - size + 1)):
            window = number.setdefault(tuple(ids[i : i + size]), len(number))
            pairs[window, at] = None
    out.rows = np.zeros((len(number), size), np.int64)
    out.sizes = np.fromiter(map(len, number), np.int64, len(number))
    for i, window in enumerate(number):
        out.rows[i, size - len(window) :] = window
    both = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    out.item_of = both[:, 1].copy()
    out.item_at = np.searchsorted(both[:, 0], np.arange(len(number) + 1))
    out.longest = int(out.sizes.max(initial=1))
    return out


def _shards(lists: list[list[bytes]], most: int, overlap: int) -> Iterator[list[tuple]]:
    """Stretches (row, first word, words) of at most `most` words together. A long row is cut;
    its stretches share `overlap` words."""
    shard, size = [], 0
    for row, words in enumerate(lists):
        at = 0
        while at < len(words):
            room = most - size
            if len(words) - at > room and room <= overlap:
                yield shard
                shard, size, room = [], 0, most
            part = words[at : at + room] if at or len(words) > room else words
            shard.append((row, at, part))
            size += len(part)
            if at + len(part) == len(words):
                break
            at += len(part) - overlap
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _search_shard(
    shard: list[tuple], blocks: list[Phrases], hits: list, found: list, sample: int
) -> None:
    ends = len(shard)
    sizes = np.array([len(words) + 1 for _, _, words in shard])
    starts = np.cumsum(sizes) - sizes
    flat = [w for _, _, words in shard for w in (*words, b"")]
    number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    ids += ends + 1
    ids[starts + sizes - 1] = np.arange(1, ends + 1)
    for block in blocks:
        symbol_of = np.zeros(len(number) + ends + 1, np.int64)
        used = [(number[w], s) for w, s in block.words.items() if w in number]
        if not used:
            continue
        here, symbols = np.array(used, np.int64).T
        symbol_of[here + ends + 1] = symbols
        index = FMIndex(ids, symbol_of, len(block.words) + 1, sample)
        low, high = index.search(block.rows, block.sizes)
        count = high - low
        which = np.repeat(np.arange(count.size), count)
        # In portions, as a phrase may stand in most documents of the shard.
        for a in range(0, which.size, 500_000):
            w = which[a : a + 500_000]
            nth = np.arange(a, a + w.size) - (np.cumsum(count) - count)[w]
            position = index.locate(low[w] + nth)
            part = np.searchsorted(starts, position, "right") - 1
            # Sorted by document once, each one's hits lie together.
            order = np.argsort(part, kind="stable")
            part, position, w = part[order], position[order], w[order]
            for held in np.split(np.arange(part.size), np.flatnonzero(np.diff(part)) + 1):
                p = part[held[0]]
                row, first, words = shard[p]
                begin = position[held] - starts[p] + first
                if hits[row] is None:
                    hits[row], found[row] = [], set()
                hits[row].append(np.stack([begin, begin + block.sizes[w[held]]], 1))
                for v in np.unique(w[held]):
                    found[row].update(
                        block.items[i]
                        for i in block.item_of[block.item_at[v] : block.item_at[v + 1]]
                    )


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of [begin, end) rows as disjoint rows in order; touching ones become one."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], reach[np.concatenate([at[1:] - 1, [len(spans) - 1]])]], 1)


def _blocks(benchmark: DataFrame, size: int, block_bytes: int) -> Iterator[Broadcast]:
    """The items, a bounded block at a time, as broadcast phrases."""
    sc = benchmark.sparkSession.sparkContext
    rows = benchmark.filter(F.col("text").isNotNull()).select(
        F.col("item_id").cast("string"), F.col("text").cast("binary")
    )
    items, total = [], 0
    for name, text in rows.toLocalIterator():
        items.append((name or "", bytes(text)))
        total += len(text)
        if total >= block_bytes:
            yield sc.broadcast(pickle.dumps(phrase_block(items, size)))
            items, total = [], 0
    if items:
        yield sc.broadcast(pickle.dumps(phrase_block(items, size)))


def find_phrases(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = PHRASE_WORDS,
    shard_words: int = SHARD_WORDS,
    sample: int = SAMPLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of `docs` but any of the names that follow, and _n_words (long), _spans (array of [begin, end) word ranges
    that benchmark windows cover, disjoint and in order), _items (array of the item_ids whose
    windows occur, as strings).

    A null text has no words; a null benchmark text no windows; an item_id that is null counts
    as the empty string, repeated items as one. Repeated documents are each answered on their
    own. Benchmarks of any size are searched in blocks, up to four blocks to a pass over the
    documents. Empty tables give no rows, or no hits.
    """

    def run(frame: DataFrame, blocks: list[Broadcast]) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = [pickle.loads(b.value) for b in blocks]
            overlap = max([b.longest for b in phrases], default=1) - 1
            pending: list[pa.RecordBatch] = []
            lists: list[list[bytes]] = []
            total = 0

            def flush() -> Iterator[pa.RecordBatch]:
                hits: list = [None] * len(lists)
                found: list = [None] * len(lists)
                if phrases:
                    for shard in _shards(lists, max(shard_words, 4 * overlap + 4), overlap):
                        _search_shard(shard, phrases, hits, found, sample)
                at = 0
                for batch in pending:
                    n = batch.num_rows
                    old = batch.column(batch.num_columns - 2).to_pylist()
                    had = batch.column(batch.num_columns - 1).to_pylist()
                    spans, items = [], []
                    for i in range(n):
                        new = hits[at + i]
                        if new is None:
                            spans.append(old[i])
                            items.append(had[i])
                            continue
                        both = new + ([np.array(old[i], np.int64)] if old[i] else [])
                        spans.append(merge_spans(np.concatenate(both)).tolist())
                        items.append(sorted(found[at + i].union(had[i])))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(c) for c in range(batch.num_columns - 4)),
                            pa.array([len(x) for x in lists[at : at + n]], pa.int64()),
                            pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                            pa.array(items, pa.list_(pa.string())),
                        ],
                        [*columns, "_n_words", "_spans", "_items"],
                    )
                    at += n
                pending.clear()
                lists.clear()

            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    new = [words_of(t or b"") for t in part.column(len(columns)).to_pylist()]
                    pending.append(part)
                    lists.extend(new)
                    total += sum(map(len, new))
                    if total >= shard_words or sum(b.nbytes for b in pending) > 64 << 20:
                        yield from flush()
                        total = 0
            yield from flush()

        fields = [frame.schema[c] for c in columns]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return arrow_map(
            frame.select(
                *(F.col(f"`{c}`") for c in columns),
                F.col("text").cast("binary").alias("_bytes"), "_n_words", "_spans", "_items",
            ),
            lean(task),
            f"{schema}, _n_words long, _spans array<array<long>>, _items array<string>",
        )

    columns = [c for c in docs.columns if c not in (*ADDED, CHANGED)]
    out = docs.select(
        *(F.col(f"`{c}`") for c in columns),
        F.lit(0).cast("long").alias("_n_words"),
        F.array().cast("array<array<bigint>>").alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    passed, held = False, []
    for block in _blocks(benchmark, size, block_bytes):
        held.append(block)
        if len(held) == BLOCKS:
            out, passed, held = run(out, held), True, []
    if held or not passed:
        out = run(out, held)
    return out


def remove_spans(found: DataFrame) -> DataFrame:
    """Result of `find_phrases` with the hit words cut out of `text`, from the first letter of
    a span to the last; _changed says where. Other columns stay, the spans go."""
    columns = [c for c in found.columns if c not in (*ADDED, CHANGED)]
    at = columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], []
            for text, spans in zip(batch.column(at), batch.column(len(columns))):
                spans = spans.as_py()
                changed.append(bool(spans))
                raw = text.as_py()
                if not spans:
                    texts.append(raw)
                    continue
                raw = raw.encode()
                low = np.frombuffer(raw.translate(_KEEP), np.uint8) != 32
                edge = np.diff(np.concatenate([[0], low.astype(np.int8), [0]]))
                begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                out, last = [], 0
                for a, b in spans:
                    out.append(raw[last : begins[a]])
                    last = ends[b - 1]
                texts.append((b"".join(out) + raw[last:]).decode())
            arrays = [batch.column(c) for c in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(changed)], [*columns, "_changed"])

    schema = ", ".join(f"`{c}` {found.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(
        found.select(*(F.col(f"`{c}`") for c in columns), "_spans"),
        lean(task),
        f"{schema}, _changed boolean",
    )
