"""Removal of repeated passages by sharded Aho-Corasick automata.

1. Every window of words has an anchor: the least hash of the short word runs inside it. Equal
   windows have equal anchors, so only anchors that are met twice can stand for a recurring
   window. They go into a Bloom filter of bounded size.
2. Documents without such an anchor are finished. The others are dealt into chunks of bounded
   size, in the order in which they lie. Neighbouring windows of one anchor make a fragment.
3. Passages are confirmed by hashes: an anchor with one fragment, met twice, is a recurring
   passage as it stands; for other anchors the windows are counted one by one, by 128 bits of
   their words' hashes. A chunk is told
   where in its own documents each of its passages stands first.
4. A chunk's task compiles the passages, the stretches of confirmed windows in its documents,
   into an automaton over numbered words and streams the chunk's documents through it; the words
   of every occurrence go.

A passage in a third of all documents reaches each chunk once, so no key is hot in steps 3 and
4. Texts move once, and only those of open documents. The filters only save work: what passes
them by chance is counted exactly afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from supportlake.llm.common import arrow_map, materialize

WINDOW = 35
ANCHOR = 8
CHUNK_BYTES = 2 * 1024 * 1024
#: Bits per anchor, and the most bits of the filter.
FILTER_BITS = 16
MOST_BITS = 1 << 28
#: Windows in one fragment; longer stretches of one anchor are cut.
MOST_WINDOWS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX2
    return x ^ (x >> np.uint64(29))


def _extreme(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least or greatest of every `width` neighbours."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[:-rest], x[rest:]) if rest else x


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


@lru_cache(maxsize=64)
def _steps(width: int, mix: int) -> list[tuple[int, np.uint64, np.uint64 | None]]:
    """(have, power, factor) for have = 1, 2, 4, ... up to `width`: `mix` to the power of
    `have`; and, if the last `have` neighbours not yet taken are to be, what they are times."""
    out, have, factor = [], 1, 1
    while have <= width:
        power = pow(mix, have, 1 << 64)
        taken = bool(width & have)
        out.append((have, np.uint64(power), np.uint64(factor) if taken else None))
        factor = factor * power % (1 << 64) if taken else factor
        have *= 2
    return out


def _rolled(h: np.ndarray, width: int, mix: np.uint64 = _MIX) -> np.ndarray:
    """Hash of every `width` neighbours: a polynomial in `mix`, put together from those of 1, 2,
    4, ... neighbours."""
    n, rest = h.size - width + 1, width
    out = np.zeros(n, np.uint64)
    steps = _steps(width, int(mix))
    for have, power, factor in steps:
        if factor is not None:
            rest -= have
            out += factor * h[rest : rest + n]
        if 2 * have <= width:
            h = h[:-have] * power + h[have:]
    return _scramble(out)


def anchors(words: list[bytes], window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `anchor` words, and each window's least one."""
    runs = _rolled(_hashes(words), anchor)
    return runs, _extreme(runs, window - anchor + 1, np.minimum)


def chosen(runs: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Hashes of the runs that are the least of some window, once for each place."""
    span = runs.size - least.size
    edge = np.zeros(span, np.uint64)
    most = _extreme(np.concatenate([edge, least, edge]), span + 1, np.maximum)
    return runs[most == runs]


def _bits(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Three bit numbers of each key, for a filter of `size` (a power of two) bits."""
    mask = np.uint64(size - 1)
    for shift in (0, 21, 40):
        yield ((keys * _MIX >> np.uint64(shift % 24)) ^ (keys >> np.uint64(shift))) & mask


def _passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    ok = np.ones(keys.size, bool)
    for at in _bits(keys, bits.size * 8):
        ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def _filter(keys: DataFrame) -> Broadcast:
    """Bloom filter of the numbers in the column `anchor`."""
    keys = materialize(keys, "anchors")
    total = keys.count()
    size = 1 << 16
    while size < min(MOST_BITS, FILTER_BITS * total):
        size *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(list(_bits(keys, size)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["at", "bits"]
            )

    # One row per 32 bits: at most MOST_BITS / 32 rows come to the driver.
    rows = (
        arrow_map(keys, words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("b"))
    ).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    bits[rows["at"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint8))


def _met_twice(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Anchors met at least twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [
                chosen(*anchors(words, window, anchor))
                for text in batch.column(0)
                if len(words := (text.as_py() or b"").split()) >= window
            ]
            if keys:
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(n)], ["anchor", "n"]
                )

    met = arrow_map(docs.select(F.col("text").cast("binary")), count, "anchor long, n long")
    return met.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def _fragments(least: np.ndarray, ok: np.ndarray, most: int) -> list[tuple[int, int]]:
    """[first, last) windows of each stretch with one anchor that passed, cut at `most`."""
    new = np.concatenate([[True], least[1:] != least[:-1]])
    at = np.flatnonzero(new)
    ends = np.concatenate([at[1:], [least.size]])
    out = []
    for a, b in zip(at[ok[at]].tolist(), ends[ok[at]].tolist()):
        out.extend((i, min(i + most, b)) for i in range(a, b, most))
    return out


def _key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _split_documents(
    docs: DataFrame, seen: Broadcast, keep: Callable, window: int, anchor: int, chunk_bytes: int
) -> DataFrame:
    """A row per document; `text`, `chunk`, `place` (its number in the chunk) and `marks` (its
    anchors that passed, as 64-bit numbers) only where it may hold recurring windows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, place, filled = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            size, kept, text, at, marks = [], [], [], [], []
            for value in batch.column(1):
                words = (value.as_py() or b"").split()
                open_ = False
                if len(words) >= window:
                    _, least = anchors(words, window, anchor)
                    least = np.unique(least)
                    least = least[_passes(least, seen.value)]
                    open_ = least.size > 0
                size.append(len(words))
                kept.append(None if open_ else keep(words))
                text.append(b" ".join(words) if open_ else None)
                marks.append(least.tobytes() if open_ else None)
                at.append((chunk, place) if open_ else (None, None))
                if open_:
                    place, filled = place + 1, filled + len(text[-1])
                    if filled >= chunk_bytes:
                        chunk, place, filled = chunk + 1, 0, 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(size, pa.int64()), pa.array(kept, pa.string()),
                    pa.array(text, pa.binary()), pa.array([c for c, _ in at], pa.int64()),
                    pa.array([p for _, p in at], pa.int64()), pa.array(marks, pa.binary()),
                ],
                ["doc_id", "n_words", "kept", "text", "chunk", "place", "marks"],
            )

    return arrow_map(
        docs.select("doc_id", F.col("text").cast("binary")),
        task,
        f"doc_id {kind}, n_words long, kept string, text binary, chunk long, place long, "
        "marks binary",
    )


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(chunk, rows without it) of rows that lie together by their first column."""
    chunk, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns))):
            if row[0] != chunk:
                if held:
                    yield chunk, held
                chunk, held = row[0], []
            held.append(row[1:])
    if held:
        yield chunk, held


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each chunk, which lie together by their first column."""
    chunk, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, keys.size]):
            if a == b:  # an empty batch
                continue
            if held and keys[a] != chunk:
                yield pa.Table.from_batches(held)
                held = []
            chunk = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _places(open_docs: DataFrame, judge: Callable, schema: str) -> DataFrame:
    """What `judge(tally, at, text, marks)` tallies up within a chunk: key -> [count, where
    first]."""
    width = schema.count(",") - 2

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs in _by_chunk(batches):
            tally: dict[tuple, list[int]] = {}
            for place, text, marks in docs:
                judge(tally, place << 32, text, np.frombuffer(marks, np.uint64))
            columns = list(zip(*tally)) or [()] * width
            kinds = [pa.binary() if c and isinstance(c[0], bytes) else pa.int64() for c in columns]
            if tally:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c, k) for c, k in zip(columns, kinds)),
                        pa.array([chunk] * len(tally), pa.int64()),
                        pa.array([n for n, _ in tally.values()], pa.int64()),
                        pa.array([at for _, at in tally.values()], pa.int64()),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return arrow_map(open_docs.select("chunk", "place", "text", "marks"), task, schema)


def _passages(open_docs: DataFrame, seen: Broadcast, window: int, anchor: int) -> DataFrame:
    """(chunk, at, windows): where a chunk's passages stand, as place in the chunk << 32 | word,
    and how many windows each has."""

    def fragments(tally: dict, at: int, text: bytes, marks: np.ndarray) -> None:
        words = text.split()
        _, least = anchors(words, window, anchor)
        keys = least.view(np.int64)
        for a, b in _fragments(least, _passes(least, seen.value), MOST_WINDOWS):
            one = int(keys[a]), b - a, _key(b" ".join(words[a : b + window - 1]))
            tally.setdefault(one, [0, at | a])[0] += 1

    found = materialize(
        _places(
            open_docs, fragments,
            "anchor long, windows long, fragment binary, chunk long, n long, at long",
        ),
        "fragments",
    )
    judged = found.groupBy("anchor").agg(
        (F.min("fragment") == F.max("fragment")).alias("alone"), F.sum("n").alias("met")
    ).select("anchor", (F.col("alone") & (F.col("met") > 1)).alias("whole"))
    judged = materialize(judged, "judged")
    whole = found.join(judged.filter("whole"), "anchor").select("chunk", "at", "windows")
    apart = _filter(judged.filter("not whole").select("anchor"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, docs in _by_chunk(batches):
            keys, places = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
            for place, text, marks in docs:
                if not _passes(np.frombuffer(marks, np.uint64), apart.value).any():
                    continue  # all its passages stand as they are
                h = _hashes(text.split())
                least = _extreme(_rolled(h, anchor), window - anchor + 1, np.minimum)
                open_ = np.flatnonzero(_passes(least, apart.value) & _passes(least, seen.value))
                keys.append(np.stack([_rolled(h, window, m)[open_] for m in (_MIX, _MIX2)], 1))
                places.append(place << 32 | open_)
            key, at = np.concatenate(keys), np.concatenate(places)
            if at.size:
                order = np.lexsort((key[:, 1], key[:, 0]))  # equal windows stay as they stand
                key, at = key[order], at[order]
                new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
                digests = pa.py_buffer(np.ascontiguousarray(key[new]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.Array.from_buffers(pa.binary(16), new.size, [None, digests]).cast(pa.binary()),
                        pa.array(np.full(new.size, chunk, np.int64)),
                        pa.array(np.diff(np.append(new, at.size))), pa.array(at[new]),
                    ],
                    ["window", "chunk", "n", "at"],
                )

    # At most one row for each window and chunk, so no window is a hot key.
    counted = arrow_map(
        open_docs.select("chunk", "place", "text", "marks"), windows,
        "window binary, chunk long, n long, at long",
    )
    again = counted.select(
        "chunk", "at", F.sum("n").over(Window.partitionBy("window")).alias("met")
    )
    return whole.unionAll(
        again.filter("met > 1").select("chunk", "at", F.lit(1).cast("long").alias("windows"))
    )


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of `x` are in `ordered`, without sorting it again for each document."""
    if not ordered.size:
        return np.zeros(x.size, bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), ordered.size - 1)] == x


def _letters(number: int) -> str:
    """Three letters for a word's number, from an alphabet for each place: an automaton's nodes
    then have few branches, and words cannot be met out of step."""
    return chr(0x1000 + number % 128) + chr(0x2000 + number // 128 % 128) + chr(
        0x3000 + number // 16384
    )


def _windows_told(at: np.ndarray, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its confirmed windows) from places (document << 32 | window) and how many windows
    there are from each on."""
    order = np.argsort(at, kind="stable")
    at, windows = at[order], windows[order]
    new = np.flatnonzero(np.diff(at >> 32, prepend=-1))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), at.size]):
        n, first = windows[a:b], at[a:b] & 0xFFFFFFFF
        yield int(at[a]) >> 32, np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def _strip(rows: DataFrame, keep: Callable, window: int, kind: str) -> DataFrame:
    """A chunk's rows lie together: passages (text is null), then documents by place."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for held in _tables(batches):
            told = held.filter(pc.is_null(held["text"]))
            held = held.filter(pc.is_valid(held["text"]))
            docs = {
                at: text.split() for at, text in zip(held["at"].to_pylist(), held["text"].to_pylist())
            }
            hashes = {at: _hashes(words) for at, words in docs.items() if len(words) >= window}
            # Two hashes of windows, 128 bits together; the second only where it is asked for.
            rolled = {at: _rolled(h, window) for at, h in hashes.items()}
            second = {}
            confirmed = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            for at, here in _windows_told(told["at"].to_numpy(), told["windows"].to_numpy()):
                second[at] = _rolled(hashes[at], window, _MIX2)
                for some, of in zip(confirmed, (rolled, second)):
                    some.append(of[at][here])
            known = [np.unique(np.concatenate(some)) for some in confirmed]
            letters: dict[bytes, str] = {}
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            # A document's stretches of confirmed windows are its passages. One without any holds
            # no window of the others' either, so it need not be streamed.
            streamed = set()
            for at, one in rolled.items():
                ok = _among(one, known[0])
                maybe = np.flatnonzero(ok)
                if not maybe.size:
                    continue
                two = second[at] if at in second else _rolled(hashes[at], window, _MIX2)
                ok[maybe] = _among(two[maybe], known[1])
                if ok.any():
                    streamed.add(at)
                edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                    words = docs[at][a : b - 1 + window]
                    for w in words:
                        if w not in letters:
                            letters[w] = _letters(len(letters) + 1)
                    automaton.add_word("".join(map(letters.__getitem__, words)), len(words))
            if len(automaton):
                automaton.make_automaton()
            size, gone, kept = [], [], []
            for at, words in docs.items():
                stay = words
                if at in streamed:
                    line = "".join([letters.get(w, other) for w in words])
                    hits = np.fromiter(automaton.iter(line), [("last", np.int64), ("length", np.int64)])
                    end, most = (hits["last"] + 1) // 3, len(words) + 1
                    edge = np.bincount(end - hits["length"], minlength=most) - np.bincount(end, minlength=most)
                    stay = list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))
                size.append(len(words))
                gone.append(len(words) - len(stay))
                kept.append(keep(stay))
            yield pa.RecordBatch.from_arrays(
                [
                    held["doc_id"].combine_chunks().cast(id_kind), pa.array(size, pa.int64()),
                    pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    id_kind, other = to_arrow_type(rows.schema["doc_id"].dataType), _letters(0)
    return arrow_map(rows, task, f"doc_id {kind}, n_words long, n_removed long, kept string")


def as_text(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    chunk_bytes: int = CHUNK_BYTES,
    keep: Callable[[list[bytes]], str] = as_text,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), a row per document.

    A word goes if it lies in a window of `window` words that also starts elsewhere, in any
    document. `keep` makes what is returned of the words that stay; by default they are joined
    by one space. A null text has no words. Rows with the same doc_id are documents of their
    own, so a repeated row loses all its windows, as do both of two copies. An empty table
    gives no rows. Columns other than doc_id and text are not used.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = _filter(_met_twice(docs, window, anchor))
    split = materialize(
        _split_documents(docs, seen, keep, window, anchor, chunk_bytes), "split"
    )
    done = split.filter("text is null").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept"
    )
    open_docs = split.filter("text is not null")
    passages = _passages(open_docs, seen, window, anchor).select(
        "chunk", "at", "windows", F.lit(None).cast("binary").alias("text"),
        F.lit(None).cast(kind).alias("doc_id"),
    )
    streams = open_docs.select(
        "chunk", F.col("place").alias("at"), F.lit(0).cast("long").alias("windows"), "text",
        "doc_id",
    )
    rows = passages.unionAll(streams).repartition("chunk").sortWithinPartitions("chunk")
    return done.unionAll(_strip(rows, keep, window, kind))
