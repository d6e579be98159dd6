"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints at `distance` or fewer bits agree on at least one of `distance` + 1 blocks of bits,
so each distinct fingerprint is dealt to one group per block. Groups that stay large are dealt
once more by blocks of the remaining bits. A group's fingerprints are sorted by Gray rank,
where neighbours differ in few bits; every `FAN` of them make a node that holds the bits they
share, nodes make nodes above, and a child keeps only the bits its parent lacks. A search walks
down all fingerprints at once, adds up differing bits and drops whole nodes beyond the
distance, and nodes that lie wholly in the searcher's own class.

A task returns a spanning set of links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map, lean, materialize
from supportlake.llm.components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Children of a node.
FAN = 8
#: Larger groups are dealt once more.
LARGE_GROUP = 4096
#: Fingerprints searched at once, and nodes looked at in one step.
SEARCH_BLOCK = 4096
#: Fingerprints of small groups that are indexed together.
GROUPED = 100_000
#: Shingles hashed at once.
HASH_BLOCK = 65_536


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes: a bit is set if it is set in more than half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    count, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    for at in range(0, n, HASH_BLOCK):
        part = words[at : min(n, at + HASH_BLOCK) + shingle - 1]
        columns = [part[j : len(part) - shingle + 1 + j] for j in range(shingle)]
        lines = map(b" ".join, zip(*columns)) if len(words) >= shingle else [b" ".join(words)]
        hashes = b"".join([digest(s, seed) for s in lines])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * count > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(
                fingerprint(t.as_py() or b"", shingle, seed) for t in batch.column(1)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))],
                ["doc_id", "fp"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        docs.select("doc_id", F.col("text").cast("binary")), lean(task), f"doc_id {kind}, fp long"
    )


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit number in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def join_classes(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the classes of a[i] and b[i] in `label`, which holds each one's least member."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class GrayIndex:
    """A forest over sorted fingerprints, with a tree for each group."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """fps: sorted by (group, Gray rank); group: 0.. without gaps."""
        self.fps = fps
        every, none = np.uint64(2**64 - 1), np.uint64(0)
        self.levels: list[dict] = []
        shared = np.full(fps.size, every)
        bits, owner = fps, group
        below = np.arange(fps.size + 1)
        while True:
            # Nodes of this level: up to FAN neighbours of one group.
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            nth = np.arange(owner.size) - first[np.cumsum(
                np.concatenate([[False], owner[1:] != owner[:-1]])
            )]
            start = np.flatnonzero(nth % FAN == 0)
            end = np.concatenate([start[1:], [owner.size]])
            both = np.bitwise_and.reduceat(bits, start)
            any_ = np.bitwise_or.reduceat(bits, start)
            mask = np.bitwise_and.reduceat(shared, start) & ~(both ^ any_)
            parent = np.repeat(np.arange(start.size), end - start)
            self.levels.append(
                {
                    # Children keep what their parent does not say.
                    "mask": shared & ~mask[parent],
                    "bits": bits,
                    "start": start,
                    "end": end,
                    "from": below[np.concatenate([start, [owner.size]])],
                }
            )
            below = below[np.concatenate([start, [owner.size]])]
            shared, bits, owner = mask, both & mask, owner[start]
            if (np.diff(owner) != 0).all():
                break
        self.root_mask, self.root_bits = shared, bits

    def search(self, distance: int) -> np.ndarray:
        """Class of each fingerprint: its least member's place."""
        n = self.fps.size
        label = np.arange(n)
        near = np.flatnonzero(
            np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= distance
        )
        same = self._group_of(near) == self._group_of(near + 1)
        join_classes(label, near[same], near[same] + 1)
        for at in range(0, n, SEARCH_BLOCK):
            for level in self.levels:
                level["low"] = np.minimum.reduceat(label, level["from"][:-1])
                level["high"] = np.maximum.reduceat(label, level["from"][:-1])
            self._search(np.arange(at, min(n, at + SEARCH_BLOCK)), label, distance)
        return label

    def _group_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.levels[-1]["from"], at, "right") - 1

    def _search(self, who: np.ndarray, label: np.ndarray, distance: int) -> None:
        node = self._group_of(who)
        away = np.bitwise_count(
            (self.fps[who] ^ self.root_bits[node]) & self.root_mask[node]
        ).astype(np.int16)
        todo = [(len(self.levels) - 1, who, node, away)]
        while todo:
            depth, who, node, away = todo.pop()
            near = away <= distance
            who, node, away = who[near], node[near], away[near]
            level = self.levels[depth]
            # A node whose members are all in the searcher's class has nothing to add; nor has
            # one that lies before the searcher, which its members look for themselves.
            first, last = level["from"][node], level["from"][node + 1]
            low, high = level["low"][node], level["high"][node]
            new = (last - 1 > who) & ~((low == high) & (low == label[who]))
            who, node, away, first = who[new], node[new], away[new], first[new]
            if not who.size:
                continue
            if who.size > 8 * SEARCH_BLOCK:
                half = who.size // 2
                todo.append((depth, who[half:], node[half:], away[half:]))
                todo.append((depth, who[:half], node[:half], away[:half]))
                continue
            size = (level["end"] - level["start"])[node]
            who, away = np.repeat(who, size), np.repeat(away, size)
            child = np.arange(size.sum()) - np.repeat(
                np.cumsum(size) - size - level["start"][node], size
            )
            away = away + np.bitwise_count(
                (self.fps[who] ^ level["bits"][child]) & level["mask"][child]
            )
            near = away <= distance
            if depth:
                todo.append((depth - 1, who[near], child[near], away[near]))
            else:
                join_classes(label, who[near], child[near])


def _link_groups(rows: DataFrame, distance: int) -> DataFrame:
    """(a, b) links of fingerprints within the same `group`."""

    def links(fps: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        unsigned = fps.view(np.uint64)
        order = np.lexsort((gray_rank(unsigned), group))
        unsigned, group = unsigned[order], group[order]
        number = np.cumsum(np.concatenate([[False], group[1:] != group[:-1]]))
        label = GrayIndex(unsigned, number).search(distance)
        at = np.flatnonzero(label != np.arange(label.size))
        fps = unsigned.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(fps[at]), pa.array(fps[label[at]])], ["a", "b"]
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, groups, held, most = [], [], 0, GROUPED
        for batch in batches:
            groups.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held >= most:
                f, g = np.concatenate(fps), np.concatenate(groups)
                open_ = g == g[-1]  # the last group may go on
                if not open_.all():
                    yield links(f[~open_].copy(), g[~open_])
                fps, groups, held = [f[open_]], [g[open_]], int(open_.sum())
                most = max(GROUPED, 2 * held)
        if fps and sum(map(len, fps)):
            yield links(np.concatenate(fps), np.concatenate(groups))

    dealt = rows.repartition("group").sortWithinPartitions("group")
    return arrow_map(dealt.select("group", "fp"), lean(task), "a long, b long")


def _blocks(fp, bits: int, shift: int, parts: int) -> list:
    """(mask number, value) of `parts` blocks of the `bits` bits above `shift`."""
    size = bits // parts
    return [
        F.shiftrightunsigned(fp, shift + i * size).bitwiseAND(F.lit((1 << size) - 1))
        for i in range(parts)
    ]


def link_fingerprints(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) links that connect all fingerprints (column fp) within `distance` bits."""
    parts = distance + 1
    width = 64 // parts
    fp = F.col("fp")
    whole = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("block"), v.cast("long").alias("value"))
                for i, v in enumerate(_blocks(fp, width * parts, 0, parts))
            )
        )
    )
    dealt = distinct.select("fp", whole.alias("at")).select(
        "fp", F.col("at.block").alias("block"), F.col("at.value").alias("value")
    )
    large = (
        dealt.groupBy("block", "value")
        .count()
        .filter(F.col("count") > LARGE_GROUP)
        .select("block", "value", F.lit(True).alias("large"))
    )
    large = materialize(large, "large-groups")
    marked = dealt.join(large, ["block", "value"], "left")
    small = marked.filter("large is null").select(
        F.xxhash64("block", "value").alias("group"), "fp"
    )
    # The other bits of a large group's members: within `distance`, one of their blocks agrees.
    rest = []
    for i in range(parts):
        others = [j for j in range(parts) if j != i]
        sub = width // parts
        for k in range(parts):
            keys = [
                F.shiftrightunsigned(fp, j * width + k * sub)
                .bitwiseAND(F.lit((1 << (sub if k < parts - 1 else width - k * sub)) - 1))
                for j in others
            ]
            rest.append(
                F.when(F.col("block") == i, F.xxhash64("block", "value", F.lit(k), *keys))
            )
    again = marked.filter("large").select(F.explode(F.array(*rest)).alias("group"), "fp")
    groups = small.unionAll(again.filter("group is not null"))
    return _link_groups(groups, distance)


def near_duplicates(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """(doc_id, fp, component_id), a row per document: fp is the signed 64-bit fingerprint,
    component_id the least doc_id that links of at most `distance` bits reach.

    A null or empty text has the fingerprint zero, which links like any other. Rows without
    doc_id are linked too, their ids count as larger than any. Rows with the same doc_id are
    answered each. An empty table gives no rows. Other columns are not used.
    """
    marked = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fps"
    )
    edges = materialize(link_fingerprints(distinct.select("fp"), distance), "links")
    classes = components(edges)
    labelled = distinct.join(
        classes, distinct["fp"] == classes["node"], "left"
    ).select("fp", "least", F.coalesce("component", "fp").alias("class"))
    named = labelled.groupBy("class").agg(F.min("least").alias("component_id"))
    by_fp = materialize(
        labelled.join(named, "class").select("fp", "component_id"), "classes"
    )
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")
