"""The trie of conversation prefixes, from adaptive radix trees over fixed-width turn ids.

A turn's id is `WIDTH` bytes, big-endian: a digest of role and text, then its text's number of
words. A conversation's key is its turns' ids behind one another. Keys are range-partitioned
and sorted, so that a run of consecutive keys can be one radix tree, whatever their number: nodes
grow from 4 to 16, 48 and 256 children and hold the bytes that all keys below share. A trie node
is a place in the radix tree whose byte depth is a multiple of `WIDTH`; other depths make none.

All keys below a node follow each other. So a node that has conversations outside of a run lies
on the path of the run's first or last key; every other node is whole, with all its numbers. The
nodes of those two paths, a few for each run, are added up over the runs, and their subtrees by
pointer doubling, which takes log2(depth) rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map, materialize, prepare

#: Bytes of a turn id: 16 of a digest, 4 of a number of words.
WIDTH = 20
#: A run ends with this many conversations or bytes of different keys.
RUN_ROWS, RUN_BYTES = 100_000, 8 * 1024 * 1024
#: Rows of an Arrow batch of nodes.
OUT_ROWS = 50_000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


# --- the radix tree ---------------------------------------------------------------------


class Sorted:
    """Up to 4 children, later up to 16: their bytes in order beside them."""

    __slots__ = ("bytes", "kids", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.kids, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, kid) -> "Sorted | Indexed":
        if len(self.kids) == self.room:
            larger = Sorted(16) if self.room < 16 else Indexed()
            for old, node in self:
                larger = larger.put(old, node)
            return larger.put(byte, kid)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def __iter__(self):
        return zip(self.bytes, self.kids)


class Indexed:
    """Up to 48 children: 256 bytes say which slot is whose."""

    __slots__ = ("slot", "kids")

    def __init__(self):
        self.slot, self.kids = bytearray(256), []

    def get(self, byte: int):
        at = self.slot[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid) -> "Indexed | Direct":
        if len(self.kids) == 48:
            larger = Direct()
            for old, node in self:
                larger.put(old, node)
            return larger.put(byte, kid)
        self.kids.append(kid)
        self.slot[byte] = len(self.kids)
        return self

    def __iter__(self):
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.slot) if at)


class Direct:
    """A slot for each of 256 children."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> "Direct":
        self.kids[byte] = kid
        return self

    def __iter__(self):
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


class Node:
    """`shared`: the bytes below the parent's branching byte that all keys here have in common;
    `value`: what is stored under the key that ends here."""

    __slots__ = ("shared", "value", "below")

    def __init__(self, shared: bytes, value=None):
        self.shared, self.value, self.below = shared, value, Sorted()


def _agree(a: bytes, b: bytes) -> int:
    """Number of leading bytes in which two byte strings agree."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    """Byte keys, of which one may begin another, and a value other than None for each."""

    def __init__(self):
        self.root = Node(b"")

    def put(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            shared = node.shared
            if not key.startswith(shared, at):
                agree = _agree(shared, key[at : at + len(shared)])
                lower = Node(shared[agree + 1 :], node.value)
                lower.below = node.below
                node.shared, node.value, node.below = shared[:agree], None, Sorted()
                node.below = node.below.put(shared[agree], lower)
            at += len(node.shared)
            if at == len(key):
                node.value = value
                return
            kid = node.below.get(key[at])
            if kid is None:
                node.below = node.below.put(key[at], Node(key[at + 1 :], value))
                return
            node, at = kid, at + 1


# --- one run of keys --------------------------------------------------------------------

NODE = (
    "run long, edge boolean, node binary, parent binary, turn binary, depth long, conv_id long, "
    "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "words long, ends string, ends_sha256 string"
)
_ROOT = hashlib.blake2b(b"", digest_size=16).digest()


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def run_nodes(run: int, keys: list[bytes], ids: list[list[int]]) -> dict[str, list]:
    """The trie nodes of ascending `keys`, with the ascending conversation ids of each.

    Nodes on the way to the first or last key (`edge`) may go on in another run: their sums
    over subtrees leave out what lies under other edge nodes, and `ends` has the text to hash.
    """
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.put(key, i)
    node, parent, turn, depth, words, end = [_ROOT], [-1], [b""], [0], [0], [tree.root.value]
    todo = [(tree.root, 0, b"")]  # radix node, trie node above its children, bytes beyond that
    while todo:
        above, at, rest = todo.pop()
        for byte, kid in above.below:
            path, here = rest + bytes([byte]) + kid.shared, at
            whole = len(path) - len(path) % WIDTH
            for start in range(0, whole, WIDTH):
                step = path[start : start + WIDTH]
                node.append(hashlib.blake2b(node[here] + step, digest_size=16).digest())
                parent.append(here)
                turn.append(step[:-4])
                depth.append(depth[here] + 1)
                words.append(int.from_bytes(step[-4:]))
                end.append(None)
                here = len(node) - 1
            if kid.value is not None:
                end[here] = kid.value
            todo.append((kid, here, path[whole:]))
    size = len(node)
    edge = [False] * size
    place = {i: at for at, i in enumerate(end) if i is not None}
    for last in (place[0], place[len(keys) - 1]):
        while last >= 0 and not edge[last]:
            edge[last], last = True, parent[last]
    none = 1 << 63
    convs, least = [0] * size, [none] * size
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for at in range(size - 1, -1, -1):  # children have larger numbers
        if end[at] is not None:
            own = ids[end[at]]
            convs[at] += len(own)
            least[at] = min(least[at], own[0])
        if not edge[at]:
            leaves[at] += not children[at]
            saved[at] += (convs[at] - 1) * words[at]
        up = parent[at]
        if up >= 0:
            convs[up] += convs[at]
            least[up] = min(least[up], least[at])
            if not edge[at]:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
    text = [_joined(ids[i]) if i is not None else None for i in end]
    return {
        "run": [run] * size,
        "edge": edge,
        "node": node,
        "parent": [node[p] if p >= 0 else None for p in parent],
        "turn": turn,
        "depth": depth,
        "conv_id": least,
        "parent_conv_id": [None if p < 0 or edge[p] else least[p] for p in parent],
        "n_convs": convs,
        "n_children": children,
        "n_leaves": leaves,
        "saved_tokens": saved,
        "words": words,
        "ends": [t if e else None for t, e in zip(text, edge)],
        "ends_sha256": [
            None if e else hashlib.sha256((t or "").encode()).hexdigest() for t, e in zip(text, edge)
        ],
    }


def _nodes(keyed: DataFrame, run_rows: int, run_bytes: int) -> DataFrame:
    """Nodes of the runs of (key, conv_id), sorted within their partitions."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 33
        keys, ids, rows, held = [], [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            made = pa.RecordBatch.from_pydict(run_nodes(run, keys, ids), schema=schema)
            for at in range(0, made.num_rows, OUT_ROWS):
                yield made.slice(at, OUT_ROWS)

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows >= run_rows or held >= run_bytes:
                    yield from done()
                    run, keys, ids, rows, held = run + 1, [], [], 0, 0
                if not keys or keys[-1] != key:
                    keys.append(key)
                    ids.append([])
                    held += len(key)
                ids[-1].append(conv)
                rows += 1
        if keys:
            yield from done()

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in NODE.split(", "))])
    return arrow_map(keyed, task, NODE)


# --- all conversations ------------------------------------------------------------------


def turn_lists(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of (conv_id, turn, role, text): the ids of each conversation's turns, as
    hex strings, by turn.

    A null turn comes first; turns with the same number follow their id; rows that repeat are
    turns of their own. A null role or text is empty. Rows without conv_id belong to no
    conversation and are left out. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    coded = F.concat(F.substring(digest, 1, 32), F.lower(F.lpad(F.hex(words), 8, "0")))
    return (
        rows.filter("conv_id is not null")
        .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", coded.alias("id"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "id"))).alias("turns"))
        .select("conv_id", F.col("turns.id").alias("turns"))
    )


def _subtree_sums(tree: DataFrame) -> DataFrame:
    """`tree` (node, parent, depth, n_leaves, saved_tokens) with the two numbers summed over
    each node's subtree. A round adds what lies 2^i to 2^(i+1) - 1 levels below."""
    sums = ["n_leaves", "saved_tokens"]
    state = materialize(tree.withColumnRenamed("parent", "up"), "subtrees")
    deepest, step = state.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        below = (
            state.filter("up is not null")
            .groupBy(F.col("up").alias("node"))
            .agg(*(F.sum(c).alias(f"{c}_below") for c in sums))
        )
        # The first node of a depth that goes on has one above it that is not the root.
        further = state.filter(F.col("depth") >= 2 * step).select("node", "up").join(
            state.select(F.col("node").alias("up"), F.col("up").alias("next")), "up"
        )
        state = materialize(
            state.select("node", "depth", *sums)
            .join(below, "node", "left")
            .join(further.select("node", F.col("next").alias("up")), "node", "left")
            .select(
                "node", "up", "depth",
                *((F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in sums),
            ),
            "subtrees",
        )
        step *= 2
    return state.select("node", *sums)


def _hash_pieces(pieces: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, run, ends): the texts of a node by run, with commas between
    them, are hashed as they pass by."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"node": pa.array([now], pa.binary()), "ends_sha256": [state.hexdigest()]}
            )

        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                if (node := node.as_py()) != now:
                    if state is not None:
                        yield row()
                    now, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
        if state is not None:
            yield row()

    dealt = pieces.repartition("node").sortWithinPartitions("node", "run")
    return arrow_map(dealt.select("node", "ends"), task, "node binary, ends_sha256 string")


def prefix_trie(
    sequences: DataFrame, run_rows: int = RUN_ROWS, run_bytes: int = RUN_BYTES
) -> DataFrame:
    """The trie of `sequences` (conv_id long, turns array of ids as by `turn_lists`); ids must be
    unique and not null.

    A row per node: node and parent (digests of their paths, null above the root), turn (the
    16 digest bytes of its last turn, empty at the root), depth, conv_id (least member),
    parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes in its subtree),
    saved_tokens (over its subtree, words of the last text times members but one), ends_sha256
    (of the ids of conversations that end here, ascending, comma-joined). A null or empty list
    of turns ends at the root. Without conversations there are no nodes.

    Conversations with equal turns are dealt by their id, so one that a third of all rows
    repeat is many runs; its ids are hashed in order by one task, which reads a text per run.
    """
    prepare(sequences.sparkSession)
    turns = F.array_join(F.coalesce("turns", F.expr("cast(array() as array<string>)")), "")
    keyed = materialize(sequences.select(F.unhex(turns).alias("key"), "conv_id"), "keys")
    dealt = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(_nodes(dealt, run_rows, run_bytes), "nodes")

    edges = found.filter("edge")
    merged = materialize(
        edges.groupBy("node").agg(
            F.first("parent").alias("parent"), F.first("turn").alias("turn"),
            F.first("depth").alias("depth"), F.first("words").alias("words"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        ),
        "edge-nodes",
    )
    top = merged.filter("depth = 0").select("conv_id").first()
    root = F.lit(top["conv_id"] if top else None).cast("long")
    kids = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("edge_children")
    )
    whole = materialize(
        merged.join(kids, "node", "left").withColumn(
            "n_children", F.col("n_children") + F.coalesce("edge_children", F.lit(0))
        ),
        "edge-nodes",
    )
    own = whole.select(
        "node", "parent", "depth",
        (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    ends = _hash_pieces(edges.filter("ends is not null").select("node", "run", "ends"))
    # The root is above a great many nodes; its only number that is asked for is a constant.
    names = merged.filter("depth > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("edge_parent")
    )
    columns = [
        "node", "parent", "turn", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", "ends_sha256",
    ]
    upper = (
        whole.drop("n_leaves", "saved_tokens")
        .join(_subtree_sums(own), "node")
        .join(ends, "node", "left")
        .join(names, "parent", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)))
        .withColumn("parent_conv_id", F.when(F.col("depth") == 1, root).otherwise(F.col("edge_parent")))
    )
    # Nodes right below an edge node look their parent up by run, so no key is hot.
    by_run = edges.filter("depth > 0").select("run", F.col("node").alias("parent")).join(
        names, "parent"
    )
    inner = found.filter("not edge")
    hanging = F.col("parent_conv_id").isNull() & (F.col("depth") > 1)
    below = (
        inner.filter(hanging)
        .join(by_run, ["run", "parent"])
        .withColumn("parent_conv_id", F.col("edge_parent"))
    )
    rest = inner.filter(~hanging).withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, root).otherwise(F.col("parent_conv_id"))
    )
    return upper.select(*columns).unionAll(below.select(*columns)).unionAll(rest.select(*columns))
