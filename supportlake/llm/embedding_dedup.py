"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors are merged first. Unit vectors are turned so that their leading dimensions carry
most of the length. Within a label they are sorted by the first of these and cut into tiles; a
pair of tiles is compared only if their boxes in the leading dimensions are near enough. Inside a
pair the leading dimensions are multiplied first; what the others can still add is at most the
product of the two suffix norms, and pairs that cannot reach the threshold are left. What
remains is measured on the vectors as given, in double precision.

A pair of tiles is one row, so a label with a third of all rows is many tasks. A pair returns
each vector's number of links and a spanning set of links, never all links. Boxes prune, but the
method still compares all near tiles of a label: its work grows with the square of the tiles
that lie within the threshold's reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supportlake.llm.common import arrow_map, materialize
from supportlake.llm.components import components
from supportlake.llm.simhash import join_classes

THRESHOLD = 0.98
TILE = 512
#: Dimensions multiplied in one step, and dimensions of a tile's box.
STEP = 16
BOX = 8
#: Rounding of the bounds, in cosine.
SLACK = 1e-9
#: Tiles that are compared with one tile in one go.
PARTNERS = 128


def _vectors(batch: pa.RecordBatch, at: int) -> Iterator[np.ndarray | None]:
    """Each row's vector in doubles; None if it is null, empty, zero or not all finite."""
    for value in batch.column(at):
        items = value.as_py()
        x = None
        if items and None not in items:
            x = np.array(items, np.float64)
            # Scaled by the largest part, so that no square overflows or vanishes.
            if not np.isfinite(x).all() or not np.abs(x).max() > 0:
                x = None
        yield x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def keyed_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, key, size, raw): key is null where a vector links with nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, raws = [], [], []
            for x, label in zip(_vectors(batch, 1), batch.column(2).to_pylist()):
                if x is None or label is None:
                    keys.append(None)
                    sizes.append(None)
                    raws.append(None)
                else:
                    raw = x.astype("<f8").tobytes()
                    keys.append(xxhash.xxh3_128_digest(repr(label).encode() + b"\0" + raw))
                    sizes.append(x.size)
                    raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(keys, pa.binary()),
                    pa.array(sizes, pa.int64()), pa.array(raws, pa.binary()),
                ],
                ["vec_id", "label", "key", "size", "raw"],
            )

    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return arrow_map(
        rows.select("vec_id", "embedding", "label"),
        task,
        f"vec_id {id_kind}, label {label_kind}, key binary, size long, raw binary",
    )


def principal_axes(distinct: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns, by how much of the unit vectors' length they carry. Shorter vectors
    count as filled up with zeros. Tasks send sums of products, width x width numbers each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            for i, raw in enumerate(batch.column(0).to_pylist()):
                v = np.frombuffer(raw, "<f8")
                x[i, : v.size] = unit(v)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
            ["i", "row"],
        )

    parts = arrow_map(distinct.select("raw"), task, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(
        F.sum("v").alias("v")
    )
    found = cells.toArrow()
    total = np.zeros((width, width))
    total[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    total = (total + total.T) / 2
    values, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, np.argsort(-values)])


def _turned(raw: bytes, size: int, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as given (unit length), and turned."""
    x = unit(np.frombuffer(raw, "<f8").reshape(-1, size))
    return x, x @ axes[:size]


def tiles(distinct: DataFrame, axes: np.ndarray, tile: int) -> DataFrame:
    """Vectors of one label and size, near in the first axis, as one row: tile, label, size,
    low, high (box), ids, counts, raws (packed)."""
    first = np.ascontiguousarray(axes[:, 0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [
                float(unit(v := np.frombuffer(r, "<f8")) @ first[: v.size])
                for r in batch.column(4).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(5)), pa.array(at, pa.float64())],
                ["id", "label", "size", "n", "raw", "at"],
            )

    label_kind = distinct.schema["label"].dataType.simpleString()
    placed = arrow_map(
        distinct.select("id", "label", "size", "n", "raw"),
        place,
        f"id long, label {label_kind}, size long, n long, raw binary, at double",
    )
    count = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(count, "label", "size", "at").sortWithinPartitions(
        "label", "size", "at"
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []

        def made(number: int) -> pa.RecordBatch:
            size = held[0][2]
            raw = b"".join(r[4] for r in held)
            _, y = _turned(raw, size, axes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([held[0][1]], labels),
                    pa.array([size], pa.int64()),
                    pa.array([y[:, :BOX].min(0).tolist()], pa.list_(pa.float64())),
                    pa.array([y[:, :BOX].max(0).tolist()], pa.list_(pa.float64())),
                    pa.array([np.array([r[0] for r in held], "<i8").tobytes()], pa.binary()),
                    pa.array([np.array([r[3] for r in held], "<i8").tobytes()], pa.binary()),
                    pa.array([raw], pa.binary()),
                ],
                ["tile", "label", "size", "low", "high", "ids", "counts", "raws"],
            )

        for batch in batches:
            labels = batch.schema.field("label").type
            for row in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if held and (len(held) == tile or held[0][1:3] != row[1:3]):
                    yield made(number)
                    number += 1
                    held = []
                held.append(row)
        if held:
            yield made(number)

    return arrow_map(
        ordered.select("id", "label", "size", "n", "raw"),
        pack,
        f"tile long, label {label_kind}, size long, low array<double>, high array<double>, "
        "ids binary, counts binary, raws binary",
    )


def near_tiles(packed: DataFrame, threshold: float) -> DataFrame:
    """(a, b) tiles of one label and size, a <= b, whose boxes may hold a link."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    box = packed.select("tile", "label", "size", "low", "high")
    bucket = lambda x, by: F.floor(F.get(x, 0) / reach) + by
    own = box.withColumn("at", F.explode(F.sequence(bucket("low", 0), bucket("high", 0))))
    near = box.select(
        *(F.col(c).alias(c if c in ("label", "size") else f"{c}2") for c in box.columns),
        F.explode(F.sequence(bucket("low", -1), bucket("high", 1))).alias("at"),
    )
    gap = F.zip_with(
        F.zip_with("low", "high2", lambda x, y: x - y),
        F.zip_with("low2", "high", lambda x, y: x - y),
        lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), 2),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)
    return (
        own.join(near, ["label", "size", "at"])
        .filter((F.col("tile") <= F.col("tile2")) & (apart <= reach * reach))
        .select(F.col("tile").alias("a"), F.col("tile2").alias("b"))
        .distinct()
    )


def compare_tiles(
    x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray, threshold: float, own: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine >= threshold. x: unit vectors, y: the same, turned. own: both
    sides are one tile, i < j is asked for."""
    width = y.shape[1]
    rest = np.sqrt(np.maximum(0, np.cumsum(y[:, ::-1] ** 2, 1)[:, ::-1]))
    rest2 = np.sqrt(np.maximum(0, np.cumsum(y2[:, ::-1] ** 2, 1)[:, ::-1]))
    rows, cols = np.arange(len(y)), np.arange(len(y2))
    dots = np.zeros((len(y), len(y2)))
    for at in range(0, width, STEP):
        end = min(width, at + STEP)
        dots = dots + y[rows, at:end] @ y2[cols, at:end].T
        if end == width:
            break
        open_ = dots + np.outer(rest[rows, end], rest2[cols, end]) >= threshold - SLACK
        r, c = open_.any(1), open_.any(0)
        rows, cols = rows[r], cols[c]
        if not rows.size:
            return rows, cols
        dots = dots[np.ix_(r, c)]
    i, j = np.nonzero(dots >= threshold - SLACK)
    i, j = rows[i], cols[j]
    if own:
        i, j = i[i < j], j[i < j]
    ok = np.zeros(i.size, bool)
    for at in range(0, i.size, 65_536):
        part = slice(at, at + 65_536)
        ok[part] = np.einsum("ij,ij->i", x[i[part]], x2[j[part]]) >= threshold
    return i[ok], j[ok]


def meeting_tiles(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Each tile followed by the tiles it is compared with, as rows (tile, part, with, size, ids,
    counts, raws) that lie together; with is null for the tile itself. A tile with many partners
    stands once for about PARTNERS of them, so no task gets all."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "b").select(
        F.col("b").alias("tile"), F.pmod(F.xxhash64("a"), "parts").alias("part"),
        F.col("a").alias("with"),
    )
    load = packed.select(F.col("tile").alias("_tile"), "size", "ids", "counts", "raws")
    own = dealt.select("tile", "part").distinct().withColumn("with", F.lit(None).cast("long"))
    rows = own.join(load, F.col("tile") == F.col("_tile")).unionAll(
        dealt.join(load, F.col("with") == F.col("_tile"))
    )
    return rows.drop("_tile").repartition("tile", "part").sortWithinPartitions(
        "tile", "part", F.col("with").asc_nulls_first()
    )


def _links(rows: DataFrame, axes: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, n): vector, one it is joined with (or itself), number of links found here."""
    shared = rows.sparkSession.sparkContext.broadcast(axes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tile, _, partner, size, ids, counts, raws = (
                    batch.column(c)[k].as_py() for c in range(7)
                )
                if partner is None:
                    x, y = _turned(raws, size, shared.value)
                    ids1, n1 = (np.frombuffer(v, "<i8") for v in (ids, counts))
                    continue
                own, id_, n = partner == tile, ids1, n1
                x2, y2 = (x, y) if own else _turned(raws, size, shared.value)
                i, j = compare_tiles(x, y, x2, y2, threshold, own)
                if not i.size:
                    continue
                if not own:
                    id_ = np.concatenate([id_, np.frombuffer(ids, "<i8")])
                    n = np.concatenate([n, np.frombuffer(counts, "<i8")])
                    j = j + len(x)
                label, met = np.arange(id_.size), np.zeros(id_.size, np.int64)
                np.add.at(met, i, n[j])
                np.add.at(met, j, n[i])
                join_classes(label, i, j)
                at = np.flatnonzero(met)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(id_[at]), pa.array(id_[label[at]]), pa.array(met[at])],
                    ["a", "b", "n"],
                )

    return arrow_map(rows, task, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vector.

    Vectors with equal, non-null labels link where their cosine is at least `threshold`.
    Null, empty or zero vectors, ones with null or non-finite parts and ones without label link
    with nothing. Vectors of different length do not link. Repeated rows, also with the same
    vec_id, are vectors of their own and link with each other. An empty table gives no rows.
    Columns other than vec_id, embedding and label are not used.
    """
    keyed = materialize(keyed_vectors(rows), "vectors")
    distinct = materialize(
        keyed.filter("key is not null")
        .groupBy("key")
        .agg(
            F.first("label").alias("label"), F.first("size").alias("size"),
            F.first("raw").alias("raw"), F.count(F.lit(1)).alias("n"),
            F.min("vec_id").alias("least"),
        )
        .withColumn("id", F.monotonically_increasing_id()),
        "distinct-vectors",
    )
    width = distinct.agg(F.max("size")).first()[0] or 1
    axes = principal_axes(distinct, width)
    packed = materialize(tiles(distinct, axes, tile), "tiles")
    pairs = materialize(near_tiles(packed, threshold), "tile-pairs")
    links = materialize(
        _links(meeting_tiles(pairs, packed), axes, threshold), "vector-links"
    )
    classes = components(links.select("a", "b"))
    met = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("met"))
    labelled = (
        distinct.select("key", "id", "n", "least")
        .join(classes, F.col("id") == F.col("node"), "left")
        .join(met, "id", "left")
        .select(
            "key", "least", F.coalesce("component", "id").alias("class"),
            (F.coalesce("met", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    named = labelled.groupBy("class").agg(F.min("least").alias("component_id"))
    by_key = materialize(
        labelled.join(named, "class").select("key", "n_links", "component_id"), "vector-classes"
    )
    alone = keyed.filter("key is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = keyed.filter("key is not null").select("vec_id", "key").join(by_key, "key")
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionAll(alone)
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
