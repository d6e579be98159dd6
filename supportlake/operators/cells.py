"""Scores of all pairs of a chunk of queries and a block of cases, for tasks that hold both.

A task goes through its queries in strips, so it holds no more than `STRIP` scores at once however
large chunk and block are, and keeps what a query needs: its best cases and its hits, or the pairs
above a threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from supportlake.functions import packs
from supportlake.session import materialize

#: Scores held at once.
STRIP = 4_000_000
#: A term in more than this share of a block's rows is multiplied as a column, up to so many.
COLUMN_SHARE = 1 / 64
COLUMNS = 1024
EPS = 1e-9
#: Cells are dealt over about so many tasks per core.
TASKS_PER_CORE = 4

Scores = Callable[[slice], np.ndarray]


def parts(rows: int, chunk_rows: int, entries: int = 0, chunk_entries: int = 1) -> int:
    """In how many parts of about `chunk_rows` rows and `chunk_entries` entries so many rows, which
    have so many entries together, are dealt."""
    return max(1, -(-rows // chunk_rows), -(-entries // chunk_entries))


def _part(by: str, n: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias("part")


def _packed(dealt: DataFrame, column: str) -> DataFrame:
    """Rows (part, row), dealt by part, as one row per part (an array of its rows) in a file of its
    own, so that a scan can give every part to another task."""
    whole = dealt.groupBy("part").agg(F.collect_list("row").alias(column))
    numbered = whole.select(column, F.col("part").alias(f"{column}_no"))
    return materialize(numbered, f"packed-{column}", rows_per_file=1)


def packed(rows: DataFrame, by: str, n: int, column: str) -> DataFrame:
    """Rows dealt over `n` parts by `by`, for `meet_packed`."""
    dealt = rows.select(_part(by, n), F.struct(*rows.columns).alias("row"))
    return _packed(dealt.repartition(n, "part"), column)


def packed_sparse(rows: DataFrame, entries: DataFrame, by: str, n: int, column: str) -> DataFrame:
    """As `packed`, each row with its entries (by, tid, weight) as the arrays `terms` and `weights`.
    Rows and entries are dealt together, so one exchange puts rows together and into parts."""
    row, entry = F.struct(*rows.columns).alias("row"), F.struct("tid", "weight").alias("entry")
    dealt = (
        rows.select(_part(by, n), by, row)
        .unionByName(entries.select(_part(by, n), by, entry), allowMissingColumns=True)
        .repartition(n, "part")
    )
    each = dealt.groupBy("part", by).agg(
        F.first("row", ignorenulls=True).alias("row"), F.collect_list("entry").alias("entries")
    )
    whole = [F.col("row")[c].alias(c) for c in rows.columns]
    whole += [F.col("entries.tid").alias("terms"), F.col("entries.weight").alias("weights")]
    return _packed(
        each.filter(F.col("row").isNotNull()).select("part", F.struct(*whole).alias("row")), column
    )


def _frame(part: pa.Array) -> pd.DataFrame:
    """The rows of one part."""
    return pa.RecordBatch.from_struct_array(part.flatten()).to_pandas()


def meet(
    left: DataFrame, by_left: str, chunks: int, right: DataFrame, by_right: str, blocks: int,
    task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Each chunk of `left` with each block of `right`, handed to `task`, see `meet_packed`."""
    asked = packed(left, by_left, chunks, "chunk")
    return meet_packed(asked, packed(right, by_right, blocks, "block"), task, schema, fold)


def meet_packed(
    asked: DataFrame, held: DataFrame, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str, fold: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Each chunk of `asked` with each block of `held`, handed to `task`; `fold` thins out what
    the blocks that a task meets with one chunk have given.

    Both sides were dealt and written once. The cross join reads the written parts where they lie,
    so what is shuffled and written grows with the rows, not with chunks times blocks. A task
    holds its chunks and goes through blocks one by one. With many chunks it goes through many
    blocks, so what the tasks return after the fold does not grow with chunks times blocks either.
    """
    tasks = TASKS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism
    pairs = (
        held.coalesce(max(1, -(-tasks // max(1, asked.rdd.getNumPartitions()))))
        .hint("shuffle_replicate_nl")
        .crossJoin(asked)
    )
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def out(found: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        yield from pa.Table.from_pandas(found, kinds, preserve_index=False).to_batches()

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, pd.DataFrame] = {}
        numbers, q, c = (None, None), None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch["chunk_no"][i].as_py(), batch["block_no"][i].as_py()
                q = q if now[0] == numbers[0] else _frame(batch["chunk"].slice(i, 1))
                c = c if now[1] == numbers[1] else _frame(batch["block"].slice(i, 1))
                numbers, found = now, task(q, c)
                if fold is None:
                    yield from out(found)
                elif now[0] in kept:
                    kept[now[0]] = fold(pd.concat([kept[now[0]], found], ignore_index=True))
                else:
                    kept[now[0]] = found
        for found in kept.values():
            yield from out(found)

    return pairs.mapInArrow(cells, schema)


def strips(n_rows: int, n_columns: int) -> Iterator[slice]:
    step = max(1, STRIP // max(1, n_columns))
    for start in range(0, n_rows, step):
        yield slice(start, min(n_rows, start + step))


def _flat(column: pd.Series, kind: type) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *column.to_numpy()]).astype(kind, copy=False)


def sparse_scores(q: pd.DataFrame, c: pd.DataFrame) -> Scores:
    """Dot products of sparse rows (terms, weights). Terms that many cases have are multiplied as
    columns, the others by their lists."""
    n = len(c)
    lengths = c["terms"].map(len).to_numpy(dtype=np.int64)
    term, weight = _flat(c["terms"], np.int64), _flat(c["weights"], np.float64)
    row = np.repeat(np.arange(n), lengths)
    order = np.argsort(term, kind="stable")
    term, weight, row = term[order], weight[order], row[order]
    known, start, listed = np.unique(term, return_index=True, return_counts=True)

    column = np.full(len(known), -1)
    often = np.flatnonzero(listed > n * COLUMN_SHARE)
    often = often[np.argsort(-listed[often], kind="stable")[:COLUMNS]]
    column[often] = np.arange(len(often))
    table = np.zeros((len(often), n))
    at = np.repeat(column, listed)
    table[at[at >= 0], row[at >= 0]] = weight[at >= 0]

    asked, factor = _flat(q["terms"], np.int64), _flat(q["weights"], np.float64)
    ends = np.concatenate([[0], np.cumsum(q["terms"].map(len).to_numpy(dtype=np.int64))])
    asker = np.repeat(np.arange(len(q)), np.diff(ends))
    place = np.searchsorted(known, asked)
    found = np.zeros(len(asked), dtype=bool)
    if len(known):
        place = np.minimum(place, len(known) - 1)
        found = known[place] == asked

    def scores(s: slice) -> np.ndarray:
        here = slice(ends[s.start], ends[s.stop])
        ok = found[here]
        i, p, f = asker[here][ok] - s.start, place[here][ok], factor[here][ok]
        dense = column[p] >= 0
        left = np.zeros((s.stop - s.start, len(often)))
        left[i[dense], column[p[dense]]] = f[dense]
        out = left @ table
        i, p, f = i[~dense], p[~dense], f[~dense]
        upto = np.cumsum(listed[p])
        flat = out.reshape(-1)
        first = 0
        while first < len(p):  # pieces of at most STRIP products, or one list
            before = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, before + STRIP, side="right")))
            some = slice(first, last)
            n_of = listed[p[some]]
            step = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
            one = np.repeat(start[p[some]], n_of) + step
            np.add.at(flat, np.repeat(i[some], n_of) * n + row[one], np.repeat(f[some], n_of) * weight[one])
            first = last
        return out

    return scores


def by_first_id(c: pd.DataFrame) -> pd.DataFrame:
    """Cases in the order in which ties rank."""
    return c.sort_values("first_id", kind="stable", na_position="first").reset_index(drop=True)


def best_cases(
    q: pd.DataFrame, c: pd.DataFrame, scores: Scores, k: int, intent_weight: float
) -> pd.DataFrame:
    """(qid, gid, first_id, sim, final, hits): of each query (qid, intent) the best k cases (gid,
    first_id, copies, case_intent), which lie by first id; the block's hits are on the first."""
    codes, _ = pd.factorize(pd.concat([q["intent"], c["case_intent"]]))  # null: -1
    asked, have = codes[: len(q)], codes[len(q) :]
    copies = c["copies"].to_numpy(dtype=np.float64)
    least = min(k, len(c))
    out = []
    for s in strips(len(q), len(c)):
        sims = scores(s)
        free = (asked[s] < 0)[:, None]
        same = (asked[s][:, None] == have[None, :]) & ~free
        hits = ((sims >= packs.HIT_SIMILARITY) & (same | free)).astype(np.float64) @ copies
        final = sims + np.where(same, intent_weight, 0.0)
        placed = np.where(np.isnan(final), -np.inf, final) if np.isnan(final).any() else final
        kth = np.partition(placed, len(c) - least, axis=1)[:, len(c) - least]
        row, col = np.nonzero(placed >= kth[:, None] - 2 * EPS)
        order = np.lexsort((col, -np.round(placed[row, col], 9), row))
        row, col = row[order], col[order]
        new = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row)))
        row, col, nth = row[nth < k], col[nth < k], nth[nth < k]
        out.append(
            pd.DataFrame(
                {
                    "qid": q["qid"].to_numpy()[s][row], "gid": c["gid"].to_numpy()[col],
                    "first_id": c["first_id"].to_numpy()[col], "sim": sims[row, col],
                    "final": final[row, col],
                    "hits": np.where(nth == 0, hits[row], 0).astype(np.int64),
                }
            )
        )
    return pd.concat(out)


def best_of(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """What `best_cases` gave for several blocks, as if they were one."""
    hits = found.groupby("qid", sort=False)["hits"].transform("sum")
    near = found.assign(hits=hits, near=(-found["final"].round(9)).fillna(np.inf)).sort_values(
        ["near", "first_id"], kind="stable", na_position="first"
    )
    nth = near.groupby("qid", sort=False).cumcount()
    out = near[nth < k].drop(columns="near")
    return out.assign(hits=out["hits"].where(nth[nth < k] == 0, 0))


def pairs_above(q: pd.DataFrame, c: pd.DataFrame, scores: Scores, threshold: float) -> tuple:
    """(rows, columns, scores) of the pairs with a score of at least `threshold`."""
    found = []
    for s in strips(len(q), len(c)):
        sims = scores(s)
        row, col = np.nonzero(sims >= threshold)
        found.append((row + s.start, col, sims[row, col]))
    return tuple(np.concatenate(x) for x in zip(*found))
