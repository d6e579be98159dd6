"""Similar resolved cases per query, with an evidence signal.

Exact top-k and hit counts without comparing every query with every case:

1. Texts that are equal after cleaning have equal vectors. Queries with the same text and
   intent, and cases with the same text and intent, are scored once and joined back.
2. Candidates come from an inverted index cut by impact: of every term only its heaviest
   postings, about `depth` of them, are joined. A shorter list is read whole.
3. What the cut leaves out has a weight below the cut, which bounds what it can add to a pair.
   Pairs that this could still lift into the top k or the hit count are completed exactly. A
   query is finished when no case left out altogether can get there either; the others go on
   with a deeper cut.
4. Cases without any common term still rank by their intent bonus: the first k of the intent
   and the first k of all stand in for them.
5. Where the lists, so cut, still hold a good part of all pairs, which words that most texts have
   bring about, no pair is written at all: chunks of queries are multiplied with blocks of cases
   (`cells`), and a task returns k rows and the hits per query.

Long posting lists lie in parts, and a term that very many queries ask for is asked in parts, so
no join has a hot key. An index is one segment; a stored one (`case_store`) may have several,
which hold different cases and are searched each.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supportlake.functions import packs
from supportlake.functions.rules import RulePack
from supportlake.functions.text import clean_text
from supportlake.operators import cells, tfidf
from supportlake.operators.intents import weak_intent
from supportlake.operators.sampling import smallest_per_group
from supportlake.session import materialize, outliving, scratch_folder, scratch_scope

if TYPE_CHECKING:
    from supportlake.operators.case_store import CaseStore

BUCKETS_PER_OCTAVE = 8
EPS = 1e-9


def case_base(graded: DataFrame, pack: RulePack) -> DataFrame:
    """Usable threads as cases: root text, last brand text, weak intent."""
    cases = graded.filter(F.col("tier") == packs.USABLE).select(
        F.col("thread_id").alias("case_id"),
        F.col("root_text").alias("customer_problem"),
        clean_text(F.col("root_text")).alias("cleaned_problem"),
        F.coalesce("last_brand_text", F.lit("")).alias("resolution"),
    )
    return weak_intent(cases, "cleaned_problem", pack).drop("label_confidence")


def label_if_missing(cases: DataFrame, pack: RulePack) -> DataFrame:
    """Weak labels for every case as soon as one has no intent."""
    if cases.filter(F.col("intent").isNull()).limit(1).count() == 0:
        return cases
    return weak_intent(cases, "cleaned_problem", pack).drop("label_confidence")


def _text_key(*cols: str) -> Column:
    """Group id of equal values; 128 bits, so different texts do not meet."""
    parts = [F.coalesce(F.col(c), F.lit("\u0000")) for c in cols]
    return F.md5(F.concat_ws("\u0001", *parts))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Written rows with a number `qid`: a search's tables have it once per term and per pair, where
    a key would take four times the bytes."""
    return materialize(rows.withColumn("qid", F.monotonically_increasing_id()), name)


def first_ids(cases: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(gid, case_id): the first k case ids of every group in `found`."""
    wanted = found.select("gid").distinct()
    members = cases.select("gid", "case_id").join(wanted, "gid", "left_semi")
    return smallest_per_group(members, ["gid"], [F.col("case_id")], k)


class Segment:
    """What a search reads of some cases, as written tables.

    cases     (case_id, gid, cleaned_problem, intent, ...)
    groups    one row per distinct (text, intent): size and its first case id
    postings  (term, part, gid, tf, weight, bucket), bucket 0 the heaviest
    terms     (term, listed, parts, then): length of the list and its parts, idf at writing
    lengths   (term, bucket, upto): how many postings there are up to a bucket
    stats     (term, df, idf) of all segments together; df counts cases, as the weights need
    scales    (gid, scale), or None: what a case's weights are to be multiplied with, where
              idf has moved since the segment was written; `drift` is the largest of them
    """

    cases: DataFrame
    groups: DataFrame
    postings: DataFrame
    terms: DataFrame
    lengths: DataFrame
    stats: DataFrame
    scales: DataFrame | None = None
    drift: float = 1.0
    settings: tfidf.Vectorizer
    longest: int

    def long_lists(self, depth: int) -> DataFrame:
        """Terms with more than `depth` postings: the first bucket not read and the weight
        no posting from there on exceeds."""
        over = self.lengths.filter(F.col("upto") > depth)
        return over.groupBy("term").agg(F.min("bucket").alias("cut")).withColumn(
            "below", F.pow(F.lit(2.0), -F.col("cut") / F.lit(float(BUCKETS_PER_OCTAVE)))
        )

    def in_parts(self, facts: DataFrame) -> DataFrame:
        """Rows (term, parts, ...) once for each part of the term's list."""
        return facts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def scaled(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Sums of products of pairs (qid, gid, ...) under the present idf."""
        if self.scales is None:
            return pairs
        scale = pairs.join(self.scales, "gid")
        return scale.withColumns({c: F.col(c) * F.col("scale") for c in columns}).drop("scale")


def grouped_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with the id of their group, and the groups."""
    cases = materialize(cases.withColumn("gid", _text_key("cleaned_problem", "intent")), "cases")
    sizes = cases.groupBy("gid").agg(
        F.count("*").alias("copies"),
        F.first("cleaned_problem").alias("cleaned_problem"),
        F.first("intent").alias("case_intent"),
        F.min("case_id").alias("first_id"),
    )
    return cases, materialize(sizes, "groups")


def group_counts(groups: DataFrame, settings: tfidf.Vectorizer) -> DataFrame:
    """(id, term, tf, copies) of the groups' texts, written."""
    counts = tfidf.term_counts(groups, "gid", "cleaned_problem", settings)
    return materialize(
        counts.join(groups.select(F.col("gid").alias("id"), "copies"), "id"), "counts"
    )


def term_sizes(counts: DataFrame) -> DataFrame:
    """(term, df, listed): cases and groups that have the term."""
    return counts.groupBy("term").agg(F.sum("copies").alias("df"), F.count("*").alias("listed"))


def with_idf(sizes: DataFrame, n_cases: int) -> DataFrame:
    idf = F.log((1.0 + F.lit(n_cases)) / (1.0 + F.col("df"))) + 1.0
    return sizes.withColumn("idf", idf)


def posting_tables(
    counts: DataFrame, sizes: DataFrame, stats: DataFrame, part_rows: int
) -> tuple[DataFrame, DataFrame]:
    """`postings` and `terms` of a segment with these counts, under the idf of `stats`. sizes:
    (term, listed) of this segment alone."""
    heavy = tfidf.HeavyTerms(sizes.select("term", F.col("listed").alias("n")), part_rows)
    weights = tfidf.tfidf_weights(counts, stats, heavy=heavy)
    bucket = F.floor(-F.log2(F.least(F.col("weight"), F.lit(1.0))) * BUCKETS_PER_OCTAVE)
    postings = heavy.deal(weights, "id").select(
        "term", "part", F.col("id").alias("gid"), F.col("tf").cast("int").alias("tf"), "weight",
        F.greatest(bucket, F.lit(0)).cast("int").alias("bucket"),
    )
    terms = (
        sizes.select("term", "listed")
        .join(stats.select("term", F.col("idf").alias("then")), "term")
        .join(F.broadcast(heavy.table), "term", "left")
        .select("term", "listed", F.coalesce("heavy_parts", F.lit(1)).alias("parts"), "then")
    )
    return postings, terms


def list_lengths(postings: DataFrame) -> DataFrame:
    histogram = postings.groupBy("term", "bucket").agg(F.count("*").alias("n"))
    running = Window.partitionBy("term").orderBy("bucket")  # one row per bucket
    return histogram.withColumn("upto", F.sum("n").over(running)).drop("n")


class CaseIndex(Segment):
    """Index over a case table (case_id, cleaned_problem, intent, ...), kept for this
    application."""

    def __init__(
        self, cases: DataFrame, settings: tfidf.Vectorizer = tfidf.RETRIEVE,
        part_rows: int = tfidf.PART_ROWS,
    ):
        self.settings = settings
        self.cases, self.groups = grouped_cases(cases)
        n_cases = self.cases.count()
        folder = scratch_folder(cases.sparkSession)
        with scratch_scope(cases.sparkSession):  # counts go when the lists are written
            counts = group_counts(self.groups, settings)
            stats = with_idf(term_sizes(counts), n_cases)
            self.stats = outliving(folder, stats, "stats")
            postings, terms = posting_tables(counts, self.stats, self.stats, part_rows)
            self.postings = outliving(folder, postings, "postings")
            self.terms = outliving(folder, terms, "terms")
        self.lengths = materialize(list_lengths(self.postings), "lengths")
        self.longest = int(self.stats.agg(F.max("listed")).first()[0] or 0)

    def segments(self) -> list[Segment]:
        return [self]


#: Queries with the same term that are joined in one task.
ASKED_ROWS = 16_384
#: Lists are joined if what is read of them is less than one in so many of all pairs: a joined
#: row is shuffled, grouped and written, a multiplied pair is a few operations in memory.
PAIR_SHARE = 512
#: Queries and cases that a cell holds, and entries of their rows.
CHUNK_ROWS, CHUNK_ENTRIES = 8_192, 1_000_000
BLOCK_ROWS, BLOCK_ENTRIES = 16_384, 1_000_000


def _query_terms(queries: DataFrame, index: Segment) -> DataFrame:
    """(qid, term, weight) under the index vocabulary, written."""
    folder = scratch_folder(queries.sparkSession)
    with scratch_scope(queries.sparkSession):  # counts go when the weights are written
        counts = materialize(
            tfidf.term_counts(queries, "qid", "cleaned_text", index.settings), "asked-counts"
        )
        asked = counts.groupBy("term").agg(F.count("*").alias("n"))
        heavy = tfidf.HeavyTerms(asked, ASKED_ROWS)
        weights = tfidf.tfidf_weights(counts, index.stats, heavy=heavy)
        return outliving(folder, weights.select(F.col("id").alias("qid"), "term", "weight"), "terms")


def _asked_facts(
    terms: DataFrame, index: Segment, depth: int | None
) -> tuple[DataFrame, DataFrame, tfidf.HeavyTerms]:
    """facts (term, tid, listed, asked, parts, cut, below), a row per asked term that the segment
    lists, with a number and how many ask for it; the query terms (qid, term, salt, weight) with
    their cut, weights under the idf at writing; and how the terms are dealt."""
    asked = materialize(terms.groupBy("term").agg(F.count("*").alias("n")), "asked")
    heavy = tfidf.HeavyTerms(asked, ASKED_ROWS)
    facts = (
        asked.select("term", F.col("n").alias("asked"))
        .join(index.terms, "term")
        .join(index.stats.select("term", "idf"), "term")
        .withColumn("ratio", F.col("idf") / F.col("then"))
        .drop("idf", "then")
    )
    none = F.lit(None)
    if depth is None:
        facts = facts.withColumns({"cut": none.cast("int"), "below": none.cast("double")})
    else:
        facts = facts.join(index.long_lists(depth), "term", "left")
    facts = materialize(facts.withColumn("tid", F.monotonically_increasing_id()), "facts")
    marked = (
        heavy.deal(terms, "qid", "salt")
        .join(heavy.spread(facts, "salt"), ["term", "salt"])
        .withColumn("weight", F.col("weight") * F.col("ratio"))
        .drop("ratio")
    )
    return facts, marked, heavy


def _dense_lists(facts: DataFrame, read: Column, queries: DataFrame, index: Segment) -> bool:
    """Whether reading `read` postings of each term's list for every query that asks for it would
    come near to comparing all pairs."""
    rows = facts.agg(F.sum(F.col("asked") * read)).first()[0] or 0
    return rows * PAIR_SHARE > queries.count() * index.groups.count()


def _in_cells(
    queries: DataFrame, asked: tuple[DataFrame, DataFrame, tfidf.HeavyTerms], index: Segment,
    task, schema: str, fold=None,
) -> DataFrame:
    """Queries (qid, ...) and groups of cases, each with `terms` and `weights`, its sparse row over
    the asked terms that the segment lists, a case's under the present idf, handed to `task` by
    chunks and blocks. Lists are read where they lie."""
    facts, marked, _ = asked
    read = index.postings.join(
        index.in_parts(facts.select("term", "tid", "parts")), ["term", "part"]
    ).select("gid", "tid", "weight")
    groups = index.groups.select("gid", "first_id", "copies", "case_intent")
    size = facts.agg(F.sum("asked").alias("asked"), F.sum("listed").alias("listed")).first()
    chunks = cells.parts(queries.count(), CHUNK_ROWS, size["asked"] or 0, CHUNK_ENTRIES)
    blocks = cells.parts(groups.count(), BLOCK_ROWS, size["listed"] or 0, BLOCK_ENTRIES)
    left = cells.packed_sparse(queries, marked.select("qid", "tid", "weight"), "qid", chunks, "chunk")
    right = cells.packed_sparse(groups, index.scaled(read, "weight"), "gid", blocks, "block")
    return cells.meet_packed(left, right, task, schema, fold)


def _score_cells(
    queries: DataFrame, asked: tuple[DataFrame, DataFrame, tfidf.HeavyTerms], index: Segment,
    k: int, intent_weight: float,
) -> tuple[DataFrame, DataFrame]:
    """As `_score_groups`, by multiplying all queries with all groups."""
    spark = queries.sparkSession

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=["qid", "gid", "first_id", "sim", "final", "hits"])
        c = cells.by_first_id(c)
        return cells.best_cases(q, c, cells.sparse_scores(q, c), k, intent_weight)

    id_kind = dict(index.groups.dtypes)["first_id"]
    schema = f"qid long, gid string, first_id {id_kind}, sim double, final double, hits long"
    fold = lambda found: cells.best_of(found, k)
    folder = scratch_folder(spark)
    with scratch_scope(spark):  # both sides go when the best are written
        met = _in_cells(queries.select("qid", "intent"), asked, index, cell, schema, fold)
        found = outliving(folder, met, "cells")
    order = [F.desc(F.round("final", 9)), F.asc("first_id")]
    place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    top = found.withColumn("place", place).filter(F.col("place") <= k)
    hits = found.groupBy("qid").agg(F.sum("hits").alias("relevant_hit_count"))
    return top.select("qid", "gid", "place", "sim", "final"), hits


def _candidates(
    asked: tuple[DataFrame, DataFrame, tfidf.HeavyTerms], index: Segment
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the index finds when cut as `asked` says.

    pairs   (qid, gid, low, short): `low` sums all postings read, so it is at most the
            similarity; `short` sums those of uncut terms
    bounds  (qid, bound): what postings not read can add to any pair of the query; queries
            without cut terms have no row
    long    (qid, term, parts, weight) of the cut terms

    Only what is read of a list, at most `depth` postings, leaves the place where it lies.
    """
    facts, marked, heavy = asked
    marked = materialize(marked, "marked")
    read = (
        index.postings.join(index.in_parts(facts.select("term", "parts", "cut")), ["term", "part"])
        .filter(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))
        .select("term", "gid", F.col("weight").alias("w"))
    )
    product = F.col("weight") * F.col("w")
    uncut = F.when(F.col("cut").isNull(), product).otherwise(F.lit(0.0))
    pairs = (
        marked.join(heavy.spread(read, "salt"), ["term", "salt"])
        .groupBy("qid", "gid")
        .agg(F.sum(product).alias("low"), F.sum(uncut).alias("short"))
    )
    long = marked.filter(F.col("cut").isNotNull())
    bounds = long.groupBy("qid").agg(
        F.least(
            F.sum(F.col("weight") * F.col("below")) * F.lit(index.drift),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))) * F.lit(index.drift),
        ).alias("bound")
    )
    return index.scaled(pairs, "low", "short"), bounds, long.select("qid", "term", "parts", "weight")


def _common(pairs: DataFrame, terms: DataFrame, index: Segment) -> DataFrame:
    """(qid, gid, more): what the terms (qid, term, parts, weight) add to the similarity of the
    given pairs (qid, gid). Each needed posting is looked up in its part of the list; lists are
    not moved as a whole."""
    wanted = pairs.join(terms, "qid").withColumn(
        "part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int")
    )
    listed = index.postings.select("term", "part", "gid", F.col("weight").alias("w"))
    more = (
        wanted.join(listed, ["term", "part", "gid"])
        .groupBy("qid", "gid")
        .agg(F.sum(F.col("weight") * F.col("w")).alias("more"))
    )
    return index.scaled(more, "more")


def _stand_ins(queries: DataFrame, index: Segment, k: int) -> DataFrame:
    """(qid, gid) of the first k groups of the query's intent and the first k of all."""
    by_intent = smallest_per_group(
        index.groups.select("gid", "case_intent", "first_id"),
        ["case_intent"],
        [F.col("first_id")],
        k,
    ).select("gid", F.col("case_intent").alias("intent"))
    of_all = index.groups.orderBy("first_id").limit(k)
    everywhere = of_all.agg(F.collect_list("gid").alias("gids")).scalar()
    return (
        queries.join(by_intent, "intent")
        .select("qid", "gid")
        .unionByName(queries.select("qid", F.explode(everywhere).alias("gid")))
    )


def _hit(sim: str) -> Column:
    hit = F.when(F.col("counts") & (F.col(sim) >= packs.HIT_SIMILARITY), F.col("copies"))
    return F.coalesce(hit, F.lit(0))


def _decide_pairs(
    scored: DataFrame, bounds: DataFrame, index: Segment, long: DataFrame, k: int
) -> tuple[DataFrame, DataFrame]:
    """The pairs whose place among the first k or whose hit is not settled by low and
    low + bound, with exact `sim`; and (qid, hit) of the settled rest. The first k of a query
    are always among the former."""
    floor = (F.col("low") + F.col("bonus")).alias("floor")
    nearest = smallest_per_group(scored.select("qid", floor), ["qid"], [F.desc("floor")], k)
    kth = nearest.groupBy("qid").agg(F.count("*").alias("n"), F.min("floor").alias("kth"))
    reach = F.col("low") + F.coalesce("bound", F.lit(0.0))
    unsettled = (
        (F.col("n") < k)
        | (reach + F.col("bonus") >= F.col("kth") - EPS)
        | (
            F.col("counts")
            & (F.col("low") < packs.HIT_SIMILARITY)
            & (reach >= packs.HIT_SIMILARITY - EPS)
        )
    )
    judged = (
        scored.join(bounds, "qid", "left")
        .join(kth, "qid")
        .withColumn("unsettled", unsettled)
        .drop("bound", "n", "kth")
    )
    open_pairs = materialize(judged.filter("unsettled"), "open-pairs")
    more = _common(open_pairs.select("qid", "gid"), long, index)
    completed = (
        open_pairs.drop("sim")
        .join(more, ["qid", "gid"], "left")
        .withColumn("sim", F.col("short") + F.coalesce("more", F.lit(0.0)))
        .drop("more")
    )
    rest = judged.filter(~F.col("unsettled")).select("qid", _hit("low").alias("hit"))
    settled = rest.filter(F.col("hit") > 0).groupBy("qid").agg(F.sum("hit").alias("hit"))
    return materialize(completed, "completed"), settled


def _score_groups(
    queries: DataFrame, terms: DataFrame, index: Segment, k: int, intent_weight: float, depth: int
) -> tuple[DataFrame, DataFrame]:
    """Top-k groups (qid, gid, place, sim, final) and hits (qid, relevant_hit_count) of
    distinct queries (qid, intent) with `terms` (qid, term, weight)."""
    intents = index.groups.select(F.col("case_intent").alias("intent")).distinct()
    facts = index.groups.select("gid", "case_intent", "copies", "first_id")
    zero = F.lit(0.0)
    tops: list[DataFrame] = []
    hits: list[DataFrame] = []
    rest = queries
    while True:
        last = index.longest <= depth
        asked = _asked_facts(terms, index, depth)
        if _dense_lists(asked[0], F.least("listed", F.lit(depth)), rest, index):
            top, hit_counts = _score_cells(rest, asked, index, k, intent_weight)
            tops.append(top)
            hits.append(hit_counts)
            break
        pairs, bounds, long = _candidates(asked, index)
        stand_ins = _stand_ins(rest, index, k).withColumns({"low": zero, "short": zero})
        same = F.coalesce(F.col("case_intent") == F.col("intent"), F.lit(False))
        scored = (
            pairs.unionByName(stand_ins)
            .groupBy("qid", "gid")
            .agg(F.max("low").alias("low"), F.max("short").alias("short"))
            .join(rest.select("qid", "intent"), "qid")
            .join(facts, "gid")
            .select(
                "qid", "gid", "first_id", "copies", "low", "short",
                F.when(same, F.lit(intent_weight)).otherwise(zero).alias("bonus"),
                (F.col("intent").isNull() | same).alias("counts"),
            )
        )
        scored = scored.withColumn("sim", F.col("low"))
        settled = None
        if not last:
            scored = materialize(scored, "scored")
            scored, settled = _decide_pairs(scored, bounds, index, long, k)
        final = (F.col("sim") + F.col("bonus")).alias("final")
        scored = scored.select("qid", "gid", "first_id", "sim", final, _hit("sim").alias("hit"))
        order = [F.desc(F.round("final", 9)), F.asc("first_id")]
        place = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
        top = scored.withColumn("place", place).filter(F.col("place") <= k)
        top = top.select("qid", "gid", "place", "sim", "final")
        hit_rows = scored.select("qid", "hit")
        if settled is not None:
            hit_rows = hit_rows.unionByName(settled)
        hit_counts = hit_rows.groupBy("qid").agg(F.sum("hit").alias("relevant_hit_count"))
        if last:
            tops.append(top)
            hits.append(hit_counts)
            break
        # A query stays open while a case not found at all could enter its top k or its hits.
        kth = top.groupBy("qid").agg(F.count("*").alias("n"), F.min("final").alias("kth"))
        known = F.when(F.col("known").isNotNull(), F.lit(intent_weight)).otherwise(zero)
        open_ = (
            bounds.join(rest.select("qid", "intent"), "qid")
            .join(intents.withColumn("known", F.lit(True)), "intent", "left")
            .join(kth, "qid", "left")
            .filter(
                (F.coalesce("n", F.lit(0)) < k)
                | (F.col("bound") + known >= F.col("kth") - EPS)
                | (F.col("bound") >= packs.HIT_SIMILARITY - EPS)
            )
            .select("qid")
        )
        open_ = materialize(open_, "open")
        tops.append(top.join(open_, "qid", "left_anti"))
        hits.append(hit_counts.join(open_, "qid", "left_anti"))
        if open_.limit(1).count() == 0:
            break
        rest = rest.join(open_, "qid", "left_semi")
        terms = materialize(terms.join(open_, "qid", "left_semi"), "terms")
        depth *= 8
    top, hit = tops[0], hits[0]
    for a, b in zip(tops[1:], hits[1:]):
        top, hit = top.unionByName(a), hit.unionByName(b)
    return top, hit


def retrieve(
    queries: DataFrame,
    index: CaseIndex | CaseStore,
    k: int = 3,
    intent_weight: float = packs.INTENT_WEIGHT,
    depth: int = 1024,
) -> DataFrame:
    """Long form (query_id, rank, case_id, ..., similarity, final_score, relevant_hit_count).

    `queries` has query_id, cleaned_text, intent (null: no bonus, every hit counts). Ranked by
    final score to nine digits, then case id. `similarity` and `final_score` are unrounded.
    Every segment of the index is searched; the first k of all are among the first k of each.
    """
    return with_cases(rank_cases(queries, index, k, intent_weight, depth), index)


def rank_cases(
    queries: DataFrame,
    index: CaseIndex | CaseStore,
    k: int = 3,
    intent_weight: float = packs.INTENT_WEIGHT,
    depth: int = 1024,
) -> DataFrame:
    """As `retrieve`, as a written table without the cases' columns, for `with_cases`: k rows per
    query are ids and numbers, while the texts of a case lie once in the index. What the search
    writes on its way is deleted when the ranks are written."""
    spark = queries.sparkSession
    folder = scratch_folder(spark)
    with scratch_scope(spark):
        keyed = materialize(
            queries.select(
                "query_id", "cleaned_text", "intent", _text_key("cleaned_text", "intent").alias("key")
            ),
            "queries",
        )
        distinct = keyed.groupBy("key").agg(
            F.first("cleaned_text").alias("cleaned_text"), F.first("intent").alias("intent")
        )
        distinct = _numbered(distinct, "distinct")
        terms, expanded, hits = None, None, None
        for segment in index.segments():
            if terms is None:
                terms = _query_terms(distinct, segment)
            top, found = _score_groups(distinct, terms, segment, k, intent_weight, depth)
            top = materialize(top, "top")
            rows = (
                top.join(first_ids(segment.cases, top, k), "gid")
                .select("qid", "sim", "final", "case_id")
                .join(segment.cases.select("case_id", _case_key()), "case_id")
            )
            expanded = rows if expanded is None else expanded.unionByName(rows)
            hits = found if hits is None else hits.unionByName(found)
        hits = hits.groupBy("qid").agg(F.sum("relevant_hit_count").alias("relevant_hit_count"))
        rank = F.row_number().over(
            Window.partitionBy("qid").orderBy(F.desc(F.round("final", 9)), F.asc("case_id"))
        )  # at most k groups of k ids for each segment
        ranked = expanded.withColumn("rank", rank).filter(F.col("rank") <= k).join(hits, "qid")
        asked = keyed.select("query_id", "key", F.col("intent").alias("predicted_intent")).join(
            distinct.select("key", "qid"), "key"
        )
        out = asked.join(ranked, "qid").select(
            "query_id",
            "predicted_intent",
            "rank",
            "case_id",
            "case_key",
            F.col("sim").alias("similarity"),
            F.col("final").alias("final_score"),
            F.col("relevant_hit_count").cast("bigint").alias("relevant_hit_count"),
        )
        return outliving(folder, out, "ranked")


CASE_COLUMNS = ("intent", "customer_problem", "resolution")


def _case_key() -> Column:
    """Stands for the columns of a case, also where ids repeat."""
    return _text_key(*CASE_COLUMNS).alias("case_key")


def with_cases(ranked: DataFrame, index: CaseIndex | CaseStore) -> DataFrame:
    """The rows of `rank_cases` with the columns of their cases."""
    cases = None
    for segment in index.segments():
        some = segment.cases.select("case_id", *CASE_COLUMNS)
        cases = some if cases is None else cases.unionByName(some)
    of = cases.select("*", _case_key()).groupBy("case_id", "case_key").agg(
        *[F.first(c).alias(c) for c in CASE_COLUMNS]
    )
    return ranked.join(of.withColumnRenamed("intent", "case_intent"), ["case_id", "case_key"]).select(
        "query_id",
        "predicted_intent",
        "rank",
        "case_id",
        "case_intent",
        "customer_problem",
        "resolution",
        "similarity",
        "final_score",
        "relevant_hit_count",
    )


def coverage(ranked: DataFrame) -> DataFrame:
    """One row per query: evidence tier and reason, and the cases as an array of at most k."""
    case = F.struct(
        "rank",
        F.col("case_id").alias("thread_id"),
        F.col("case_intent").alias("intent"),
        F.round("similarity", 4).alias("similarity"),
        F.round("final_score", 4).alias("final_score"),
        "customer_problem",
        "resolution",
    )
    per_query = ranked.groupBy("query_id", "predicted_intent").agg(
        F.max("relevant_hit_count").alias("relevant_hit_count"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("_top"),
        F.array_sort(F.collect_list(case)).alias("retrieved_cases"),
    )
    return per_query.select(
        "query_id",
        "predicted_intent",
        F.round("_top", 4).alias("top_similarity"),
        "relevant_hit_count",
        coverage_tier(F.col("_top"), F.col("relevant_hit_count")).alias("coverage_tier"),
        coverage_reason(F.col("_top"), F.col("relevant_hit_count")).alias("coverage_reason"),
        "retrieved_cases",
    )


def coverage_tier(top: Column, hits: Column) -> Column:
    return (
        F.when((top >= packs.HIGH_SIMILARITY) & (hits >= 2), F.lit("HIGH"))
        .when((top >= packs.MODERATE_SIMILARITY) | (hits >= 1), F.lit("MODERATE"))
        .otherwise(F.lit("THIN_OR_ABSENT"))
    )


def coverage_reason(top: Column, hits: Column) -> Column:
    return (
        F.when(
            (top >= packs.HIGH_SIMILARITY) & (hits >= 2),
            F.format_string(
                "Strong evidence found (%d matching cases, top similarity: %.2f).", hits, top
            ),
        )
        .when(
            (top >= packs.MODERATE_SIMILARITY) | (hits >= 1),
            F.format_string("Partial/moderate evidence found (top similarity: %.2f).", top),
        )
        .otherwise(
            F.format_string(
                "Insufficient grounding evidence in historical resolved cases "
                "(top similarity: %.2f < 0.20).",
                top,
            )
        )
    )


def similar_pairs(
    queries: DataFrame, index: CaseIndex, threshold: float = packs.HIT_SIMILARITY
) -> DataFrame:
    """Pairs of query text and case with similarity >= threshold > 0.

    One row per pair of distinct texts (and case intent), named by the smallest ids, with the
    number of equal queries and cases behind it: copies are counted, not multiplied out.

    Prefix filter: a pair that meets only in terms outside the query's prefix stays below the
    threshold, since the rest of the query vector is shorter than that. The prefix takes the
    rarest terms first, so the longest posting lists are hardly ever joined; similarities are
    then completed over all common terms. Where the prefixes' lists come near to all pairs, these
    are multiplied in cells instead, and only those that count are written.
    """
    distinct = _numbered(
        queries.groupBy(_text_key("cleaned_text").alias("key")).agg(
            F.min("query_id").alias("query_id"),
            F.count("*").alias("query_copies"),
            F.first("cleaned_text").alias("cleaned_text"),
        ).drop("key"),
        "distinct",
    )
    asked = _asked_facts(_query_terms(distinct, index), index, None)
    facts, terms, heavy = asked
    from_frequent = Window.partitionBy("qid").orderBy(F.desc("listed"), F.asc("term"))
    square = F.col("weight") * F.col("weight")
    tail = F.sqrt(F.sum(square).over(from_frequent))
    terms = materialize(
        terms.withColumn("in_prefix", tail >= threshold - EPS).select(
            "qid", "term", "salt", "parts", "weight", "in_prefix"
        ),
        "prefix",
    )
    inside = terms.filter("in_prefix").groupBy("term").agg(F.count("*").alias("asked"))
    wanted = facts.select("term", "listed").join(inside, "term")
    if _dense_lists(wanted, F.col("listed"), distinct, index):
        return _pairs_in_cells(distinct, asked, index, threshold)
    read = index.postings.join(
        index.in_parts(facts.select("term", "parts").join(inside, "term", "left_semi")),
        ["term", "part"],
    ).select("term", "gid", F.col("weight").alias("w"))
    head = (
        terms.filter("in_prefix")
        .join(heavy.spread(read, "salt"), ["term", "salt"])
        .groupBy("qid", "gid")
        .agg(
            F.sum(F.col("weight") * F.col("w")).alias("head"),
            F.sum(F.col("w") * F.col("w")).alias("seen"),
        )
    )
    outside = terms.filter(~F.col("in_prefix"))
    rest = outside.groupBy("qid").agg(F.sqrt(F.sum(square)).alias("rest"))
    # What the case has outside the terms met is no longer than the rest of a unit vector.
    reach = F.col("head") + F.coalesce("rest", F.lit(0.0)) * F.sqrt(
        F.greatest(1.0 - F.col("seen"), F.lit(0.0))
    )
    open_pairs = materialize(
        head.join(rest, "qid", "left").filter(reach >= threshold - EPS).select("qid", "gid", "head"),
        "open-pairs",
    )
    more = _common(
        open_pairs.select("qid", "gid"), outside.select("qid", "term", "parts", "weight"), index
    )
    return (
        open_pairs.join(more, ["qid", "gid"], "left")
        .select("qid", "gid", (F.col("head") + F.coalesce("more", F.lit(0.0))).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
        .join(distinct.select("qid", "query_id", "query_copies"), "qid")
        .join(index.groups.select("gid", "first_id", "case_intent", "copies"), "gid")
        .select(
            "query_id",
            "query_copies",
            F.col("first_id").alias("case_id"),
            "case_intent",
            F.col("copies").alias("case_copies"),
            "similarity",
        )
    )


def _pairs_in_cells(
    distinct: DataFrame, asked: tuple[DataFrame, DataFrame, tfidf.HeavyTerms], index: CaseIndex,
    threshold: float,
) -> DataFrame:
    """As `similar_pairs`, by multiplying all texts with all groups."""
    asking = distinct.select("qid", "query_id", "query_copies")
    columns = ["query_id", "query_copies", "case_id", "case_intent", "case_copies", "similarity"]

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=columns)
        row, col, sims = cells.pairs_above(q, c, cells.sparse_scores(q, c), threshold)
        rows = q[["query_id", "query_copies"]].iloc[row].reset_index(drop=True)
        have = c[["first_id", "case_intent", "copies"]].iloc[col].reset_index(drop=True)
        have.columns = ["case_id", "case_intent", "case_copies"]
        return pd.concat([rows, have], axis=1).assign(similarity=sims)

    asked_kind, case_kind = dict(asking.dtypes)["query_id"], dict(index.groups.dtypes)
    schema = (
        f"query_id {asked_kind}, query_copies long, case_id {case_kind['first_id']}, "
        f"case_intent {case_kind['case_intent']}, case_copies long, similarity double"
    )
    return _in_cells(asking, asked, index, cell, schema)
