"""A retrieval index that is kept: segments of cases as bucketed tables under a path.

    store = CaseStore.create("/data/cases", cases)
    CaseStore.open(spark, "/data/cases").append(new_cases).merge()
    retrieval.retrieve(queries, CaseStore.open(spark, "/data/cases"))

A segment's posting lists are bucketed by (term, part), the layout that searches join on, so
lists are read where they lie. New cases are a segment of their own; what is written before
stays as it is. Inverse document frequencies are those of all segments together: a version has
one table of them, and for each older segment a factor per group of cases, by which idf has
moved its norms. Both go into a search's sums, so results equal those of an index built anew.
`merge` makes one segment of all.

A version is complete when its manifest has been renamed into place; readers open the latest
manifest, writers that fail leave tables nobody refers to. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from supportlake.operators import tfidf
from supportlake.operators.retrieval import (
    Segment,
    group_counts,
    grouped_cases,
    list_lengths,
    posting_tables,
    term_sizes,
    with_idf,
)
from supportlake.session import materialize

BUCKETS = 200
MANIFEST = "manifest-%09d.json"
#: How each table lies: bucket columns, and the order within a bucket.
LAYOUT = {
    "cases": (["gid"], ["gid"]),
    "groups": (["gid"], ["gid"]),
    "postings": (["term", "part"], ["term", "part", "bucket"]),
    "terms": (["term"], ["term"]),
    "lengths": (["term"], ["term"]),
    "stats": (["term"], ["term"]),
    "scales": (["gid"], ["gid"]),
}


class _Folder:
    """Files of a folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self.fs.exists(self.path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path))

    def _child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._child(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that is there as a whole or not at all, and never replaces another."""
        draft = self._child(f".{name}-{uuid.uuid4().hex[:8]}")
        out = self.fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self._child(name)) or not self.fs.rename(draft, self._child(name)):
            self.fs.delete(draft, False)
            raise RuntimeError(f"{name} is there already: another writer was faster")

    def delete(self, name: str) -> None:
        self.fs.delete(self._child(name), True)


class StoredSegment(Segment):
    """A segment whose tables are bucketed."""

    def __init__(self, store: "CaseStore", entry: dict):
        self.entry = entry
        self.settings = store.settings
        self.longest, self.drift = entry["longest"], entry["drift"]
        for name in ("cases", "groups", "postings", "terms", "lengths"):
            setattr(self, name, store.table(name, entry["tables"][name]))
        self.stats = store.table("stats", store.manifest["stats"])
        scales = entry["tables"].get("scales")
        self.scales = store.table("scales", scales) if scales else None


class CaseStore:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        # A list is bucketed by (term, part) and looked up by (term, part, gid).
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        settings = manifest["settings"]
        self.settings = tfidf.Vectorizer(**settings | {"stop_words": tuple(settings["stop_words"])})

    # --- making and opening -------------------------------------------------------------

    @classmethod
    def create(
        cls, path: str, cases: DataFrame, settings: tfidf.Vectorizer = tfidf.RETRIEVE,
        buckets: int = BUCKETS, part_rows: int = tfidf.PART_ROWS,
    ) -> "CaseStore":
        """Write an index of `cases` (case_id unique, cleaned_problem, intent,
        customer_problem, resolution) at `path`, where none may be."""
        if _Folder(cases.sparkSession, path).names():
            raise ValueError(f"{path} is not empty")
        blank = {
            "version": 0, "buckets": buckets, "part_rows": part_rows, "n_cases": 0, "stats": None,
            "settings": asdict(settings), "segments": [],
        }
        return cls(cases.sparkSession, path, blank).append(cases)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "CaseStore":
        """The latest version at `path`. No job runs."""
        folder = _Folder(spark, path)
        versions = [n for n in folder.names() if n.startswith("manifest-")]
        if not versions:
            raise FileNotFoundError(f"no case store at {path}")
        return cls(spark, path, json.loads(folder.read(versions[-1])))

    # --- tables -------------------------------------------------------------------------

    def _name(self, place: str) -> str:
        return f"case_store_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{place}').hex}"

    def table(self, kind: str, stored: dict) -> DataFrame:
        """A written table, known to the session's catalog with its buckets."""
        name, (keys, order) = self._name(stored["place"]), LAYOUT[kind]
        schema = StructType.fromJson(stored["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        place = f"{self.path}/{stored['place']}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(order)}) "
            f"INTO {self.manifest['buckets']} BUCKETS LOCATION '{place}'"
        )
        return self.spark.table(name)

    def _write(self, kind: str, df: DataFrame, folder: str) -> dict:
        """One file per bucket."""
        place, (keys, order) = f"{folder}/{kind}", LAYOUT[kind]
        buckets = self.manifest["buckets"]
        (
            df.repartition(buckets, *keys)
            .write.bucketBy(buckets, *keys)
            .sortBy(*order)
            .option("path", f"{self.path}/{place}")
            .saveAsTable(self._name(place))
        )
        return {"place": place, "schema": df.schema.jsonValue()}

    def segments(self) -> list[StoredSegment]:
        return [StoredSegment(self, entry) for entry in self.manifest["segments"]]

    def _publish(self, n_cases: int, stats: dict, segments: list[dict]) -> "CaseStore":
        manifest = self.manifest | {
            "version": self.manifest["version"] + 1, "n_cases": n_cases, "stats": stats,
            "segments": segments,
        }
        _Folder(self.spark, self.path).publish(
            MANIFEST % manifest["version"], json.dumps(manifest, indent=1)
        )
        return CaseStore(self.spark, self.path, manifest)

    # --- growing ------------------------------------------------------------------------

    def _segment(
        self, cases: DataFrame, groups: DataFrame, counts: DataFrame, sizes: DataFrame,
        stats: DataFrame, folder: str,
    ) -> dict:
        postings, terms = posting_tables(counts, sizes, stats, self.manifest["part_rows"])
        tables = {
            "cases": self._write("cases", cases, folder),
            "groups": self._write("groups", groups, folder),
            "postings": self._write("postings", postings, folder),
            "terms": self._write("terms", terms, folder),
        }
        lengths = list_lengths(self.table("postings", tables["postings"]))
        tables["lengths"] = self._write("lengths", lengths, folder)
        longest = sizes.agg(F.max("listed")).first()[0]
        return {"longest": int(longest or 0), "drift": 1.0, "tables": tables}

    def _rescaled(self, segment: StoredSegment, stats: DataFrame, folder: str) -> dict:
        """The segment's entry under new `stats`: how far idf has moved each group's norm.

        Weights as written are unit vectors under the old idf, so the new norm is that of the
        weights times new by old idf, and the scale its inverse. Lists stay where they lie.
        """
        moved = (
            segment.terms.join(stats.select("term", "idf"), "term")
            .withColumn("ratio", F.col("idf") / F.col("then"))
            .select("term", "parts", "ratio")
        )
        shifted = F.col("weight") * F.col("ratio")
        scales = (
            segment.postings.join(segment.in_parts(moved), ["term", "part"])
            .groupBy("gid")
            .agg((1.0 / F.sqrt(F.sum(shifted * shifted))).alias("scale"))
        )
        name = f"{folder}/{segment.entry['tables']['cases']['place'].split('/')[0]}"
        stored = self._write("scales", scales, name)
        drift = self.table("scales", stored).agg(F.max("scale")).first()[0]
        tables = segment.entry["tables"] | {"scales": stored}
        return segment.entry | {"tables": tables, "drift": max(1.0, float(drift or 1.0))}

    def append(self, cases: DataFrame) -> "CaseStore":
        """The next version, with `cases` as a segment; their case_ids must be new."""
        folder = f"v{self.manifest['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        cases, groups = grouped_cases(cases)
        counts = group_counts(groups, self.settings)
        sizes = materialize(term_sizes(counts), "sizes")
        n_cases = self.manifest["n_cases"] + cases.count()
        total = sizes.select("term", "df")
        if self.manifest["stats"]:
            before = self.table("stats", self.manifest["stats"]).select(
                "term", F.col("df").alias("df_before")
            )
            total = total.join(before, "term", "full").select(
                "term",
                (F.coalesce("df", F.lit(0)) + F.coalesce("df_before", F.lit(0))).alias("df"),
            )
        stored = self._write("stats", with_idf(total, n_cases), folder)
        stats = self.table("stats", stored)
        older = [self._rescaled(s, stats, f"{folder}/scales") for s in self.segments()]
        new = self._segment(cases, groups, counts, sizes, stats, folder)
        return self._publish(n_cases, stored, [*older, new])

    def merge(self) -> "CaseStore":
        """The next version, with all segments as one, from their lists: no text is read."""
        segments = self.segments()
        if len(segments) == 1 and segments[0].scales is None:
            return self
        folder = f"v{self.manifest['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"

        def together(tables: list[DataFrame], name: str) -> DataFrame:
            # Written before it is grouped, so that no grouping rests on the buckets of a union.
            out = tables[0]
            for more in tables[1:]:
                out = out.unionByName(more)
            return materialize(out, name)

        cases = together([s.cases for s in segments], "all-cases")
        groups = materialize(
            together([s.groups for s in segments], "all-groups")
            .groupBy("gid")
            .agg(
                F.sum("copies").alias("copies"), F.first("cleaned_problem").alias("cleaned_problem"),
                F.first("case_intent").alias("case_intent"), F.min("first_id").alias("first_id"),
            ),
            "merged-groups",
        )
        listed = together([s.postings.select("gid", "term", "tf") for s in segments], "all-lists")
        counts = materialize(
            listed.groupBy("gid", "term")
            .agg(F.max("tf").alias("tf"))
            .join(groups.select("gid", "copies"), "gid")
            .withColumnRenamed("gid", "id"),
            "merged-counts",
        )
        sizes = materialize(term_sizes(counts), "sizes")
        stored = self._write("stats", with_idf(sizes.select("term", "df"), self.manifest["n_cases"]), folder)
        stats = self.table("stats", stored)
        entry = self._segment(cases, groups, counts, sizes, stats, folder)
        return self._publish(self.manifest["n_cases"], stored, [entry])

    def vacuum(self) -> None:
        """Delete tables and manifests that the latest version does not refer to; for when no
        older version is being read."""
        latest = CaseStore.open(self.spark, self.path).manifest
        used = {MANIFEST % latest["version"], latest["stats"]["place"].split("/")[0]}
        for entry in latest["segments"]:
            used |= {t["place"].split("/")[0] for t in entry["tables"].values()}
        folder = _Folder(self.spark, self.path)
        for name in folder.names():
            if name not in used:
                folder.delete(name)
