"""Documents, chunks and runs as Parquet tables with idempotent inserts.

Files are immutable: an insert appends what an anti-join finds new, so writing the same rows again adds nothing. What a
run learns later (relations, ratings) goes to tables of its own, keyed by run_id, and is joined on reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.durable import durable
from eventloom.functions.parsing import EVENT

SCHEMAS = {
    "documents": "doc_id long, sha256 string, text string",
    "chunks": "chunk_id long, doc_id long, from_idx int, to_idx int, text string, keywords array<string>, embedding array<float>",
    "runs": "run_id long, query string, retrieved_at timestamp, events string",
    "relations": "run_id long, relations string, written_at timestamp",
    "ratings": "run_id long, ratings string, written_at timestamp",
}
RELATION = "struct<source_id:long,target_id:long,similarity:double,relation:string,relation_raw:string,_source_idx:int,_target_idx:int>"
RATING = "struct<id:long,pagerank:double,outgoing_bonus:double,score:double>"


class Catalog:
    """Tables under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        """The table, empty before the first insert."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        schema = T.StructType.fromDDL(SCHEMAS[name])
        return self.spark.read.schema(schema).parquet(self.path(name)) if files.exists(hadoop) else self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(SCHEMAS[name])]).write.mode("append").parquet(self.path(name))

    def _after(self, name: str, key: str) -> int:
        return self.table(name).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]

    def upsert_documents(self, docs: DataFrame) -> DataFrame:
        """doc_id, sha256, text of the given texts; one document for equal texts, known ones keep their id."""
        given = distinct_documents(docs)
        new = unknown(given, self.table("documents"), F.col("sha256"))
        self._append("documents", numbered(new, "doc_id", ["sha256"], self._after("documents", "doc_id")))
        return self.table("documents").join(given.select("sha256"), "sha256", "left_semi")

    def insert_chunks(self, chunks: DataFrame) -> DataFrame:
        """Chunks (doc_id, chunk_idx, from_idx, to_idx, text[, keywords, embedding]) whose text no document had before."""
        for name, kind in (("keywords", "array<string>"), ("embedding", "array<float>")):
            if name not in chunks.columns:
                chunks = chunks.withColumn(name, F.lit(None).cast(kind))
        new = unknown(first_of_equal_texts(chunks, ["doc_id", "chunk_idx"]), self.table("chunks"), F.sha2("text", 256))
        self._append("chunks", numbered(new, "chunk_id", ["doc_id", "chunk_idx"], self._after("chunks", "chunk_id")))
        return self.table("chunks")

    def chunks(self, limit: int | None = None, offset: int | None = None) -> DataFrame:
        """Chunks in order of id; an offset without a limit is ignored."""
        return page(self.table("chunks"), "chunk_id", limit, offset)

    def document_text(self, doc_id: int) -> str | None:
        row = self.table("documents").where(F.col("doc_id") == doc_id).select("text").first()
        return row[0] if row else None

    def insert_run(self, query: str, events_json: str, retrieved_at=None) -> int:
        at = F.lit(retrieved_at).cast("timestamp") if retrieved_at is not None else F.current_timestamp()
        run_id = self.table("runs").agg(F.coalesce(F.max("run_id"), F.lit(0)) + 1).first()[0]
        self._append("runs", self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(query).alias("query"), at.alias("retrieved_at"), F.lit(events_json).alias("events")))
        return run_id

    def update_run(self, run_id: int, relations: str | None = None, ratings: str | None = None) -> None:
        for name, value in (("relations", relations), ("ratings", ratings)):
            if value is not None:
                self._append(name, self.spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(value).alias(name), F.current_timestamp().alias("written_at")))

    def latest_run(self, query: str | None = None) -> DataFrame:
        """run_id, query, retrieved_at, events, relations, ratings of the newest run, of the query if one is given.

        What does not parse is an empty array. No run gives no row.
        """
        runs = self.table("runs")
        found = newest(runs.where(F.col("query") == query) if query else runs, [], "retrieved_at", "run_id")
        for name in ("relations", "ratings"):
            last = self.table(name).groupBy("run_id").agg(F.max_by(name, "written_at").alias(name))
            found = found.join(last, "run_id", "left")
        return found.select("run_id", "query", "retrieved_at", listed("events", EVENT.replace("struct<", "struct<id:long,", 1)), listed("relations", RELATION), listed("ratings", RATING))


def listed(name: str, kind: str) -> Column:
    """The array in a JSON column; what is null or does not parse is an empty one."""
    return F.coalesce(F.from_json(F.col(name), f"array<{kind}>"), F.array().cast(f"array<{kind}>")).alias(name)


def newest(runs: DataFrame, per: list[str], at: str, key: str) -> DataFrame:
    """The row of the latest time of all, or of each group; of equal times the greatest key. No rows give none."""
    if not per:
        return runs.orderBy(F.col(at).desc(), F.col(key).desc()).limit(1)
    best = runs.groupBy(*per).agg(F.max(F.struct(at, key, *[c for c in runs.columns if c not in (*per, at, key)])).alias("m"))
    return best.select(*per, *[F.col(f"m.{c}").alias(c) for c in runs.columns if c not in per])


def page(rows: DataFrame, key: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows in order of the key, ``limit`` of them after the first ``offset``; an offset without a limit is ignored."""
    ordered = rows.orderBy(key)
    return ordered if limit is None else ordered.offset(offset or 0).limit(limit)


def distinct_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """sha256, text of every different text; copies aggregate before they are shuffled, nulls drop out."""
    given = docs.select(F.col(text).alias("text")).where("text is not null").select(F.sha2("text", 256).alias("sha256"), "text")
    return given.dropDuplicates(["sha256"])


def unknown(given: DataFrame, known: DataFrame, digest: Column) -> DataFrame:
    """Rows whose digest no known row has."""
    return given.withColumn("__k", digest).join(known.select(digest.alias("__k")), "__k", "left_anti").drop("__k")


def numbered(rows: DataFrame, key: str, order: list[str], after: int = 0) -> DataFrame:
    """rows with the numbers after ``after``, in order; numbers come from counts of ranges, not from one sorted task."""
    ordered = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("__p").orderBy("__i"))
    out = ordered.withColumn("__n", within).join(F.broadcast(sizes.withColumn("__b", before)), "__p")  # a row for each range
    return out.withColumn(key, F.lit(after) + F.col("__b") + F.col("__n")).drop("__p", "__i", "__n", "__b", "n")


def first_of_equal_texts(chunks: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each text; a minimum per text, so copies aggregate before they are shuffled."""
    names = [c for c in chunks.columns if c not in ("text", *order)]
    least = chunks.groupBy("text").agg(F.min(F.struct(*order, *names)).alias("f"))
    return least.select(*[F.col(f"f.{c}").alias(c) for c in (*order, *names)], "text")
