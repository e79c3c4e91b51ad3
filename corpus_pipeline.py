"""Corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scans, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that it is given and returns a DataFrame; every stage but the
last returns the columns of documents. ``run`` applies them in order and writes each result, so that a stage reads
stored rows and a lost executor costs tasks, not stages.

Decisions are about rows: where rows repeat an id or have none, each is judged by its own text. A null text is clean and
unlike all others, so it stays and has no ids at the end. An empty table gives an empty table in every stage. Columns
beside those of documents stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.durable import durable
from eventloom.llm import decontam, jaccard, langid, pieces, secret_scan, toxicity
from eventloom.llm.sqltext import let

#: No single SQL statement can express the learned stages; the tests hold the stages against brute force.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is not toxic; learned from labels outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.is_held_out(F.col("doc_id")))
    return docs.where(toxicity.probability(docs, toxicity.learn(docs, labels)) < 0.5)


#: Rows (id and text hash, about 32 bytes) that may be broadcast to find them again; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def _split(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs whose (doc_id, thash) is in rows, or is not, by ``how``; null ids are equal. Texts move only if there are too
    many rows to broadcast."""
    listed = durable(rows.select(F.col("doc_id").alias("l_id"), F.col("thash").alias("l_hash")).distinct())
    side = F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed
    return docs.join(side, docs["doc_id"].eqNullSafe(side["l_id"]) & (F.xxhash64(docs["text"]) == side["l_hash"]), how)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the least id; of rows that repeat its id and text, any
    one. Documents without words stay."""
    found = durable(jaccard.joined_rows(docs.select("doc_id", "text")))
    kept = _split(docs, found.where("not is_head"), "left_anti")
    again = durable(found.where("is_head and n_shingles > 0").groupBy("doc_id", "thash").count().where("count > 1"))
    if again.isEmpty():
        return kept
    return _split(kept, again, "left_anti").unionByName(_split(kept, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _split(docs, decontam.find_windows(docs, items), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars counted anew where the text changed."""
    hidden = secret_scan.redacted(F.col("text"), F.col("source"), secret_scan.learn_from(docs))
    changed = lambda t: F.when(t.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(t).cast("long"))
    both = let(hidden, lambda t: F.struct(t.alias("text"), changed(t).alias("n_chars")))
    own = docs.select(F.struct("*").alias("row"), both.alias("new"))
    return own.select(*[F.col(f"new.{c}" if c in ("text", "n_chars") else f"row.`{c}`").alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids, round_trip of every document."""
    return pieces.encode_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", remove_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
