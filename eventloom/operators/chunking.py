"""Breaks between sentences, their snapping to paragraphs, segments, chunks and the merge of short ones.

All of it is grouped by a key (a document), and every step after the sentence split is a window over that key or a fold
over one document's array, so one shuffle on the key serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.vectors import cosine

PERCENT = 0.95
MIN_CHARS = 2100
TOLERANCE, SHARE, SHORT_PARAGRAPH = 400, 0.6, 120


def consecutive_distance(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """rows with distance_to_next, null on the last row of a key."""
    ahead = Window.partitionBy(key).orderBy(order)
    following = F.lead(vector).over(ahead)
    return rows.withColumn("__next", following).withColumn("distance_to_next", F.when(F.col("__next").isNotNull(), 1 - cosine(F.col(vector), F.col("__next")))).drop("__next")


def breakpoints(rows: DataFrame, key: str, percent: float = PERCENT) -> DataFrame:
    """rows with threshold (the exact percentile of the key's distances) and is_break (strictly beyond it)."""
    limit = rows.groupBy(key).agg(F.percentile("distance_to_next", F.lit(percent)).alias("threshold"))
    both = rows.join(limit.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))).drop("__k")
    return both.withColumn("is_break", F.coalesce(F.col("distance_to_next") > F.col("threshold"), F.lit(False)))


def segments(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with segment: how many breaks lie before; a break is the last row of its segment."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("segment", F.coalesce(F.sum(F.col("is_break").cast("int")).over(before), F.lit(0)).cast("long"))


def snapped(breaks: Column, starts: Column, ends: Column, bounds: Column) -> Column:
    """Breaks moved to ends of paragraphs near them, sorted and distinct: a projection over one document's arrays.

    breaks: sentence numbers; starts, ends: of the sentences; bounds: ends of the paragraphs in order.
    """
    last = F.size(bounds) - 1
    paragraph_of = lambda at: F.least(last, F.size(F.filter(bounds, lambda e: e < at)))  # noqa: E731  of a sentence that ends there
    length = lambda p: F.get(bounds, p) - F.coalesce(F.get(bounds, p - 1), F.lit(0))
    reach = lambda p: F.least(F.lit(TOLERANCE), F.floor(length(p) * SHARE).cast("int"))

    def move(i: Column) -> Column:
        at = F.get(starts, i + 1)
        p = F.least(last, F.size(F.filter(bounds, lambda e: e <= at)))
        here, there = F.get(bounds, p), F.get(bounds, p + 1)
        near = (here > at) & (here <= at + reach(p))
        far = (p < last) & (there > at) & (there <= at + reach(p + 1)) & ((length(p) < SHORT_PARAGRAPH) | ~near)
        target = F.when(near, here).when(far, there)
        j = F.size(F.filter(ends, lambda e: e < target)) - 1
        new = F.greatest(F.lit(0), F.least(F.size(starts) - 2, j))
        back = paragraph_of(F.get(ends, new)) < paragraph_of(F.get(ends, i))
        return F.when(target.isNull() | (i + 1 >= F.size(starts)) | back, i).otherwise(new)

    return F.when(F.size(bounds) == 0, F.sort_array(breaks)).otherwise(F.sort_array(F.array_distinct(F.transform(breaks, move))))


def chunks(rows: DataFrame, key: str = "doc_id", order: str = "idx") -> DataFrame:
    """key, chunk_idx, from_idx, to_idx, text of the segments' sentences joined by a blank."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), F.col("sentence").alias("s"))))
    made = rows.groupBy(key, F.col("segment").alias("chunk_idx")).agg(F.min(order).alias("from_idx"), F.max(order).alias("to_idx"), parts.alias("p"))
    return made.select(key, "chunk_idx", "from_idx", "to_idx", F.array_join(F.transform("p", lambda x: x.s), " ").alias("text"))


def merge_short(made: DataFrame, key: str = "doc_id", least: int = MIN_CHARS) -> DataFrame:
    """Chunks with short neighbours absorbed, left to right.

    A chunk that is short, or whose successor is, takes its successor, then goes on while the two together stay within
    ``least`` or the next one is short. Text and to_idx grow; chunk_idx, from_idx and anything else stay those of the
    first part. The last chunk may stay short.
    """
    row = F.struct(F.col("chunk_idx"), F.col("from_idx"), F.col("to_idx"), F.col("text"), F.length("text").alias("n"))
    held = made.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("c"))
    # state: finished chunks, the open one, whether it is still taking
    start = F.struct(F.slice("c", 1, 0).alias("done"), F.get("c", F.lit(0)).alias("open"), F.lit(False).alias("taken"))

    def step(s: Column, x: Column) -> Column:
        takes = F.when(s.taken, (s.open.n + x.n <= least) | (x.n < least)).otherwise((s.open.n < least) | (x.n < least))
        text = F.concat(s.open.text, F.lit(" "), x.text)
        grown = F.struct(s.open.chunk_idx.alias("chunk_idx"), s.open.from_idx.alias("from_idx"), x.to_idx.alias("to_idx"), text.alias("text"), F.length(text).alias("n"))
        return F.when(takes, F.struct(s.done.alias("done"), grown.alias("open"), F.lit(True).alias("taken"))).otherwise(
            F.struct(F.concat(s.done, F.array(s.open)).alias("done"), x.alias("open"), F.lit(False).alias("taken"))
        )

    folded = F.aggregate(F.slice("c", F.lit(2), F.size("c")), start, step, lambda s: F.concat(s.done, F.array(s.open)))
    return held.select(key, F.explode(folded).alias("m")).select(key, "m.chunk_idx", "m.from_idx", "m.to_idx", "m.text")
