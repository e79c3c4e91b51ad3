"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of an item (all its words, if fewer). Each window is a set of word shingles that a
document must contain whole, so under any global order one prefix shingle of the window has to occur in the document.
Shingles are ordered by how often the whole corpus has them; the rarest one of each window is joined with the
document's shingles. The position of the match fixes where the window would have to lie (positional bound), the
document must have enough words around it (length bound), and the words there are compared one by one.

Documents are read three times (rarity, join, word counts) and never shuffled whole: only counts of benchmark shingles,
verified hits and one row of counts for each document move. The benchmark side is broadcast when its measured bytes
stay under ``broadcast_bytes``; beyond that, document shingles are first held against a bitmap of the rarest shingles
(2**26 bits, 8 MB, broadcast at any size of the benchmark), and those that pass travel with the few words around them
and are joined by shuffle.

Defined results: null or wordless texts and items have no words and no hits; repeated rows are judged alike; rows that
share an id but not a text are judged separately; item ids of repeated items count once. Only the id and text columns
are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.sqltext import plain_words

WINDOW = 10
SHINGLE = 3


def _shingle(words: Column, at: Column, k: int) -> Column:
    """Hash of k words from position ``at`` (from 0); verified later, so a collision costs only a comparison."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id (string), wid, wlen, wwords, k: the windows of every item; k is the shingle length in use."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), plain_words(F.col(text)).alias("iwords")).where(F.size("iwords") > 0)
    wlen = F.least(F.lit(WINDOW), F.size("iwords"))
    starts = words.select("item_id", "iwords", wlen.alias("wlen"), F.explode(F.sequence(F.lit(1), F.size("iwords") - wlen + 1)).alias("s"))
    return starts.select("item_id", "wlen", F.slice("iwords", F.col("s"), F.col("wlen")).alias("wwords"), F.least(F.lit(SHINGLE), F.col("wlen")).alias("k")).distinct()


def _window_shingles(windows: DataFrame, k: int) -> DataFrame:
    """Every shingle of every distinct window with its offset."""
    own = windows.where(F.col("k") == k).select("wwords", "wlen").distinct()
    placed = own.select("wwords", "wlen", F.explode(F.sequence(F.lit(0), F.col("wlen") - k)).alias("off"))
    return placed.select("wwords", "wlen", "off", _shingle(F.col("wwords"), F.col("off"), k).alias("sh"))


def _document_shingles(words: DataFrame, k: int) -> DataFrame:
    """One row for each position that has k words from it on; the word array stays a reference until a row is kept."""
    rows = words.select("*", F.posexplode("words").alias("pos", "word")).where(F.col("pos") + k <= F.size("words"))
    return rows.withColumn("sh", _shingle(F.col("words"), F.col("pos"), k))


#: Bits of the bitmap of shingles.
BITS = 26


def _may_be_in(rows: DataFrame, rarest: DataFrame) -> DataFrame:
    """rows whose bit of ``sh`` is set by some row of ``rarest``: all that have a partner, and few others."""
    place = F.pmod("sh", F.lit(1 << BITS)) + 1
    bits = rarest.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    both = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("bucket"))
    at = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return both.where(octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0).drop("bucket", "bits")


def find_windows(docs: DataFrame, items: DataFrame, broadcast_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Verified occurrences: doc_id, thash, start (word position from 0), wlen, item_id."""
    spark = docs.sparkSession
    windows = item_windows(items)
    words = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("thash"), plain_words(F.col(text)).alias("words"))
    # octets of the words, the arrays' offsets and headers
    held = windows.agg(F.sum(F.octet_length(F.array_join("wwords", " ")) + 16 * F.col("wlen") + 96), F.collect_set("k")).first()
    small = (held[0] or 0) <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    found = []
    for k in sorted(held[1]):
        shingles = _window_shingles(windows, k)
        seen = _document_shingles(words, k).select("sh").join(hint(shingles.select("sh").distinct()), "sh").groupBy("sh").agg(F.count("*").alias("df"))
        # a window with a shingle that no document has cannot occur: the inner join on every shingle drops it
        rarity = shingles.join(hint(seen) if small else seen, "sh", "left")
        rank = Window.partitionBy("wwords")
        rarest = (
            rarity.withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(rank))
            .where((F.col("least") > 0) & (F.col("df") == F.col("least")))
            .groupBy("wwords", "wlen")
            .agg(F.min(F.struct("off", "sh")).alias("p"))
            .select("wwords", "wlen", F.col("p.off").alias("off"), F.col("p.sh").alias("sh"))
        )
        at = _document_shingles(words, k)
        bound = (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("wlen") <= F.col("n"))
        if small:
            at = at.select("doc_id", "thash", "pos", "sh", "words", F.size("words").alias("n"))
            same = F.slice("words", F.col("pos") - F.col("off") + 1, F.col("wlen")) == F.col("wwords")
            hits = at.join(F.broadcast(rarest), (at.sh == rarest.sh) & bound & same)
        else:
            first = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
            at = _may_be_in(at, rarest)
            at = at.select("doc_id", "thash", "pos", "sh", F.size("words").alias("n"), first.alias("from"), F.slice("words", first + 1, 2 * WINDOW).alias("near"))
            same = F.slice("near", F.col("pos") - F.col("off") - F.col("from") + 1, F.col("wlen")) == F.col("wwords")
            hits = at.join(rarest, (at.sh == rarest.sh) & bound & same)
        found.append(hits.select("doc_id", "thash", (F.col("pos") - F.col("off")).alias("start"), "wlen", "wwords"))
    if not found:
        return spark.createDataFrame([], "doc_id long, thash long, start int, wlen int, item_id string")
    owners = windows.select("wwords", "item_id").distinct()
    return reduce(DataFrame.unionByName, found).join(hint(owners), "wwords").select("doc_id", "thash", "start", "wlen", "item_id")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, thash, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""
    hits = find_windows(docs, items, broadcast_bytes, doc_id, text)
    # hit words are the union of the window spans, swept in order of start
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))

    def sweep(acc: Column, s: Column) -> Column:
        to = s.start + s.wlen
        return F.struct(F.greatest(acc.to, to).alias("to"), (acc.n + F.greatest(F.lit(0), to - F.greatest(acc.to, s.start))).alias("n"))

    per_doc = hits.groupBy("doc_id", "thash").agg(F.collect_set(F.struct("start", "wlen")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    per_doc = per_doc.select(
        F.col("doc_id").alias("h_id"), F.col("thash").alias("h_hash"),
        F.aggregate(F.sort_array("spans"), zero, sweep, lambda acc: acc.n).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("ids"),
    )
    counts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("thash"), F.size(plain_words(F.col(text))).cast("long").alias("n_words"))
    both = counts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("thash") == F.col("h_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return both.select(
        "doc_id", "thash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
