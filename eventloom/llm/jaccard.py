"""N-gram Jaccard join by filtering under several global token orders.

Two sets with Jaccard similarity of at least t share a token among the first ``n - ceil(t n) + 1`` tokens of both under
*any* global order. Here every order puts frequent tokens last (token counts of the whole corpus, kept in a table of
hash buckets, about one for sixteen tokens and 2**26 at most) and breaks ties by its own hash, so each order is a
different filter:

1. for each order, the sets that share a prefix token are chained in order of length, broken where lengths differ too
   much; chains that touch make that order's clusters. A token that many sets have is dealt out over salts: each salt is
   chained on its own into runs of lengths, and the few runs of all salts are joined where their lengths meet;
2. the clusters of the orders are intersected: only documents that fall together under *every* order stay candidates;
3. inside an intersection, each pair must share a prefix token under every order, and is then verified by its exact
   overlap.

Equal sets are one node throughout: a task sends the prefix of a set once however many copies it reads. What moves is
linear in the input: prefix tokens with set ids, chain edges, and the sets of candidates. A pair is never a row: pairs
are verified in blocks of about ``block`` shingles. The number of links of every set is asked for, so all pairs of an
intersection are compared: one of B blocks becomes B (B + 1) / 2 tasks, and its sets are sent B times. Nothing about
documents reaches the driver except the counts table, 64 MB at most.

Defined results: null, empty and wordless texts have no shingles and no links, and are their own component; rows are
documents, so repeated rows are copies of each other; extra columns are ignored; an empty table gives no rows. Sets are
compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.durable import durable
from eventloom.llm.components import components
from eventloom.llm.shingles import mix, shingle_groups, shingle_sets, signature

#: Tokens of the corpus for one bucket of the counts table, and the bits of its least and largest size. A smaller table
#: tells fewer rare tokens apart, which costs candidates, never links.
TOKENS_A_BUCKET, LEAST_BITS, MOST_BITS = 16, 16, 26
#: Rows of a token, by the counts table, that one salt should get.
SALTED = 2048
#: Buckets that travel as one row while counts are summed.
SLICE = 1 << 16
ORDERS = 2  # the order's number is kept in the lowest bit of keys and nodes
#: Shingles in one block of a verification task; a task holds two blocks.
BLOCK = 2_000_000
#: Candidates (48 bytes each) that may be broadcast to read their texts again; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets that a task remembers so as not to send their prefixes twice.
REMEMBERED = 200_000
_U = np.uint64


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bucket_bits(tokens: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (tokens // TOKENS_A_BUCKET).bit_length()))


def _buckets(s: np.ndarray, size: int) -> np.ndarray:
    return (s >> _U(65 - size.bit_length())).astype(np.int64)


def order_keys(s: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """Sort keys of tokens: the log of their corpus count, then this order's hash."""
    own = mix(s ^ _U(0x9E3779B97F4A7C15 * (order + 1) & (2**64 - 1)))
    return (counts[_buckets(s, len(counts))].astype(_U) << _U(56)) | (own >> _U(8))


def prefix(s: np.ndarray, counts: np.ndarray, order: int, percent: int) -> np.ndarray:
    p = prefix_length(len(s), percent)
    if p >= len(s):
        return s
    return s[np.argpartition(order_keys(s, counts, order), p - 1)[:p]]


def document_sets(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """doc_id, thash, sid, n_shingles: the id of each row's set. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes = [], []
            for s in shingle_sets(batch.column(2), k):
                sids.append(signature(s))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "thash", "sid", "n_shingles"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("thash"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, thash long, sid long, n_shingles long")


def _sum_slices(table: pa.Table) -> np.ndarray:
    total = np.zeros(SLICE, dtype=np.uint32)
    for x in table.column("counts"):
        part = zlib.decompress(x.as_py())
        total += np.frombuffer(part, dtype=np.uint8 if len(part) == SLICE else np.uint32)
    return total


def token_counts(docs: DataFrame, text: str, k: int, bits: int) -> np.ndarray:
    """Classes (eighths of a power of two) of the corpus counts of 2**bits token buckets.

    A task counts to 255 at most for a bucket, which classes it as frequent all the same. Each task sends its counts as compressed slices; they are summed in two
    levels, so that no task holds more than about the square root of all slices of a bucket range.
    """
    fan = max(1, math.isqrt(docs.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint8)
        for batch in batches:
            for tokens in shingle_groups(batch.column(0), k):
                at, n = np.unique(_buckets(tokens, len(counts)), return_counts=True)
                counts[at] = np.minimum(255, counts[at] + n)
        number = TaskContext.get().partitionId() % fan
        parts = [counts[i : i + SLICE] for i in range(0, len(counts), SLICE)]
        held = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(parts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([number] * len(held), pa.int32()), pa.array([x[1] for x in held], pa.binary())], names=["slice", "fan", "counts"])

    def add(table: pa.Table) -> pa.Table:
        packed = zlib.compress(_sum_slices(table).tobytes(), 1)
        return pa.table({"slice": table.column("slice").slice(0, 1), "fan": pa.array([0], pa.int32()), "counts": pa.array([packed], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        classes = np.minimum(255, np.log2(_sum_slices(table).astype(np.float64) + 1) * 8).astype(np.uint8)
        return pa.table({"slice": table.column("slice").slice(0, 1), "classes": pa.array([classes.tobytes()], pa.binary())})

    rows = docs.select(text).mapInArrow(run, "slice int, fan int, counts binary")
    rows = rows.groupBy("slice", "fan").applyInArrow(lambda t: add(t), "slice int, fan int, counts binary")
    classes = np.zeros(1 << bits, dtype=np.uint8)
    for at, held in rows.groupBy("slice").applyInArrow(lambda t: finish(t), "slice int, classes binary").collect():
        classes[at * SLICE : (at + 1) * SLICE] = np.frombuffer(held, dtype=np.uint8)
    return classes


def _salts(classes: np.ndarray, sid: int, salted: int) -> np.ndarray:
    """0 for tokens of few rows, else 1 or more, by the set; the higher the count, the more salts."""
    salts = np.zeros(len(classes), dtype=np.int32)
    many = np.flatnonzero(classes >= 8 * math.log2(salted))
    if len(many):
        number = np.minimum(np.exp2(classes[many] / 8) // salted + 1, 2**SALT_BITS - 1)
        salts[many] = 1 + int(mix(np.array([sid & (2**64 - 1)], dtype=_U))[0] >> 1) % number.astype(np.int64)
    return salts


#: The bits of a key that hold a salt; a key with one has its sign bit set, and the lowest bit of every key is the order.
SALT_BITS = 20
_SALT = ((1 << SALT_BITS) - 1) << 1


def _keys(tokens: np.ndarray, salts: np.ndarray, order: int) -> np.ndarray:
    keys = (tokens & _U(2**63 - 2)) | _U(order)
    hot = salts > 0
    keys[hot] = (keys[hot] & ~_U(_SALT)) | (salts[hot].astype(_U) << _U(1)) | _U(1 << 63)
    return keys


def prefix_rows(docs: DataFrame, text: str, k: int, percent: int, counts, salted: int = SALTED) -> DataFrame:
    """key, n, sid: for every order, the prefix tokens of each set, as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sent = counts.value, set()

        def flush(keys, sizes, sids, lengths):
            repeat = np.array(lengths)
            columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(sizes, dtype=np.int32), repeat), np.repeat(np.array(sids, dtype=np.int64), repeat)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "n", "sid"])

        for batch in batches:
            held, size = ([], [], [], []), 0
            for s in shingle_sets(batch.column(0), k):
                sid = signature(s)
                if not len(s) or sid in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(sid)
                for order in range(ORDERS):
                    tokens = prefix(s, table, order, percent)
                    for column, value in zip(held, (_keys(tokens, _salts(table[_buckets(tokens, len(table))], sid, salted), order), len(s), sid, len(tokens)), strict=True):
                        column.append(value)
                    size += len(tokens)
                if size > 200_000:
                    yield flush(*held)
                    held, size = ([], [], [], []), 0
            if size:
                yield flush(*held)

    return docs.select(text).mapInArrow(run, "key long, n int, sid long")


def chain_edges(rows: DataFrame, percent: int) -> DataFrame:
    """key, a, b: links of sets that share a token and follow each other in length, within a salt and from run to run."""
    own = Window.partitionBy("key").orderBy("n", "sid")
    near = lambda m, n: 100 * m >= percent * n
    before, after = F.lag(F.struct("n", "sid")).over(own), F.lead("n").over(own)
    placed = rows.select("*", before.alias("before"), after.alias("after"))
    first = ~F.coalesce(near(F.col("before.n"), F.col("n")), F.lit(False))
    last = ~F.coalesce(near(F.col("n"), F.col("after")), F.lit(False))
    hot, whole = F.col("key") < 0, F.col("key").bitwiseAND(F.lit(~_SALT))
    placed = placed.select("key", "n", "sid", F.when(~first & (F.col("before.sid") != F.col("sid")), F.col("before.sid")).alias("other"), (hot & first).alias("first"), (hot & last).alias("last"))
    placed = durable(placed.where("other is not null or first or last"))
    # the bounds of the runs of each salt; a run's first row is followed by its last one, unless it is both
    end = F.when(F.col("last"), F.struct("n", "sid")).otherwise(F.lead(F.struct("n", "sid")).over(own))
    runs = placed.where("first or last").select(whole.alias("key"), "n", "sid", "first", end.alias("end")).where("first")
    passed = Window.partitionBy("key").orderBy("n", "sid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "n", "sid", F.max("end").over(passed).alias("far")).where(near(F.col("far.n"), F.col("n")) & (F.col("far.sid") != F.col("sid")))
    return placed.where("other is not null").select("key", F.col("sid").alias("a"), F.col("other").alias("b")).unionByName(runs.select("key", F.col("sid").alias("a"), F.col("far.sid").alias("b")))


def order_clusters(rows: DataFrame, percent: int) -> DataFrame:
    """sid, c0, c1: the cluster of each set under every order; sets without a partner under some order are left out."""
    mark = F.col("key").bitwiseAND(F.lit(1))
    edges = chain_edges(rows, percent).select(F.col("a").bitwiseOR(mark).alias("a"), F.col("b").bitwiseOR(mark).alias("b"))
    found = components(edges, "a", "b")
    order = F.col("node").bitwiseAND(F.lit(1))
    own = [F.max(F.when(order == i, F.col("root"))).alias(f"c{i}") for i in range(ORDERS)]
    return found.groupBy(F.col("node").bitwiseAND(F.lit(-2)).alias("sid")).agg(*own).dropna()


#: A token in more sets than this is counted by a matrix product, one in fewer by pairs.
OFTEN = 24


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of every set of a with every set of b."""
    out = np.zeros(len(a) * len(b), dtype=np.int64)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    tokens = np.concatenate([*a, *b])
    order = np.argsort(tokens, kind="stable")  # within a token, sets stay in order: those of a before those of b
    tokens, row = tokens[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    count = np.diff(np.append(first, len(tokens)))
    often = count > OFTEN
    column = np.repeat(np.arange(len(first)), count)
    kept = ((count > 1) & ~often)[column]
    r, c = row[kept], column[kept]
    for step in range(1, min(OFTEN, len(r))):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        x, y = r[same], r[same + step]
        cross = (x < len(a)) & (y >= len(a))
        out += np.bincount(x[cross] * len(b) + (y[cross] - len(a)), minlength=len(out))
    out = out.reshape(len(a), len(b))
    columns = np.flatnonzero(often)
    width = max(64, (2 << 20) // (len(a) + len(b)))
    for i in range(0, len(columns), width):
        part = columns[i : i + width]
        dense = np.zeros((len(a) + len(b), len(part)), dtype=np.float32)
        for j, k in enumerate(part):
            dense[row[first[k] : first[k] + count[k]], j] = 1
        out += (dense[: len(a)] @ dense[len(a) :].T).astype(np.int64)
    return out


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def block_links(left: list[np.ndarray], right: list[np.ndarray], same: bool, percent: int, counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index pairs (of left, of right) of linked sets; when both sides are one block, each pair once."""
    cand = np.ones((len(left), len(right)), dtype=bool)
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    cand &= 100 * np.minimum(sizes[0][:, None], sizes[1]) >= percent * np.maximum(sizes[0][:, None], sizes[1])
    if same:
        cand &= np.arange(len(left))[:, None] < np.arange(len(right))
    for order in range(ORDERS):
        if cand.any():
            cand &= _overlaps([prefix(s, counts, order, percent) for s in left], [prefix(s, counts, order, percent) for s in right]) > 0
    if not cand.any():
        return
    rows, columns = np.flatnonzero(cand.any(1)), np.flatnonzero(cand.any(0))
    if cand.sum() <= 8 * (len(rows) + len(columns)):
        for i, j in zip(*np.nonzero(cand), strict=True):
            shared = _overlap(left[i], right[j])
            if 100 * shared >= percent * (len(left[i]) + len(right[j]) - shared):
                yield i, j
        return
    shared = _overlaps([left[i] for i in rows], [right[j] for j in columns])
    union = sizes[0][rows][:, None] + sizes[1][columns] - shared
    for i, j in zip(*np.nonzero((100 * shared >= percent * union) & cand[np.ix_(rows, columns)]), strict=True):
        yield rows[i], columns[j]


def verified(members: DataFrame, percent: int, counts) -> DataFrame:
    """sid, root, links from rows (g, i, j, side, sid, n_copies, tokens); one task for each pair of blocks."""

    def run(table: pa.Table) -> pa.Table:
        seen: dict[tuple[int, int], int] = {}
        side, sid, copies, tokens = table.column("side").to_pylist(), table.column("sid").to_pylist(), table.column("n_copies").to_pylist(), table.column("tokens")
        for at, key in enumerate(zip(side, sid, strict=True)):
            seen.setdefault(key, at)
        own = {x: [at for (y, _), at in sorted(seen.items()) if y == x] for x in (0, 1)}
        sets = {at: np.frombuffer(tokens[at].as_py(), dtype=_U) for at in seen.values()}
        same = not own[1]
        a, b = own[0], own[0] if same else own[1]
        parent, weight = {s: s for s in sid}, dict.fromkeys(sid, 0)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in block_links([sets[x] for x in a], [sets[x] for x in b], same, percent, counts.value):
            x, y = a[i], b[j]
            weight[sid[x]] += copies[y]
            weight[sid[y]] += copies[x]
            p, q = root(sid[x]), root(sid[y])
            parent[max(p, q)] = min(p, q)
        out = [(s, root(s), w) for s, w in weight.items() if w]
        return pa.table({"sid": pa.array([x[0] for x in out], pa.int64()), "root": pa.array([x[1] for x in out], pa.int64()), "links": pa.array([x[2] for x in out], pa.int64())})

    return members.groupBy("g", "i", "j").applyInArrow(lambda t: run(t), "sid long, root long, links long")


def _with_tokens(docs: DataFrame, text: str, wanted: DataFrame, doc_id: str, k: int) -> DataFrame:
    """wanted (g, sid, doc_id, n_copies, at, last) with tokens, from the texts of the documents that stand for the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            held: list[bytes | None] = []
            sids = batch.column("sid").to_pylist()
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                held.append(s.tobytes() if signature(s) == sids[i] else None)
                if len(held) == 256 or i == len(sids) - 1:
                    part = batch.slice(first, len(held)).drop_columns(["text"]).append_column("tokens", pa.array(held, pa.binary()))
                    yield part.filter(pc.is_valid(part.column("tokens")))
                    first, held = i + 1, []

    small = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnRenamed("doc_id", "w_id")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = own.join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("w_id")))
    own = own.select("g", "sid", "n_copies", "at", "last", "text")
    return own.mapInArrow(run, "g long, sid long, n_copies long, at int, last int, tokens binary")


def joined_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90, block: int = BLOCK, salted: int = SALTED) -> DataFrame:
    """doc_id, thash (xxhash64 of the text), n_shingles, component_id, n_links, is_head of every row.

    The head of a component is its row with the least id, null ids last, and of those with that id the one with the least
    hash of its text; rows that repeat the head are heads as well, and so is every row without shingles.
    """
    spark = docs.sparkSession
    rows = durable(document_sets(docs, doc_id, text, k))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("head")
    sets = durable(rows.where("n_shingles > 0").groupBy("sid", "n_shingles").agg(head, F.count("*").alias("n_copies")))
    tokens = sets.agg(F.sum(F.col("n_shingles") * F.col("n_copies"))).first()[0] or 0
    counts = spark.sparkContext.broadcast(token_counts(docs, text, k, bucket_bits(tokens)))
    # the orders' clusters intersected
    both = sets.join(order_clusters(prefix_rows(docs, text, k, percent, counts, salted), percent), "sid")
    both = durable(both.select("sid", "n_shingles", F.col("head.doc_id").alias("doc_id"), "n_copies", F.xxhash64(*[f"c{order}" for order in range(ORDERS)]).alias("g")))
    groups = both.groupBy("g").agg(F.count("*").alias("size"), F.ceil(F.sum("n_shingles") / block).cast("int").alias("blocks")).where("size > 1")
    at = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int").alias("at")
    both = durable(both.join(groups, "g").select("g", "sid", "doc_id", "n_copies", at, (F.col("blocks") - 1).alias("last")))
    meets = _with_tokens(docs, text, both, doc_id, k).select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    side = (F.col("at") > F.col("other")).cast("int").alias("side")
    meets = meets.select("g", "sid", "n_copies", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), side, "tokens")
    found = durable(verified(meets, percent, counts))
    linked = components(found, "sid", "root").select(F.col("node").alias("sid"), "root")
    per_set = sets.join(linked, "sid", "left").join(found.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left")
    per_set = per_set.withColumn("root", F.coalesce("root", "sid"))
    least = per_set.groupBy("root").agg(F.min("head").alias("first"))
    links = (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    per_set = per_set.join(least, "root").select("sid", "first", links)
    full = F.col("n_shingles") > 0
    is_head = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("thash") == F.col("first.thash"))
    return rows.join(per_set, "sid", "left").select(
        "doc_id", "thash", "n_shingles", F.when(full, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (~full | is_head).alias("is_head"),
    )


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90, block: int = BLOCK, salted: int = SALTED) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links), n_links (rows linked with this one)."""
    return joined_rows(docs, doc_id, text, k, percent, block, salted).select("doc_id", "n_shingles", "component_id", "n_links")
