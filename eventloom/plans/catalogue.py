"""Registered queries over whole tables and their SQL twins.

Floats are rounded to six places on both sides, as the two engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import parsing, text
from eventloom.functions.vectors import dot, mean_pool
from eventloom.operators import chunking, clustering, context, evaluation, graph, keywords, selection, sentences
from eventloom.sources import catalog, readers


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    return F.round(c, n)


# --- documents, sentences, chunks -------------------------------------------------------------------------------------


def doc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_documents(_t(spark, sf_dir, "documents")).select("sha256", F.length("text").alias("n_chars"))


def doc_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of the different texts, in order of their digests."""
    return catalog.numbered(catalog.distinct_documents(_t(spark, sf_dir, "documents")).select("sha256"), "doc_id", ["sha256"], 100)


def doc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the scan: the limit is the feature."""
    return catalog.page(_t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest")), "doc_id", 50, 20)


def chunk_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of odd documents whose text no even document has, as an insert after theirs takes them."""
    rows = _sentences(spark, sf_dir).withColumnsRenamed({"idx": "chunk_idx", "sentence": "text"})
    new = catalog.first_of_equal_texts(rows.where("doc_id % 2 <> 0"), ["doc_id", "chunk_idx"])
    return catalog.unknown(new, rows.where("doc_id % 2 = 0").select("text"), F.sha2("text", 256)).select("doc_id", "chunk_idx", F.md5("text").alias("digest"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, sentence by the line mode, as the insert runs it."""
    return sentences.sentences(_t(spark, sf_dir, "documents"), "line").drop("start")


def chunk_text_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).withColumnsRenamed({"idx": "chunk_idx", "sentence": "text"})
    return catalog.first_of_equal_texts(rows, ["doc_id", "chunk_idx"]).select("doc_id", "chunk_idx", F.sha2("text", 256).alias("sha256"))


def sentence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir)


def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentences.context_windows(_sentences(spark, sf_dir))
    return rows.select("doc_id", "idx", F.length("combined").alias("n_chars"), F.md5("combined").alias("digest"))


HEX = "0123456789abcdef"


def _hashed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, vector: counts of the window's words by the first digit of their digest, a hashing embedder in SQL."""
    rows = _sentences(spark, sf_dir)
    digits = F.array_join(F.transform(F.split("sentence", " "), lambda w: F.left(F.md5(w), F.lit(1))), "")
    rows = rows.select("doc_id", "idx", F.length("sentence").alias("n"), digits.alias("d"))
    rows = rows.select("doc_id", "idx", "n", *[(F.length("d") - F.length(F.replace("d", F.lit(h), F.lit("")))).alias(f"v{h}") for h in HEX])
    near = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-2, 2)
    return rows.select("doc_id", "idx", "n", F.array(*[F.sum(f"v{h}").over(near) for h in HEX]).alias("vector"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines, windows, vectors, distances, percentile breaks and segments of every document."""
    rows = chunking.consecutive_distance(_hashed_windows(spark, sf_dir), "doc_id", "idx", "vector")
    rows = rows.withColumn("distance_to_next", _r(F.col("distance_to_next"), 9))
    broken = chunking.segments(chunking.breakpoints(rows, "doc_id"), "doc_id", "idx")
    made = broken.groupBy("doc_id", "segment").agg(F.min("idx").alias("from_idx"), F.max("idx").alias("to_idx"), F.sum("n").alias("n_chars"))
    return made


def _quoted(x: str) -> str:
    return x.replace("'", "''")


_STRIP = f"trim({{0}}, '{text.WHITE_SPACE}')"
#: The line mode: quote-ended sentences within a line, and the rest of the line.
_PIECES = _quoted(rf"[^{sentences.ENDS}\n]+[{sentences.ENDS}][{sentences.CLOSERS[:-1]}]\]*|[^{sentences.ENDS}\n][^\n]*")
_LINES = rf"""pieces AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '{_PIECES}') AS m FROM documents),
lines AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT - 1 AS idx FROM (
  SELECT doc_id, i, {_STRIP.format("l")} AS sentence FROM (SELECT doc_id, unnest(m) AS l, generate_subscripts(m, 1) AS i FROM pieces))
  WHERE sentence <> '' AND NOT (length(sentence) < {sentences.SHORT} AND regexp_matches(lower(sentence), '(?:{"|".join(a.replace(".", "[.]") for a in sentences.ABBREVIATIONS)})$')))"""

_WINDOWS_SQL = f"""WITH {_LINES} SELECT doc_id, idx, length(c) AS n_chars, md5(c) AS digest FROM (
  SELECT doc_id, idx, array_to_string(list(sentence) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), ' ') AS c FROM lines)"""

_SUMS = ", ".join(f"sum(length(d) - length(replace(d, '{h}', ''))) OVER w" for h in HEX)
_SEGMENTS_SQL = f"""WITH {_LINES},
d AS (SELECT doc_id, idx, length(sentence) AS n, array_to_string(list_transform(string_split(sentence, ' '), lambda x: left(md5(x), 1)), '') AS d FROM lines),
v AS (SELECT doc_id, idx, n, [{_SUMS}]::DOUBLE[] AS v FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
x AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY idx) AS u FROM v),
g AS (SELECT *, round(1 - list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))), 9) AS g FROM x),
b AS (SELECT *, coalesce(g > quantile_cont(g, 0.95) OVER (PARTITION BY doc_id), FALSE) AS b FROM g),
s AS (SELECT *, coalesce(sum(b::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM b)
SELECT doc_id, segment, min(idx) AS from_idx, max(idx) AS to_idx, sum(n)::BIGINT AS n_chars FROM s GROUP BY doc_id, segment"""


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as chunks, short ones merged."""
    rows = _sentences(spark, sf_dir)
    made = rows.select("doc_id", F.col("idx").alias("chunk_idx"), F.col("idx").alias("from_idx"), F.col("idx").alias("to_idx"), F.col("sentence").alias("text"))
    return chunking.merge_short(made).select("doc_id", "chunk_idx", "from_idx", "to_idx", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


_MERGE_SQL = f"""WITH RECURSIVE {_LINES}, c AS (SELECT doc_id, idx, sentence, length(sentence) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM lines),
f AS (SELECT doc_id, k, idx AS first, n AS held, FALSE AS taken FROM c WHERE k = 1 UNION ALL
  SELECT doc_id, k, CASE WHEN takes THEN first ELSE idx END, CASE WHEN takes THEN held + 1 + n ELSE n END, takes FROM (
    SELECT c.doc_id, c.k, f.first, f.held, c.idx, c.n, CASE WHEN taken THEN held + c.n <= {chunking.MIN_CHARS} OR c.n < {chunking.MIN_CHARS} ELSE held < {chunking.MIN_CHARS} OR c.n < {chunking.MIN_CHARS} END AS takes
    FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1)),
m AS (SELECT doc_id, first, max(idx) AS last, string_agg(sentence, ' ' ORDER BY idx) AS t FROM f JOIN c USING (doc_id, k) GROUP BY doc_id, first)
SELECT doc_id, first AS chunk_idx, first AS from_idx, last AS to_idx, length(t) AS n_chars, md5(t) AS digest FROM m"""


def snapped_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as sentences, their quantities as lengths; ends of some lines, moved a little, as ends of
    paragraphs; discounted lines as breaks."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") * 6).cast("int").alias("size"), (F.col("l_partkey") % 61 - 30).cast("int").alias("off"), (F.col("l_suppkey") % 2 == 0).alias("ends"), (F.col("l_discount") > 0.045).alias("cut"))
    before = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumns({"e": F.sum("size").over(before).cast("int"), "i": F.row_number().over(before) - 1})
    placed = placed.withColumns({"s": F.col("e") - F.col("size"), "p": F.col("e") + F.col("off")})
    held = placed.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list("e")).alias("e"), F.sort_array(F.collect_list("s")).alias("s"),
        F.sort_array(F.collect_set(F.when(F.col("ends"), F.greatest(F.lit(1), "p")))).alias("p"), F.sort_array(F.collect_list(F.when(F.col("cut"), F.col("i")))).alias("b"),
    )
    moved = chunking.snapped(F.col("b"), F.col("s"), F.col("e"), F.col("p"))
    return held.select("l_orderkey", F.array_join(moved.cast("array<string>"), ",").alias("breaks"))


_SNAPPED_SQL = """WITH l AS (SELECT l_orderkey, (l_quantity * 6)::INT AS size, (l_partkey % 61 - 30)::INT AS off, l_suppkey % 2 = 0 AS ends, l_discount > 0.045 AS cut, l_linenumber,
  (sum((l_quantity * 6)::INT) OVER w)::INT AS e, (row_number() OVER w - 1)::INT AS i FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT l_orderkey, list(e ORDER BY e) AS e, list(e - size ORDER BY e - size) AS s, list_sort(coalesce(list(DISTINCT greatest(1, e + CASE WHEN ends THEN off END)) FILTER (ends), [])) AS p, coalesce(list(i ORDER BY i) FILTER (cut), []) AS b FROM l GROUP BY l_orderkey),
r AS (SELECT *, unnest(b) AS i FROM h),
a AS (SELECT *, s[i + 2] AS pos, len(p) - 1 AS last FROM r),
c AS (SELECT *, least(last, len(list_filter(p, lambda x: x <= pos))) AS q FROM a),
d AS (SELECT *, p[q + 1] AS here, p[q + 2] AS there, p[q + 1] - coalesce(p[q], 0) AS n, p[q + 2] - p[q + 1] AS m FROM c),
g AS (SELECT *, coalesce(here > pos AND here <= pos + least(400, floor(n * 0.6)::INT), FALSE) AS near FROM d),
t AS (SELECT *, CASE WHEN near THEN here WHEN q < last AND there > pos AND there <= pos + least(400, floor(m * 0.6)::INT) AND (n < 120 OR NOT near) THEN there END AS target FROM g),
u AS (SELECT *, greatest(0, least(len(s) - 2, len(list_filter(e, lambda x: x < target)) - 1)) AS new FROM t),
v AS (SELECT l_orderkey, CASE WHEN len(p) = 0 OR target IS NULL OR i + 1 >= len(s) OR least(last, len(list_filter(p, lambda x: x < e[new + 1]))) < least(last, len(list_filter(p, lambda x: x < e[i + 1]))) THEN i ELSE new END AS k FROM u)
SELECT l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT k) FILTER (k IS NOT NULL)), ','), '') AS breaks FROM h LEFT JOIN v USING (l_orderkey) GROUP BY l_orderkey"""


def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.sentences(_t(spark, sf_dir, "documents"), "sentence")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.col("start") + F.length("sentence")).alias("last_end"))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.paragraphs(_t(spark, sf_dir, "pages").withColumnsRenamed({"page_id": "doc_id", "html": "text"}), "sentence")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.col("p_end") - F.col("p_start")).alias("n_chars"))


def embed_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.embed_clean(F.col("text")).alias("cleaned"))


def head_tail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.head_tail(F.col("text"))).alias("digest"))


_HEAD_TAIL_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN len(t) <= 200 THEN trim(x) ELSE array_to_string(list_concat(t[least(1000, len(t) - 100) + 1:least(1000, len(t) - 100) + 100],
  CASE WHEN len(t) > 1100 THEN t[len(t) - 1100 + 1:len(t) - 1000] ELSE t[len(t) - 99:len(t)] END), ' ') END) AS digest FROM t"""


# --- keywords ---------------------------------------------------------------------------------------------------------


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    found = keywords.tfidf(docs, ["doc_id"], F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0), top=5)
    return found.select("doc_id", "term", _r(F.col("weight")).alias("weight"), "rank")


_TFIDF_SQL = """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents WHERE text IS NOT NULL)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
n AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term)::INT AS rank FROM n)
SELECT doc_id, term, round(weight, 6) AS weight, rank FROM r WHERE rank <= 5"""


def keyword_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir)
    rows = rows.select("doc_id", "idx", F.split("sentence", " ").alias("keywords"))
    found = keywords.interleave(rows, "doc_id", "idx", "keywords")
    return found.select("doc_id", F.size("keywords").alias("n"), F.md5(F.array_join("keywords", "|")).alias("digest"))


_INTERLEAVE_SQL = f"""WITH {_LINES}, f AS (SELECT doc_id, idx, unnest(string_split(sentence, ' ')) AS w, generate_subscripts(string_split(sentence, ' '), 1) AS k FROM lines),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY k, idx, w) AS seen FROM f),
r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k, idx) AS n FROM o WHERE seen = 1)
SELECT doc_id, count(*)::INT AS n, md5(string_agg(w, '|' ORDER BY n)) AS digest FROM r WHERE n <= 50 GROUP BY doc_id"""


def rake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", keywords.text_keywords(F.col("text"), "rake", top=10).alias("keywords"))


def yake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", keywords.text_keywords(F.col("text"), "yake", top=10).alias("keywords"))


# --- vectors ----------------------------------------------------------------------------------------------------------


def consecutive_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.consecutive_distance(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return rows.select("vec_id", "label", _r(F.col("distance_to_next")).alias("distance_to_next"))


def _distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.consecutive_distance(_t(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return rows.withColumn("distance_to_next", _r(F.col("distance_to_next"), 9))


def breakpoints_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.breakpoints(_distances(spark, sf_dir), "label").where("is_break")
    return rows.select("vec_id", "label", "distance_to_next", _r(F.col("threshold")).alias("threshold"))


def vector_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.segments(chunking.breakpoints(_distances(spark, sf_dir), "label"), "label", "vec_id")
    return rows.groupBy("label", "segment").agg(F.min("vec_id").alias("from_id"), F.max("vec_id").alias("to_id"), F.count("*").alias("n"))


_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_DIST = f"""v AS (SELECT vec_id, label, {_V} AS v, lead({_V}) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM embeddings),
g AS (SELECT vec_id, label, 1 - list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))) AS g FROM v)"""
_BREAKS = f"""{_DIST}, b AS (SELECT vec_id, label, round(g, 9) AS g, quantile_cont(round(g, 9), 0.95) OVER (PARTITION BY label) AS t FROM g)"""


def mean_pool_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = mean_pool(_t(spark, sf_dir, "embeddings"), "label", "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", _r(F.col("x")).alias("x"))


_POOL_SQL = f"""WITH u AS (SELECT label, unnest(v) / sqrt(list_dot_product(v, v)) AS x, generate_subscripts(v, 1) - 1 AS pos FROM (SELECT label, {_V} AS v FROM embeddings)),
m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY label, pos)
SELECT label, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m"""


def _relevance(spark: SparkSession, sf_dir: str, settings: selection.Settings = selection.Settings()) -> selection.Compared:
    """All vectors against every hundredth one, labels as clusters."""
    vectors = _t(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return selection.Compared(vectors.withColumnsRenamed({"vec_id": "chunk_id", "label": "cluster_id"}), asked, settings, digits=9)


def relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).best(30).select("query_id", "chunk_id", "cluster_id", "similarity")


def cluster_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _relevance(spark, sf_dir).quotas()
    return found.select("query_id", "cluster_id", "size", _r(F.col("score")).alias("score"), _r(F.col("weight")).alias("weight"), "quota")


def zscore_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).zscores(digits=6)


def sim_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevance(spark, sf_dir).floors().select("query_id", _r(F.col("floor")).alias("floor"))


_REL = f"""q AS (SELECT vec_id AS query_id, {_V} AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, label AS cluster_id, round(list_dot_product({_V}, q) / (sqrt(list_dot_product({_V}, {_V})) * sqrt(list_dot_product(q, q))), 9) AS s FROM embeddings, q)"""
_QUOTAS = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY s DESC, chunk_id) AS r FROM s),
c AS (SELECT query_id, cluster_id, count(*) AS size, avg(s) FILTER (r <= 3) AS score FROM r GROUP BY query_id, cluster_id),
w AS (SELECT *, exp((score - max(score) OVER q) / 0.5) AS up FROM c WINDOW q AS (PARTITION BY query_id)),
h AS (SELECT *, up / sum(up) OVER q AS weight, least(25, sum(size) OVER q) AS n FROM w WINDOW q AS (PARTITION BY query_id)),
a AS (SELECT *, n * (0.5 * weight + 0.5 / count(*) OVER q) AS share FROM h WINDOW q AS (PARTITION BY query_id)),
b AS (SELECT *, least(floor(share), size) AS base FROM a),
l AS (SELECT *, n - sum(base) OVER (PARTITION BY query_id) AS rest, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN base < size THEN 0 ELSE 1 END, share - floor(share) DESC, score DESC, cluster_id) AS place FROM b),
p AS (SELECT *, base + CASE WHEN base < size AND place <= rest THEN 1 ELSE 0 END AS plus FROM l),
f AS (SELECT *, n - sum(plus) OVER (PARTITION BY query_id) AS more, coalesce(sum(size - plus) OVER (PARTITION BY query_id ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free FROM p),
quotas AS MATERIALIZED (SELECT query_id, cluster_id, size, score, weight, (plus + greatest(0, least(size - plus, more - free)))::BIGINT AS quota FROM f)"""
_QUOTA_SQL = f"WITH {_REL}, {_QUOTAS} SELECT query_id, cluster_id, size, round(score, 6) AS score, round(weight, 6) AS weight, quota FROM quotas"


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _relevance(spark, sf_dir).select()
    return found.select("query_id", "chunk_id", "pick", "cluster_id", _r(F.col("similarity")).alias("similarity"), _r(F.col("mmr_score")).alias("mmr_score"), "stop_reason")


def blend_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen chunks in order of a blend of similarity and marginal relevance."""
    found, _ = _relevance(spark, sf_dir, selection.Settings(order="blend")).select()
    return found.select("query_id", "chunk_id", "position", _r(F.col("final_score")).alias("final_score"))


def cluster_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, quotas, picks and the reason to stop, by cluster."""
    found, quotas = _relevance(spark, sf_dir).select()
    return selection.diagnostics(found, quotas).select("query_id", "cluster_id", "size", "quota", "picked", "stop_reason")


def _mmr_sql() -> str:
    """The greedy steps as a chain: each holds the best of what is allowed against the rules to stop, then picks it."""
    k = selection.Settings()
    gain = f"{k.lam} * s - (1 - {k.lam}) * near"
    steps = [
        f"e AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, {_V} AS v FROM embeddings))",
        "m0 AS MATERIALIZED (SELECT s.query_id, chunk_id, s.cluster_id, s, v, quota, 0.0::DOUBLE AS near, NULL::INT AS pick, NULL::DOUBLE AS mmr FROM s JOIN e ON vec_id = chunk_id JOIN quotas USING (query_id, cluster_id))",
        "t0 AS (SELECT DISTINCT query_id, []::DOUBLE[] AS gains, NULL::VARCHAR AS stop FROM s)",
    ]
    for i in range(1, k.max_n + 1):
        late = f"len(gains) >= {k.min_n} AND"
        steps += [
            f"a{i} AS MATERIALIZED (SELECT *, {gain} AS g FROM (SELECT *, count(pick) OVER (PARTITION BY query_id, cluster_id) AS taken FROM m{i - 1}) WHERE pick IS NULL AND taken < quota)",
            f"b{i} AS MATERIALIZED (SELECT query_id, chunk_id AS b, v AS bv, s AS bs, g, fl FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, cluster_id, chunk_id) AS r FROM a{i}) JOIN (SELECT query_id, quantile_cont(s, {k.floor_quantile}) AS fl FROM a{i} GROUP BY query_id) USING (query_id) WHERE r = 1)",
            f"""d{i} AS (SELECT t.query_id, gains, g, coalesce(stop, CASE WHEN b IS NULL THEN 'quota_exhausted' WHEN {late} list_avg(gains[-{k.gain_window}:]) <= {k.gain_drop} * abs(gains[1]) THEN 'gain_drop'
              WHEN {late} g <= {k.min_gain} THEN 'min_gain' WHEN {late} g <= 0 THEN 'negative' WHEN {late} bs <= fl THEN 'sim_floor' END) AS stop FROM t{i - 1} t LEFT JOIN b{i} USING (query_id))""",
            f"t{i} AS MATERIALIZED (SELECT query_id, CASE WHEN stop IS NULL THEN list_append(gains, g) ELSE gains END AS gains, stop FROM d{i})",
            f"m{i} AS MATERIALIZED (SELECT m.query_id, chunk_id, cluster_id, s, v, quota, CASE WHEN stop IS NULL THEN greatest(near, list_dot_product(v, bv)) ELSE near END AS near, CASE WHEN stop IS NULL AND chunk_id = b THEN {i} ELSE pick END AS pick, CASE WHEN stop IS NULL AND chunk_id = b THEN g ELSE mmr END AS mmr FROM m{i - 1} m JOIN t{i} USING (query_id) LEFT JOIN b{i} USING (query_id))",
        ]
    n = k.max_n
    return f"WITH {_REL}, {_QUOTAS}, " + ", ".join(steps) + f", picked AS (SELECT query_id, chunk_id, pick::INT AS pick, cluster_id, s, mmr, coalesce(stop, 'max_n') AS stop_reason FROM m{n} JOIN t{n} USING (query_id) WHERE pick IS NOT NULL) "


_MMR = _mmr_sql()


def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.silhouette_scores(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.groupBy("label").agg(F.count("*").alias("n"), _r(F.avg("silhouette")).alias("silhouette"))


_SILHOUETTE_SQL = f"""WITH e AS (SELECT vec_id, label, {_V} AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT vec_id, label, min(d) FILTER (other = label) AS a, min(d) FILTER (other <> label) AS b FROM d GROUP BY vec_id, label)
SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY label"""


def kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = clustering.sweep(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return scores.select("k", "is_best")


# --- graph ------------------------------------------------------------------------------------------------------------



def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every even vector as the summary of an event, the next one as its influence."""
    held = _t(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("event"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("vector"))
    return held.where("side = 0"), held.where("side = 1")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.candidate_pairs(*_sides(spark, sf_dir), digits=9)


def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.best_pairs(*_sides(spark, sf_dir), digits=9)


_PAIRS_SQL = f"""WITH h AS (SELECT vec_id // 2 AS event, vec_id % 2 AS side, {_V} AS v FROM embeddings),
p AS (SELECT a.event AS i, b.event AS j, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS s FROM h a JOIN h b ON a.side = 0 AND b.side = 1 AND a.event <> b.event)
SELECT i, j, s AS similarity FROM p"""

#: Relation labels of the nation graph, by order priority.
LABELS = {"1-URGENT": "contradiction", "2-HIGH": "causal", "3-MEDIUM": "amplification", "4-NOT SPECIFIED": "mitigation", "5-LOW": "coreference"}


def _nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, and the relations from customers' to suppliers' nations, one for each pair and label."""
    label = F.lit(None).cast("string")
    for k, v in LABELS.items():
        label = F.when(F.col("o_orderpriority") == k, v).otherwise(label)
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", label.alias("label"))
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    flat = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    flat = flat.join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    relations = flat.groupBy(F.col("c_nationkey").alias("source_id"), F.col("s_nationkey").alias("target_id"), "label").agg(F.sum("n").alias("n"))
    return _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")), relations


def _nation_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, relations = _nation_graph(spark, sf_dir)
    return nodes, graph.edges(relations, nodes)


def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_edges(spark, sf_dir)[1].select("src", "dst", "label", "w_in", "w_out")


def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.out_degree(_nation_edges(spark, sf_dir)[1]).select("src", _r(F.col("degree")).alias("degree"))


def outgoing_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, made = _nation_edges(spark, sf_dir)
    return graph.outgoing_bonus(made, nodes).select("id", _r(F.col("bonus")).alias("bonus"))


ROUNDS = 10


def pagerank_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, made = _nation_edges(spark, sf_dir)
    return graph.pagerank(made, nodes, iterations=ROUNDS, tolerance=None).select("id", _r(F.col("pagerank")).alias("pagerank"))


def rating_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, made = _nation_edges(spark, sf_dir)
    return graph.ratings(made, nodes).select("id", *[_r(F.col(c)).alias(c) for c in ("pagerank", "outgoing_bonus", "score")])


def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, made = _nation_edges(spark, sf_dir)
    return graph.pagerank(made, nodes).select("id", _r(F.col("pagerank")).alias("pagerank"))


def _case(column: str, table: dict[str, object]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + " END"


_EDGES = f"""rel AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst, {_case("o_orderpriority", LABELS)} AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
edges AS (SELECT src, dst, label, {_case("label", graph.WEIGHT_IN)}::DOUBLE AS w_in, {_case("label", graph.WEIGHT_OUT)}::DOUBLE AS w_out FROM rel)"""
_BONUS = "bonus AS (SELECT n_nationkey AS id, coalesce(s, 0) / max(coalesce(s, 0)) OVER () AS bonus FROM nation LEFT JOIN (SELECT src, sum(w_out) AS s FROM edges GROUP BY src) ON src = n_nationkey)"


def _ranks(rounds: int, tolerance: float | None = None) -> str:
    """Rounds of the rank as a chain; with a tolerance, nothing changes after the first round below it."""
    out = ["flat AS MATERIALIZED (SELECT src, dst, sum(w_in) / sum(sum(w_in)) OVER (PARTITION BY src) AS p FROM edges GROUP BY src, dst)", "nn AS (SELECT count(*) AS n FROM nation)", "r0 AS (SELECT n_nationkey AS id, 1.0::DOUBLE / n AS r, FALSE AS done FROM nation, nn)"]
    for i in range(1, rounds + 1):
        lost = f"(SELECT coalesce(sum(r), 0) FROM r{i - 1} WHERE id NOT IN (SELECT src FROM flat))"
        new = f"CASE WHEN done THEN r ELSE 0.85 * (coalesce(f, 0) + {lost} / n) + 0.15 / n END"
        settled = f"done OR sum(abs(x - r)) OVER () < {tolerance}" if tolerance is not None else "FALSE"
        out.append(f"r{i} AS MATERIALIZED (SELECT id, x AS r, {settled} AS done FROM (SELECT a.id, a.r, a.done, {new} AS x FROM r{i - 1} a CROSS JOIN nn LEFT JOIN (SELECT dst, sum(p * r) AS f FROM flat JOIN r{i - 1} ON id = src GROUP BY dst) ON dst = a.id))")
    out.append(f"ranks AS (SELECT id, r / sum(r) OVER () AS pagerank FROM r{rounds})")
    return ", ".join(out)


#: Rounds of the SQL twin of the settled rank; the nation graph settles long before.
SETTLED = 40


def context_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of the nations, best outgoing bonus first."""
    nodes, relations = _nation_graph(spark, sf_dir)
    bonus = graph.outgoing_bonus(graph.edges(relations, nodes), nodes).select("id", _r(F.col("bonus")).alias("score"))
    none = F.lit(None)
    events = nodes.select("id", F.col("id").alias("pos"), "title", F.lower("title").alias("summary"), none.cast("string").alias("description"), F.array("title").alias("actors"), none.cast("array<string>").alias("locations"), F.array(F.struct(F.col("id").cast("string").alias("value"), F.lit("key").alias("explanation"))).alias("associated_numbers"), none.cast("array<string>").alias("influence"))
    top = context.top_events(events, bonus)
    placed = relations.withColumn("pos", F.struct("source_id", "target_id", "label"))
    return context.cards(top, context.relation_lists(placed, top)).select("rank", "id", "card")


_CARDS_SQL = f"""WITH {_EDGES}, {_BONUS}, top AS (SELECT id, round(bonus, 6) AS score, n_name AS title, row_number() OVER (ORDER BY round(bonus, 6) DESC, id)::INT AS rank FROM bonus JOIN nation ON n_nationkey = id ORDER BY rank LIMIT 30),
o AS (SELECT src, string_agg(format('({{}} -> {{}}: {{}})', src, dst, label), ', ' ORDER BY src, dst, label) AS t FROM rel GROUP BY src),
i AS (SELECT dst, string_agg(format('({{}} -> {{}}: {{}})', src, dst, label), ', ' ORDER BY src, dst, label) AS t FROM rel GROUP BY dst)
SELECT rank, id, format('## {{}}. [{{}}] {{}}', rank, id, title) || chr(10) || '**Score:** ' || printf('%.4f', score) || chr(10) || '**Description:** ' || lower(title) || chr(10) || '**Actors:** ' || title || chr(10)
  || '**Locations:** -' || chr(10) || '**Associated Numbers:** ' || id || ' (key)' || chr(10) || '**Influence chain:** -' || chr(10) || '**Relations (outgoing):** ' || coalesce(o.t, '-') || chr(10)
  || '**Relations (incoming):** ' || coalesce(i.t, '-') AS card FROM top LEFT JOIN o ON o.src = id LEFT JOIN i ON i.dst = id"""


def relation_label_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("```not json")).otherwise(F.concat(F.lit('{"relation": " '), F.upper("event_type"), F.lit(' ", "confidence": 0.5}')))
    return _t(spark, sf_dir, "events").select("event_id", parsing.relation_label(F.lit(None).cast("string"), raw).alias("label"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.newest(_t(spark, sf_dir, "events"), ["event_type"], "ts", "event_id").select("event_type", "event_id", "ts")


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON columns of a run: good, broken and missing ones."""
    raw = F.when(F.col("event_id") % 3 == 0, F.format_string('[{"id": %d, "score": 0.5}, {"id": 2}]', "event_id")).when(F.col("event_id") % 3 == 1, "[{")
    rows = _t(spark, sf_dir, "events").select("event_id", raw.alias("ratings"))
    return rows.select("event_id", catalog.listed("ratings", catalog.RATING)).select("event_id", F.size("ratings").alias("n"), F.coalesce(F.get("ratings", F.lit(0))["id"], F.lit(-1)).cast("long").alias("first_id"))


def relation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of relations that have none, by the positions of the events."""
    key = F.col("o_orderkey")
    side = lambda n: F.when(key % n == 0, key)
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", side(2).alias("source_id"), side(3).alias("target_id"), (key % 40).alias("_source_idx"), (key % 30).alias("_target_idx"))
    events = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") + 100).alias("id"))
    return graph.with_ids(rows, events).select("o_orderkey", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("source_id", "target_id")])


def answer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thoughts and JSON of extraction answers in all their shapes."""
    key, source = F.col("doc_id"), F.coalesce("source", F.lit(""))
    said = F.when(key % 6 == 0, F.lit(" None ")).when(key % 6 == 1, F.concat(F.lit("**Thoughts** on "), source, F.lit(" **JSON** [1, "), key, F.lit("] ")))
    said = said.when(key % 6 == 2, F.concat(F.lit("["), key, F.lit("]"))).when(key % 6 == 3, F.concat(F.lit('{"events": ['), key, F.lit("]}")))
    said = said.when(key % 6 == 4, F.concat(F.lit("see [x "), source, F.lit("] and ["), key, F.lit(", [2]] end")))
    return _t(spark, sf_dir, "documents").select("doc_id", parsing.answer_parts(said).alias("a")).select("doc_id", "a.thoughts", "a.json")


def events_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a list, of an object that holds one, of something else."""
    key = F.col("event_id")
    one = F.concat(F.lit('{"title": "'), F.col("event_type"), F.lit('", "influence": ["x", "y"], "confidence": 0.5}'))
    said = F.when(key % 4 == 0, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))).when(key % 4 == 1, F.concat(F.lit('{"events": ['), one, F.lit("]}"))).when(key % 4 == 2, "nothing")
    found = _t(spark, sf_dir, "events").select("event_id", parsing.events_of(said).alias("e"))
    return found.select("event_id", F.coalesce(F.when(F.size("e") >= 0, F.size("e")), F.lit(-1)).alias("n"), F.get("e", F.lit(0))["title"].alias("title"))


def verdict_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' answers: plain, within words, as a message, as a choice, unreadable."""
    key = F.col("doc_id")
    who = F.when(F.col("toxic") == 1, "Answer 1").otherwise("Answer 2")
    plain = F.concat(F.lit('{"Diversity": {"Winner": "'), who, F.lit(' ", "Explanation": "e"}}'))
    quoted = F.regexp_replace(plain, '"', '\\\\"')
    said = F.when(key % 5 == 0, plain).when(key % 5 == 1, F.concat(F.lit("So: "), plain, F.lit(" that is all"))).when(key % 5 == 2, F.concat(F.lit('{"content": "'), quoted, F.lit('"}')))
    said = said.when(key % 5 == 3, F.concat(F.lit('{"choices": [{"message": {"content": "'), quoted, F.lit('"}}]}'))).otherwise(F.concat(F.lit("none of "), who))
    read = _t(spark, sf_dir, "labels").select("doc_id", parsing.verdict_of(said).alias("v"))
    return read.select("doc_id", evaluation.winner(F.col("v.evaluation"), "Diversity").alias("winner"), "v.parse_error", "v.raw_text")


def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = text.fill("Q: $query (${n}) $$ $other", query=F.col("text"), n=F.col("doc_id"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(filled).alias("digest"))


def entity_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities before keywords, the least important first, repeats left out."""
    words = keywords.keyword_text(F.array("source", F.lit("Paris")), F.array(F.lit("k"), F.lit("Paris"), F.lit("k2")))
    return _t(spark, sf_dir, "documents").select("doc_id", words.alias("keywords"))


def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as one JSON value, read back as rows."""
    listed = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))  # a fixed dimension of 25 rows
    raw = _t(spark, sf_dir, "nation").agg(F.to_json(F.struct(listed.alias("data"))).alias("value"))
    return readers.shaped(spark, raw)


def article_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns as articles, roles as titles; every third text is blank."""
    body = F.when(F.col("turn") % 3 == 2, F.lit(" \t\n")).otherwise(F.concat(F.lit("\n "), "text", F.lit("\t")))
    turns = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.col("role").alias("title"), body.alias("text")).alias("a"))
    held = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("a")).alias("a"))
    return held.select("conv_id", F.md5(readers.articles_corpus(F.col("a"))).alias("digest"))


# --- evaluation -------------------------------------------------------------------------------------------------------


def align_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a query, answered by both sides with its whole text; the second side lacks every fourth."""
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    side = lambda rows, mark: rows.select(F.concat(F.lit("\t conversation "), "conv_id", F.lit(" turn "), "turn", F.lit(" \n")).alias("query"), F.concat(F.lit(mark), "text").alias("answer"))
    return evaluation.align(side(turns, "a: "), side(turns.where("(conv_id + turn) % 4 <> 0"), "b: "))


def winner_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.struct(F.when(F.col(c) == 1, " Answer 1").when(F.col(c) == 0, "Answer 2").otherwise("none").alias("Winner"), F.lit("").alias("Explanation"))
    verdict = F.map_from_arrays(F.array(*[F.lit(k) for k in ("Comprehensiveness", "Diversity", "Overall Winner")]), F.array(one("quality"), one("toxic"), one("quality")))
    return evaluation.tally(_t(spark, sf_dir, "labels").select(verdict.alias("evaluation")))


_TALLY_SQL = """WITH w AS (SELECT 'Comprehensiveness' AS category, quality AS x FROM labels UNION ALL SELECT 'Diversity', toxic FROM labels UNION ALL SELECT 'Overall', quality FROM labels UNION ALL SELECT 'Empowerment', NULL FROM labels),
c AS (SELECT category, count(*) FILTER (x = 1) AS first, count(*) FILTER (x = 0) AS second FROM w GROUP BY category)
SELECT category, first, second, first + second AS total, CASE WHEN first + second > 0 THEN round_even(100.0 * first / (first + second), 2)::DOUBLE ELSE 0.0 END AS first_percent, CASE WHEN first + second > 0 THEN round_even(100.0 * second / (first + second), 2)::DOUBLE ELSE 0.0 END AS second_percent FROM c"""


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 3000 - 0.1).alias("p")), "doc_id")
    return evaluation.overall_brier(rows, "p", "quality").select("n", _r(F.col("overall_brier")).alias("overall_brier"))


def star_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " *0,").when(F.col("doc_id") % 3 == 1, " *-1.").otherwise(" 0."), F.col("doc_id"), F.lit("* \n"))
    return _t(spark, sf_dir, "documents").select("doc_id", _r(text.star_number(said)).alias("number"))


def extract_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.translate("text", "\n*", "  ")
    said = F.concat(F.lit("User 1\n- **Question 1**: "), flat, F.lit(" \n* Question 22 :  why \nQuestion 3: no\n"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.questions(said)).alias("n", "question"))


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = readers.joined(_t(spark, sf_dir, "conversations"), "text", ["turn"], ["conv_id"])
    return made.select("conv_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"))
    return evaluation.unanswered(asked, _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("query")))


def vector_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", _r(dot(F.col("embedding"), F.col("embedding"))).alias("squared"))


FLAGSHIP = "segments"
QUERIES = {
    f.__name__: f
    for f in (
        segments, doc_dedup, doc_numbers, doc_page, chunk_insert_new, snapped_breaks, chunk_text_unique, sentence_lines, sentence_windows, chunk_merge, sentence_spans, paragraph_spans, embed_clean, head_tail_summary,
        tfidf_topk, keyword_interleave, rake_keywords, yake_keywords, consecutive_distance, breakpoints_p95, vector_segments, mean_pool_label, relevance_topk,
        cluster_quota, zscore_relevance, sim_floor, mmr_select, blend_order, cluster_picks, silhouette_exact, kmeans_sweep, candidate_pairs, top_pairs, edge_weights,
        out_degree, outgoing_bonus, pagerank_10, pagerank_converged, rating_score, context_cards, relation_label_parse, latest_run, run_results, relation_ids, answer_split, events_parse, verdict_shapes, prompt_fill, entity_keywords, json_shapes, article_corpus, align_answers, winner_tally, brier,
        star_number, extract_questions, corpus_build, unanswered, vector_dot,
    )
}
ORACLE_SQL: dict[str, str] = {
    "segments": _SEGMENTS_SQL,
    "doc_dedup": "SELECT sha256(text) AS sha256, min(length(text))::INT AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY sha256",
    "doc_numbers": "SELECT sha256, 100 + row_number() OVER (ORDER BY sha256) AS doc_id FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL)",
    "doc_page": "SELECT doc_id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 50 OFFSET 20",
    "chunk_insert_new": f"WITH {_LINES} SELECT doc_id, idx AS chunk_idx, md5(sentence) AS digest FROM lines WHERE doc_id % 2 <> 0 AND sentence NOT IN (SELECT sentence FROM lines WHERE doc_id % 2 = 0) QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY doc_id, idx) = 1",
    "chunk_merge": _MERGE_SQL,
    "snapped_breaks": _SNAPPED_SQL,
    "chunk_text_unique": f"WITH {_LINES} SELECT doc_id, idx AS chunk_idx, sha256(sentence) AS sha256 FROM lines QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY doc_id, idx) = 1",
    "sentence_lines": f"WITH {_LINES} SELECT doc_id, idx, sentence FROM lines",
    "sentence_windows": _WINDOWS_SQL,
    "head_tail_summary": _HEAD_TAIL_SQL,
    "tfidf_topk": _TFIDF_SQL,
    "keyword_interleave": _INTERLEAVE_SQL,
    "consecutive_distance": f"WITH {_DIST} SELECT vec_id, label, round(g, 6) AS distance_to_next FROM g",
    "breakpoints_p95": f"WITH {_BREAKS} SELECT vec_id, label, g AS distance_to_next, round(t, 6) AS threshold FROM b WHERE g > t",
    "vector_segments": f"WITH {_BREAKS}, s AS (SELECT *, coalesce(sum(coalesce(g > t, FALSE)::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM b) SELECT label, segment, min(vec_id) AS from_id, max(vec_id) AS to_id, count(*) AS n FROM s GROUP BY label, segment",
    "mean_pool_label": _POOL_SQL,
    "relevance_topk": f"WITH {_REL} SELECT query_id, chunk_id, cluster_id, s AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 30",
    "cluster_quota": _QUOTA_SQL,
    "zscore_relevance": f"WITH {_REL} SELECT query_id, chunk_id, round((s - avg(s) OVER q) / (stddev_pop(s) OVER q + 1e-6), 6) AS z FROM s WINDOW q AS (PARTITION BY query_id)",
    "sim_floor": f"WITH {_REL} SELECT query_id, round(quantile_cont(s, 0.7), 6) AS floor FROM s GROUP BY query_id",
    "mmr_select": _MMR + "SELECT query_id, chunk_id, pick, cluster_id, round(s, 6) AS similarity, round(mmr, 6) AS mmr_score, stop_reason FROM picked",
    "blend_order": _MMR + "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY 0.5 * s + (1 - 0.5) * mmr DESC, pick)::INT AS position, round(0.5 * s + (1 - 0.5) * mmr, 6) AS final_score FROM picked",
    "cluster_picks": _MMR + "SELECT query_id, cluster_id, size, quota, coalesce(n, 0)::BIGINT AS picked, stop_reason FROM quotas LEFT JOIN (SELECT query_id, cluster_id, count(*) AS n FROM picked GROUP BY ALL) USING (query_id, cluster_id) LEFT JOIN (SELECT DISTINCT query_id, stop_reason FROM picked) USING (query_id)",
    "silhouette_exact": _SILHOUETTE_SQL,
    "candidate_pairs": _PAIRS_SQL,
    "top_pairs": _PAIRS_SQL + " ORDER BY s DESC, i, j LIMIT 20",
    "edge_weights": f"WITH {_EDGES} SELECT src, dst, label, w_in, w_out FROM edges",
    "out_degree": f"WITH {_EDGES} SELECT src, round(sum(w_in), 6) AS degree FROM edges GROUP BY src",
    "outgoing_bonus": f"WITH {_EDGES}, {_BONUS} SELECT id, round(bonus, 6) AS bonus FROM bonus",
    "pagerank_10": f"WITH {_EDGES}, {_ranks(ROUNDS)} SELECT id, round(pagerank, 6) AS pagerank FROM ranks",
    "pagerank_converged": f"WITH {_EDGES}, {_ranks(SETTLED, graph.TOLERANCE)} SELECT id, round(pagerank, 6) AS pagerank FROM ranks",
    "rating_score": f"WITH {_EDGES}, {_BONUS}, {_ranks(SETTLED, graph.TOLERANCE)} SELECT id, round(pagerank, 6) AS pagerank, round(bonus, 6) AS outgoing_bonus, round(0.7 * pagerank + 0.3 * bonus, 6) AS score FROM ranks JOIN bonus USING (id)",
    "context_cards": _CARDS_SQL,
    "relation_label_parse": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE lower(event_type) END AS label, (props ->> 'k')::BIGINT AS k FROM events",
    "latest_run": "SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "run_results": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END::INT AS n, CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END AS first_id FROM events",
    "relation_ids": "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END, a.n_nationkey + 100, -1)::BIGINT AS source_id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END, b.n_nationkey + 100, -1)::BIGINT AS target_id FROM orders LEFT JOIN nation a ON a.n_nationkey = o_orderkey % 40 LEFT JOIN nation b ON b.n_nationkey = o_orderkey % 30",
    "answer_split": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'None' WHEN 1 THEN trim('on ' || coalesce(source, '')) END AS thoughts, CASE doc_id % 6 WHEN 0 THEN '[]' WHEN 1 THEN '[1, ' || doc_id || ']' WHEN 2 THEN '[' || doc_id || ']' WHEN 3 THEN '[' || doc_id || ']' WHEN 4 THEN '[' || doc_id || ', [2]]' END AS json FROM documents",
    "events_parse": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE -1 END::INT AS n, CASE WHEN event_id % 4 < 2 THEN event_type END AS title FROM events",
    "verdict_shapes": "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' WHEN toxic = 1 THEN 'Answer 1' ELSE 'Answer 2' END AS winner, doc_id % 5 = 4 AS parse_error, CASE WHEN doc_id % 5 = 4 THEN 'none of Answer ' || CASE WHEN toxic = 1 THEN 1 ELSE 2 END END AS raw_text FROM labels",
    "prompt_fill": "SELECT doc_id, md5('Q: ' || coalesce(text, '') || ' (' || doc_id || ') $ $other') AS digest FROM documents",
    "entity_keywords": "SELECT doc_id, concat_ws(', ', source, 'Paris', 'k2', 'k') AS keywords FROM documents",
    "json_shapes": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "article_corpus": f"SELECT conv_id, md5(string_agg(concat_ws(chr(10) || chr(10), nullif({_STRIP.format('role')}, ''), CASE WHEN turn % 3 <> 2 THEN nullif({_STRIP.format('text')}, '') END), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id",
    "align_answers": "WITH t AS (SELECT conv_id, turn, min(text) AS t FROM conversations GROUP BY ALL) SELECT 'conversation ' || conv_id || ' turn ' || turn AS query, 'a: ' || t AS answer_a, 'b: ' || t AS answer_b FROM t WHERE (conv_id + turn) % 4 <> 0",
    "winner_tally": _TALLY_SQL,
    "brier": "SELECT count(*) AS n, round(avg(pow(least(1, greatest(0, n_chars / 3000 - 0.1)) - quality, 2)), 6) AS overall_brier FROM labels JOIN documents USING (doc_id)",
    "star_number": "SELECT doc_id, round(CASE doc_id % 3 WHEN 0 THEN ('0.' || doc_id)::DOUBLE WHEN 1 THEN ('-1.' || doc_id)::DOUBLE END, 6) AS number FROM documents",
    "extract_questions": f"SELECT conv_id, turn, n, {_STRIP.format('q')} AS question FROM (SELECT conv_id, turn, 0 AS n, translate(text, chr(10) || '*', '  ') AS q FROM conversations UNION ALL SELECT conv_id, turn, 1, 'why' FROM conversations)",
    "corpus_build": "SELECT conv_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)",
    "unanswered": "SELECT doc_id AS query FROM documents ANTI JOIN labels USING (doc_id)",
    "vector_dot": f"SELECT vec_id, round(list_dot_product({_V}, {_V}), 6) AS squared FROM embeddings",
}
