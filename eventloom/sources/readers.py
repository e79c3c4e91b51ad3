"""Readers and writers of data sets, answers, questions, prompts and results."""

from __future__ import annotations

import json
import os
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.durable import durable
from eventloom.functions.text import strip

#: Fields of an object that hold its list of rows.
LIST_FIELDS = ("data", "items", "examples", "records")
ANSWER_SCHEMA = "query string, answer string"


def json_rows(spark: SparkSession, path: str, max_rows: int = 0) -> DataFrame:
    """The rows of one JSON value, whatever its shape; ``max_rows`` of 0 or less means all.

    A list of objects gives its objects, a list of scalars a column ``value``; an object with a known list field gives
    that list, an object of equally long lists their columns, any other object ``key`` and ``value``; a scalar one row.
    An empty list gives an empty frame.
    """
    raw = spark.read.text(path, wholetext=True)
    frame = shaped(spark, raw)
    return frame.limit(max_rows) if max_rows > 0 else frame


def shaped(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """The rows of the JSON value in the one row of ``value``."""
    value = strip("value")
    kinds = raw.select(F.left(value, F.lit(1)).alias("head"), F.json_object_keys("value").alias("keys"), F.json_array_length("value").alias("n")).first()
    if kinds is None:
        return spark.createDataFrame([], "value string")
    if kinds.head == "[":
        return _list(spark, raw.select(F.col("value").alias("j")), kinds.n)
    if kinds.head != "{":
        return raw.select(F.regexp_replace(value, '^"|"$', "").alias("value"))
    for name in LIST_FIELDS:
        if name in kinds.keys:
            inner = raw.select(F.get_json_object("value", f"$['{name}']").alias("j"))
            n = inner.select(F.json_array_length("j")).first()[0]
            if n is not None:
                return _list(spark, inner, n)
    sizes = raw.select(*[F.json_array_length(F.get_json_object("value", f"$['{k}']")).alias(f"c{i}") for i, k in enumerate(kinds.keys)]).first()
    if kinds.keys and None not in list(sizes) and len(set(sizes)) == 1:
        lists = [F.from_json(F.get_json_object("value", f"$['{k}']"), "array<string>").alias(k) for k in kinds.keys]
        return raw.select(F.inline(F.arrays_zip(*lists)))
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def _list(spark: SparkSession, held: DataFrame, n: int | None) -> DataFrame:
    if not n:
        return spark.createDataFrame([], "value string")
    rows = held.select(F.explode(F.from_json("j", "array<string>")).alias("value"))
    first = rows.where("value is not null").select("value").first()
    if first is None or not first[0].lstrip().startswith("{"):
        return rows
    return rows.select(F.from_json("value", _schema(spark, rows)).alias("r")).select("r.*")


def _schema(spark: SparkSession, rows: DataFrame) -> T.StructType:
    """The schema of all objects, inferred by Spark's own reader from the column."""
    texts = getattr(rows.select("value")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return T._parse_datatype_json_string(spark._jsparkSession.read().json(texts).schema().json())


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines do not count."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def column(frame: DataFrame, name: str) -> DataFrame:
    """The column without nulls; a name that is not there is an error."""
    if name not in frame.columns:
        raise ValueError(f"no column {name!r}; there are {', '.join(frame.columns)}")
    return frame.select(name).dropna()


def answers(spark: SparkSession, path: str) -> DataFrame:
    """query, answer of a JSON array of such objects; anything else is an error."""
    rows = spark.read.schema(ANSWER_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    bad = F.col("_corrupt").isNotNull() | F.col("query").isNull() | F.col("answer").isNull()
    return rows.where(F.when(bad, F.raise_error(F.lit("not an array of answers"))).cast("boolean").isNull() | ~bad).select("query", "answer")


def lines(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Trimmed lines that are not blank, in order of the file; ``comments`` also drops lines that begin with #."""
    rows = spark.read.text(path).select(strip("value").alias("query")).where("query <> ''")
    return rows.where(~F.startswith("query", F.lit("#"))) if comments else rows


def prompt(name: str) -> str:
    """A prompt of the package; a missing one is an error."""
    found = resources.files("eventloom.plans").joinpath("prompts", f"{name}.txt")
    if not found.is_file():
        raise FileNotFoundError(f"no prompt {name!r}")
    return found.read_text(encoding="utf-8")


#: Fixed value: what separates the articles of a corpus.
SEPARATOR = "\n\n---\n\n"


def articles_corpus(items):
    """One text of an array of (title, text): trimmed parts, blank ones left out; null gives an empty text."""
    one = lambda a: F.array_join(F.filter(F.array(strip(F.coalesce(a.title, F.lit(""))), strip(F.coalesce(a.text, F.lit("")))), lambda x: x != ""), "\n\n")
    return F.coalesce(F.array_join(F.filter(F.transform(items, one), lambda x: x != ""), SEPARATOR), F.lit(""))


def joined(rows: DataFrame, text: str, order: list[str], key: list[str], sep: str = " ") -> DataFrame:
    """One text for each key, parts in a stated order; null parts are left out. A key's text is one string, so a key is
    needed: the whole table is never one."""
    if not key:
        raise ValueError("a key is needed")
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    made = rows.groupBy(*key).agg(parts.alias("p"))
    return made.select(*key, F.array_join(F.col("p.__t"), sep).alias("text"))


def answers_path(path: str) -> str:
    """A folder, or a path that does not end in .json, means answers.json inside it."""
    return path if path.endswith(".json") and not os.path.isdir(path) else os.path.join(path, "answers.json")


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """The text as a file, written beside it and then renamed, so that a reader sees the old one or the new one."""
    files, target = _path(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = files.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    files.delete(target, False)
    if not files.rename(beside, target):
        raise OSError(f"could not rename {path}.tmp")


def resume_answers(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Answers in one JSON array: those of the file stay, of new ones (query, answer) each query's first is added in order of
    query. A file that cannot be read is begun anew. The array is one file by contract, for the questions of an evaluation."""
    files, target = _path(spark, path)
    known: list[tuple[str, str]] = []
    if files.exists(target):
        held = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
        try:
            known = [(r["query"], r["answer"]) for r in json.loads(held) if isinstance(r, dict) and "query" in r and "answer" in r]
        except (ValueError, TypeError):
            known = []
    done = {q for q, _ in known}
    added = new.groupBy("query").agg(F.min("answer").alias("answer")).orderBy("query").collect()
    known += [(r.query, r.answer) for r in added if r.query not in done]
    _replace_text(spark, path, json.dumps([{"query": q, "answer": a} for q, a in known], ensure_ascii=False, indent=2))
    return spark.createDataFrame(known, ANSWER_SCHEMA)


def write_queries(questions: list[str], spark: SparkSession, folder: str, name: str) -> str:
    """Questions, one a line, in <name>_queries.txt; no questions give an empty file. Returns its path."""
    path = f"{folder.rstrip('/')}/{name}_queries.txt"
    _replace_text(spark, path, "".join(q + "\n" for q in questions))
    return path


def append_answers(spark: SparkSession, new: DataFrame, path: str) -> DataFrame:
    """Answers of queries that path (a Parquet folder) has none for are added; all answers are returned."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema(ANSWER_SCHEMA).parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else spark.createDataFrame([], ANSWER_SCHEMA)
    once = new.groupBy("query").agg(F.min("answer").alias("answer"))
    durable(once.join(known.select("query"), "query", "left_anti").select("query", "answer")).write.mode("append").parquet(path)
    return spark.read.schema(ANSWER_SCHEMA).parquet(path)


def judgment_json(items: DataFrame, tally: DataFrame, dataset: str, a: str, b: str) -> DataFrame:
    """One JSON text: dataset, methods, judged items and the final tally."""
    by_query = lambda x, y: F.when(x.query < y.query, -1).when(x.query > y.query, 1).otherwise(0)
    listed = items.agg(F.array_sort(F.collect_list(F.struct("query", "evaluation")), by_query).alias("items"))
    side = lambda n: F.struct(F.col(n).alias("count"), F.col(f"{n}_percent").alias("percent"))
    final = tally.agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct(side("first").alias("method_a"), side("second").alias("method_b"), "total")))).alias("final_eval"))
    return listed.crossJoin(final).select(F.to_json(F.struct(F.lit(dataset).alias("dataset"), F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), "items", "final_eval")).alias("value"))


def judgment_name(dataset: str, a: str, b: str) -> str:
    return f"{dataset}__{a}_vs_{b}.json"


def brier_json(rows: DataFrame, overall: float | None) -> DataFrame:
    """One JSON text: results and overall_brier."""
    kept = rows.agg(F.sort_array(F.collect_list(F.struct("question", "ground_truth", "model_answer", "model_score", "brier"))).alias("results"))
    return kept.select(F.to_json(F.struct("results", F.lit(overall).cast("double").alias("overall_brier")), {"ignoreNullFields": "false"}).alias("value"))


def call_log(calls: DataFrame, path: str) -> None:
    """Prompts and answers appended to a table."""
    calls.select(F.current_timestamp().alias("at"), "prompt", "answer").write.mode("append").parquet(path)


def call_count(spark: SparkSession, path: str) -> int:
    """Calls in the log; none before the first."""
    files, target = _path(spark, path)
    return spark.read.parquet(path).count() if files.exists(target) else 0


def plot_data(kind: str, frame: DataFrame) -> DataFrame:
    """The data of a plot: silhouette (k, score, is_best), pairs (i, j, similarity; must be square), distances (idx,
    distance_to_next, is_break) or boundaries (idx)."""
    wanted = {"silhouette": ["k", "score", "is_best"], "pairs": ["i", "j", "similarity"], "distances": ["idx", "distance_to_next", "is_break"], "boundaries": ["idx"]}[kind]
    if kind == "pairs":
        rows, columns = frame.agg(F.count_distinct("i"), F.count_distinct("j")).first()
        if rows != columns:
            raise ValueError("the matrix is not square")
    return (frame.where("is_break") if kind == "boundaries" and "is_break" in frame.columns else frame).select(*wanted).orderBy(*wanted[:2])
