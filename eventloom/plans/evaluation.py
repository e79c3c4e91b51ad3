"""Making questions from a corpus and judging two methods' answers, each as a chain of DataFrame steps around model calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import models, parsing
from eventloom.functions.durable import durable
from eventloom.functions.text import fill, head_tail, questions
from eventloom.operators import evaluation
from eventloom.sources import readers

#: Parameters of the calls, and how many users, tasks and questions are asked for.
QUESTION_CALL = {"max_new_tokens": 4056, "top_p": 0.95, "temperature": 0.1}
JUDGE_CALL = {"max_new_tokens": 800, "temperature": 0.2}
USERS, TASKS, QUESTIONS, JUDGES = 5, 5, 5, 8
SYSTEM = "You compare two answers to one question by comprehensiveness, diversity and empowerment."


def description(contexts: DataFrame, order: list[str], context: str = "context") -> DataFrame:
    """One row, description: heads and tails of the contexts, in order, a blank line between. A corpus of the evaluation is a
    few documents, 200 words of each; empty ones are left out."""
    cut = contexts.select(F.lit(1).alias("k"), *order, F.nullif(head_tail(F.col(context)), F.lit("")).alias("t"))
    return readers.joined(cut, "t", order, ["k"], "\n\n").select(F.col("text").alias("description"))


def generate_questions(contexts: DataFrame, order: list[str], make: Callable[[], models.Client], folder: str, name: str) -> list[str]:
    """The questions that a model thinks of for the corpus, also written to the folder. No contexts, or a call that fails,
    give none and an empty file."""
    spark = contexts.sparkSession
    numbers = {"users": F.lit(USERS), "tasks": F.lit(TASKS), "questions": F.lit(QUESTIONS)}
    asked = description(contexts, order).select(fill(readers.prompt("questions"), summary=F.col("description"), **numbers).alias("prompt"))
    told = models.ask(asked, "prompt", "answer", make, QUESTION_CALL, 1, tries=1)
    found = [q for r in told.select(questions(F.col("answer")).alias("q")).collect() for q in r.q or []]
    readers.write_queries(found, spark, folder, name)
    return found


def judge_prompt(query: Column, a: Column, b: Column) -> Column:
    return fill(readers.prompt("judge"), query=query, answer_a=a, answer_b=b)


def judge(a: DataFrame, b: DataFrame, make: Callable[[], models.Client], workers: int = JUDGES) -> DataFrame:
    """query, evaluation, parse_error, raw_text, error of every query that both answer; a call that fails has an error and no
    evaluation."""
    pairs = evaluation.align(a, b).withColumn("prompt", judge_prompt(F.col("query"), F.col("answer_a"), F.col("answer_b")))
    told = models.ask(pairs, "prompt", "answer", make, JUDGE_CALL, workers, tries=1, system=SYSTEM)
    read = told.select("query", "answer", parsing.verdict_of(F.col("answer")).alias("v"))
    return read.select("query", "v.evaluation", "v.parse_error", "v.raw_text", F.col("answer").isNull().alias("error"))


def compare(spark: SparkSession, dataset: str, name_a: str, a: DataFrame, name_b: str, b: DataFrame, make: Callable[[], models.Client], folder: str) -> DataFrame:
    """The tally of two methods' answers; items and tally are also written as <dataset>__<a>_vs_<b>.json."""
    items = durable(judge(a, b, make))
    tally = evaluation.tally(items)
    text = readers.judgment_json(items, tally, dataset, name_a, name_b).first()[0]
    readers._replace_text(spark, f"{folder.rstrip('/')}/{readers.judgment_name(dataset, name_a, name_b)}", text)
    return tally
