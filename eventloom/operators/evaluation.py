"""Evaluation: aligned answers, judging tallies, forecast scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import strip, truth

#: The categories of a judgment and the names under which they are reported.
CATEGORIES = {"Comprehensiveness": "Comprehensiveness", "Diversity": "Diversity", "Empowerment": "Empowerment", "Overall Winner": "Overall"}
FIRST, SECOND = "Answer 1", "Answer 2"


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """query, answer_a, answer_b of the queries (trimmed) that both have, in order; a repeated query is an error."""

    def once(side: DataFrame, name: str) -> DataFrame:
        counted = side.groupBy(strip("query").alias("query")).agg(F.min("answer").alias(name), F.count("*").alias("n"))
        return counted.where(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated query: "), F.col("query"))).cast("boolean")).otherwise(True)).drop("n")

    return once(a, "answer_a").join(once(b, "answer_b"), "query").orderBy("query")


def winner(evaluation: Column, category: str) -> Column:
    return F.coalesce(strip(evaluation[category]["Winner"]), F.lit(""))


def tally(rows: DataFrame, evaluation: str = "evaluation") -> DataFrame:
    """category, first, second, total, first_percent, second_percent; other winners do not count."""
    pairs = F.array(*[F.struct(F.lit(shown).alias("category"), winner(F.col(evaluation), name).alias("winner")) for name, shown in CATEGORIES.items()])
    won = rows.select(F.explode(pairs).alias("p")).select("p.*")
    counts = won.groupBy("category").agg(F.count_if(F.col("winner") == FIRST).alias("first"), F.count_if(F.col("winner") == SECOND).alias("second"))
    total = F.col("first") + F.col("second")
    percent = lambda c: F.when(total > 0, F.bround(100 * F.col(c) / total, 2)).otherwise(0.0)
    return counts.select("category", "first", "second", total.alias("total"), percent("first").alias("first_percent"), percent("second").alias("second_percent"))


def brier(p: Column, y: Column) -> Column:
    """Squared error of a probability, cut to 0..1, against a truth of 0 or 1; null if either is missing."""
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(p.isNotNull(), p.cast("double")))) - truth(y), F.lit(2.0))


def overall_brier(rows: DataFrame, p: str, y: str) -> DataFrame:
    score = F.when(F.col(p).isNotNull(), brier(F.col(p), F.col(y)))
    return rows.agg(F.count(score).alias("n"), F.avg(score).alias("overall_brier"))


def unanswered(queries: DataFrame, answers: DataFrame) -> DataFrame:
    return queries.join(answers.select("query").distinct(), "query", "left_anti")
