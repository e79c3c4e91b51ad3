"""The ranked context of an answer: one card for each top event with its relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import join_list, join_numbers
from eventloom.operators.graph import TOP_EVENTS

#: The lines of the context.
TITLE = "# Top Events Overview\n"
LEAD = "Below are the top %d events ranked by their influence score.\n"
LINES = (
    ("**Score:** ", "score"),
    ("**Description:** ", "summary"),
    ("**Actors:** ", "actors"),
    ("**Locations:** ", "locations"),
    ("**Associated Numbers:** ", "numbers"),
    ("**Influence chain:** ", "influence"),
    ("**Relations (outgoing):** ", "outgoing"),
    ("**Relations (incoming):** ", "incoming"),
)


def top_events(events: DataFrame, scores: DataFrame, n: int = TOP_EVENTS) -> DataFrame:
    """The n best events with score and rank; a missing score is 0, ties keep the order of pos."""
    both = events.join(scores.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    best = both.orderBy(F.col("score").desc(), "pos").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "pos")))


def relation_lists(relations: DataFrame, top: DataFrame) -> DataFrame:
    """id, outgoing, incoming: relations (pos, source_id, target_id, label) of the top events in order of pos."""
    shown = F.format_string("(%d -> %d: %s)", "source_id", "target_id", F.coalesce("label", F.lit("none")))
    known = relations.where("source_id is not null and target_id is not null").select("pos", "source_id", "target_id", shown.alias("t"))
    ids = top.select("id")  # Spark broadcasts the few top events

    def side(name: str, alias: str) -> DataFrame:
        own = known.withColumnRenamed(name, "id").join(ids, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("x"))
        return own.select("id", F.array_join(F.col("x.t"), ", ").alias(alias))

    return top.select("id").join(side("source_id", "outgoing"), "id", "left").join(side("target_id", "incoming"), "id", "left")


def cards(top: DataFrame, lists: DataFrame) -> DataFrame:
    """rank, id, card of the top events (id, rank, score, title, summary, description, actors, locations, associated_numbers, influence)."""
    filled = lambda c: F.when(c != "", c)
    values: dict[str, Column] = {
        "score": F.format_string("%.4f", "score"),
        "summary": F.coalesce(filled(F.col("summary")), filled(F.col("description")), F.lit("-")),
        "actors": join_list(F.col("actors")),
        "locations": join_list(F.col("locations")),
        "numbers": join_numbers(F.col("associated_numbers")),
        "influence": join_list(F.col("influence")),
        "outgoing": F.coalesce("outgoing", F.lit("-")),
        "incoming": F.coalesce("incoming", F.lit("-")),
    }
    title = F.coalesce(filled(F.col("title")), F.format_string("Event %d", "id"))
    head = F.format_string("## %d. [%d] %s", "rank", "id", title)
    return top.join(lists, "id", "left").select("rank", "id", F.concat_ws("\n", head, *[F.concat(F.lit(k), values[v]) for k, v in LINES]).alias("card"))


def context(made: DataFrame) -> DataFrame:
    """One row, the whole context: the top events are few by definition."""
    all_cards = made.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "card"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: F.concat(x.card, F.lit("\n"))), "\n")
    return all_cards.select(F.trim(F.concat(F.lit(TITLE + "\n"), F.format_string(LEAD + "\n", "n"), body), F.lit("\n ")).alias("context"))
