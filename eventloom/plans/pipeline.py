"""Insert, retrieve and predict, each as a chain of DataFrame steps; model calls are Arrow or pandas batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import models, parsing
from eventloom.functions.durable import durable
from eventloom.functions.text import embed_clean, fill
from eventloom.functions.vectors import mean_pool
from eventloom.operators import chunking, clustering, context, graph, keywords, selection, sentences
from eventloom.sources.catalog import Catalog
from eventloom.sources.readers import call_log, prompt

#: Answers where there is nothing to answer from, or the model fails.
NO_CONTEXT = "No events available."
NO_EVENTS = "No answer generated because no events were available."
FAILED = "Answer generation failed due to LLM invocation error."
FORECAST_FAILED = "Scratchpad generation failed due to LLM invocation error."


@dataclass(frozen=True)
class Settings:
    embedder: str = "hashing"
    client: str = "stub"
    workers: int = 10
    keyword_method: str = "tfidf"
    percent: float = chunking.PERCENT
    least_chars: int = chunking.MIN_CHARS
    mode: str = "line"
    selection: selection.Settings = field(default_factory=selection.Settings)
    entities: Callable[[str], list[str]] | None = models.capital_entities  # named before the keywords; None for none
    log_calls: bool = False  # prompts and answers kept in the catalog's folder
    cache_vectors: bool = False  # vectors of keyword texts kept in the catalog's folder


class EventLoom:
    """A catalog with models. ``insert`` takes many documents at once; ``retrieve`` and ``predict`` answer one query."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings(), registry: models.Registry | None = None) -> None:
        self.spark, self.settings, self.registry = spark, settings, registry or models.Registry()
        self.catalog = Catalog(spark, root)
        self.embedder = self.registry.embedder(settings.embedder)
        self.client = self.registry.client(settings.client)

    def chunk(self, docs: DataFrame) -> DataFrame:
        """doc_id, chunk_idx, from_idx, to_idx, text, keywords, embedding; documents of under two sentences give none."""
        s = self.settings
        rows = sentences.context_windows(sentences.sentences(docs, s.mode))
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n > 1").drop("n")
        if s.keyword_method == "tfidf":
            tokens = keywords.stems(F.col("combined"))
            terms = keywords.tfidf(rows.select("doc_id", "idx", "combined"), ["doc_id", "idx"], tokens, corpus=["doc_id"], stops=keywords.english_stops(), most=keywords.MOST_TERMS)
            words = terms.groupBy("doc_id", "idx").agg(F.reverse(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x.term)).alias("keywords"))
            rows = rows.join(words, ["doc_id", "idx"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
            if s.entities:
                rows = rows.withColumn("keywords", keywords.with_entities(F.col("combined"), F.col("keywords"), s.entities))
        else:
            rows = rows.withColumn("keywords", keywords.text_keywords(F.col("combined"), s.keyword_method, s.entities if s.keyword_method == "yake" else None))
        rows = self._embedded(rows.withColumn("cleaned", embed_clean(F.array_join("keywords", ", ")))).drop("cleaned")
        rows = durable(chunking.breakpoints(chunking.consecutive_distance(rows, "doc_id", "idx", "embedding"), "doc_id", s.percent))
        per_doc = rows.groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("idx", "start", (F.col("start") + F.length("sentence")).alias("end")))).alias("s"),
            F.sort_array(F.collect_list(F.when(F.col("is_break"), F.col("idx")))).alias("breaks"),
        )
        bounds = sentences.paragraphs(docs, s.mode).groupBy("doc_id").agg(F.sort_array(F.collect_list("p_end")).alias("bounds"))
        per_doc = per_doc.join(bounds, "doc_id", "left").select("doc_id", "breaks", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"), F.coalesce("bounds", F.array().cast("array<int>")).alias("bounds"))
        moved = per_doc.select("doc_id", F.explode(chunking.snapped(F.col("breaks"), F.col("starts"), F.col("ends"), F.col("bounds"))).alias("idx")).distinct().withColumn("hit", F.lit(True))
        rows = rows.drop("is_break").join(moved, ["doc_id", "idx"], "left").withColumn("is_break", F.coalesce("hit", F.lit(False)))
        rows = durable(chunking.segments(rows, "doc_id", "idx"))
        key = rows.select("*", F.struct("doc_id", "segment").alias("k"))
        vectors = mean_pool(key, "k", "embedding").select("k.doc_id", F.col("k.segment").alias("chunk_idx"), F.col("embedding").cast("array<float>").alias("embedding"))
        words = keywords.interleave(key, "k", "idx", "keywords").select("k.doc_id", F.col("k.segment").alias("chunk_idx"), "keywords")
        merged = chunking.merge_short(chunking.chunks(rows), least=s.least_chars)
        return merged.join(words, ["doc_id", "chunk_idx"], "left").join(vectors, ["doc_id", "chunk_idx"], "left")

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """rows with the vector of their cleaned text, every different text embedded once."""
        if self.settings.cache_vectors:
            return models.embed_cached(rows, "cleaned", "embedding", self.embedder, self.catalog.path(f"vectors_{self.settings.embedder}"))
        return models.embed_distinct(rows, "cleaned", "embedding", self.embedder)

    def _ask(self, prompts: DataFrame, answer: str, parameters: dict, workers: int, **how) -> DataFrame:
        told = models.ask(prompts, "prompt", answer, self.client, parameters, workers, **how)
        if self.settings.log_calls:
            told = durable(told)  # asked once, read by the log and by the caller
            call_log(told.select("prompt", F.col(answer).alias("answer")), self.catalog.path("calls"))
        return told

    def insert(self, texts: DataFrame) -> DataFrame:
        """Adds the documents of a text column and their chunks; known documents add nothing. Returns all chunks."""
        docs = durable(self.catalog.upsert_documents(texts))
        return self.catalog.insert_chunks(self.chunk(docs))

    def select_chunks(self, query: str) -> DataFrame:
        """Chosen chunks of the query with cluster, similarity and order."""
        held = self.catalog.table("chunks").where("embedding is not null")
        clustered, self.silhouettes = clustering.sweep(held, "chunk_id", "embedding")
        asked = self.spark.range(1).select(F.lit(0).cast("long").alias("query_id"), models.embed(embed_clean(F.lit(query)), self.embedder).alias("query_vector"))
        chosen, quotas = selection.Compared(clustered, durable(asked), self.settings.selection).select()
        chosen = durable(chosen)
        #: sizes, quotas, picks and the reason to stop, by cluster
        self.diagnostics = selection.diagnostics(chosen, quotas)
        return chosen.join(held.select("chunk_id", "doc_id", "from_idx", "to_idx", "text"), "chunk_id")

    def extract_events(self, chosen: DataFrame, query: str) -> DataFrame:
        """Events of the chosen chunks, numbered from 1 by pick and place in the answer."""
        asked = chosen.withColumn("prompt", fill(prompt("events"), query=F.lit(query), text=F.col("text")))
        told = self._ask(asked, "answer", {"max_new_tokens": 3000}, self.settings.workers, accept=parsing.is_readable)
        parts = told.withColumn("a", parsing.answer_parts(F.col("answer")))
        found = parts.select("pick", "chunk_id", "cluster_id", "from_idx", "to_idx", F.col("a.thoughts").alias("thoughts"), F.posexplode(parsing.events_of(F.col("a.json"))).alias("at", "e"))
        number = F.row_number().over(Window.orderBy("pick", "at"))  # tens of events
        return found.select(number.cast("long").alias("id"), "e.*", "chunk_id", "cluster_id", F.col("from_idx").alias("source_from_idx"), F.col("to_idx").alias("source_to_idx"), "thoughts").withColumn("pos", F.col("id"))

    def relate(self, events: DataFrame) -> DataFrame:
        """Labelled relations of the closest pairs of events: pos, source_id, target_id, similarity, relation_raw, label."""
        vector = lambda text: models.embed(embed_clean(text), self.embedder)
        summaries = events.select(F.col("id").alias("event"), vector(F.coalesce("summary", "description")).alias("vector"))
        influences = events.select(F.col("id").alias("event"), F.explode("influence").alias("t")).select("event", vector(F.col("t")).alias("vector"))
        self.pairs = durable(graph.candidate_pairs(summaries, influences))
        best = graph.top_pairs(self.pairs)
        said = events.select("id", F.to_json(F.struct("title", "summary", "influence")).alias("j"))
        both = best.join(said.select(F.col("id").alias("i"), F.col("j").alias("s")), "i").join(said.select(F.col("id").alias("j"), F.col("j").alias("t")), "j")
        told = self._ask(both.withColumn("prompt", fill(prompt("relation"), source=F.col("s"), target=F.col("t"))), "relation_raw", {"max_new_tokens": 3000}, self.settings.workers, tries=1)
        pos = F.row_number().over(Window.orderBy(F.col("similarity").desc(), "i", "j"))
        return told.select(pos.alias("pos"), F.col("i").alias("source_id"), F.col("j").alias("target_id"), "similarity", "relation_raw", parsing.relation_label(F.lit(None).cast("string"), F.col("relation_raw")).alias("label"))

    def retrieve(self, query: str) -> str:
        """The model's answer from the ranked events; the run, its relations and ratings are stored."""
        self.context = NO_CONTEXT
        if self.catalog.table("chunks").where("embedding is not null").limit(1).count() == 0:
            return NO_EVENTS
        events = durable(self.extract_events(durable(self.select_chunks(query)), query))
        as_json = lambda rows: rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).first()[0]  # noqa: E731  a run's tens of rows
        if not events.limit(1).count():
            return NO_EVENTS
        run_id = self.catalog.insert_run(query, as_json(events))
        relations = durable(self.relate(events))
        nodes = events.select("id")
        made = durable(graph.edges(relations, nodes))
        scores = durable(graph.ratings(made, nodes))
        self.catalog.update_run(run_id, as_json(relations), as_json(scores))
        top = durable(context.top_events(events, scores))
        self.context = context.context(context.cards(top, context.relation_lists(relations, top))).first()[0]
        asked = self.spark.range(1).select(fill(prompt("answer"), query=F.lit(query), retrieval_context=F.lit(self.context)).alias("prompt"))
        return self._ask(asked, "answer", {"max_new_tokens": 2000}, 1, tries=1, failed=FAILED).first()["answer"]

    def predict(self, query: str, background: str = "") -> str:
        """The model's forecast; the background is empty unless it is given, say as ``context`` of a retrieval."""
        asked = self.spark.range(1).select(fill(prompt("forecast"), query=F.lit(query), background=F.lit(background)).alias("prompt"))
        return self._ask(asked, "answer", {"max_new_tokens": 2000}, 1, tries=1, failed=FORECAST_FAILED).first()["answer"]
