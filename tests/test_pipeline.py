import json

import pytest
from pyspark.sql import functions as F

from eventloom.functions import models
from eventloom.functions.durable import checkpoint_dir
from eventloom.operators import evaluation
from eventloom.plans import evaluation as flows
from eventloom.plans.pipeline import NO_EVENTS, EventLoom, Settings
from eventloom.sources import catalog, readers
from eventloom.streaming.ingest import ingest

TOPICS = ["rain floods rivers towns", "markets prices trade banks", "forests fires smoke wind", "trains rails strikes unions"]
TEXTS = ["\n".join(f"{t} {w} number {i} happened again today" for i in range(12) for w in t.split()[:2]) for t in TOPICS]


def make_client():
    """A client with the shapes of a model's answers; made inside, so that it travels by value."""

    def answer(message, parameters):
        said = message[0]["content"]
        if "**THOUGHTS**" in said:
            word = said.split("Passage:\n")[1].split()[0]
            return f'**THOUGHTS** about {word} **JSON** [{{"title": "{word}", "summary": "{word} rise", "influence": ["{word} rise", "more"], "actors": ["a"]}}]'
        if "How does the first event" in said:
            return '{"relation": "causal", "rationale": "r"}'
        return "answered: " + str("# Top Events Overview" in said)

    return lambda: answer


def loom(spark, path, **more):
    registry = models.Registry()
    registry.clients["test"] = make_client()
    return EventLoom(spark, str(path), Settings(client="test", least_chars=60, **more), registry)


def test_insert_is_idempotent_and_retrieve_answers(spark, tmp_path):
    it = loom(spark, tmp_path)
    docs = spark.createDataFrame([(t,) for t in [*TEXTS, TEXTS[0], "one line", None]], "text string")
    n = it.insert(docs).count()
    assert n >= 4 and it.insert(docs).count() == n
    documents = it.catalog.table("documents").collect()
    assert sorted(r.doc_id for r in documents) == [1, 2, 3, 4, 5]
    assert it.catalog.document_text(documents[0].doc_id) == documents[0].text and it.catalog.document_text(99) is None
    ids = [r.chunk_id for r in it.catalog.chunks(3, 1).collect()]
    assert ids == [2, 3, 4][: n - 1] and it.catalog.chunks(offset=2).count() == n
    assert it.retrieve("floods in towns") == "answered: True"
    run = it.catalog.latest_run("floods in towns").first()
    assert run.events and run.relations and run.ratings and run.relations[0].source_id in {e.id for e in run.events}
    assert abs(sum(r.pagerank for r in run.ratings) - 1) < 1e-6
    assert it.catalog.latest_run("other").count() == 0
    assert it.predict("will it rain?") == "answered: False" and it.predict("q", it.context) == "answered: True"


@pytest.mark.parametrize("method", ["none", "rake", "yake"])
def test_other_keyword_methods(spark, tmp_path, method):
    assert loom(spark, tmp_path, keyword_method=method).insert(spark.createDataFrame([(TEXTS[0],)], "text string")).count() > 0


def test_nothing_stored(spark, tmp_path):
    assert loom(spark, tmp_path).retrieve("q") == NO_EVENTS


def test_stream_of_documents(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(TEXTS[1],), (TEXTS[2],)], "text string").coalesce(1).write.json(str(source))
    it = loom(spark, tmp_path / "store")
    query = ingest(spark.readStream.schema("text string").json(str(source)), it, str(tmp_path / "state"))
    query.awaitTermination(120)
    assert it.catalog.table("documents").count() == 2


@pytest.mark.parametrize(
    ("value", "rows"),
    [
        ([{"a": 1, "b": "x"}, {"a": 2}], [{"a": 1, "b": "x"}, {"a": 2, "b": None}]),
        (["x", "y"], [{"value": "x"}, {"value": "y"}]),
        ({"data": [{"a": 1}], "n": 1}, [{"a": 1}]),
        ({"p": [1, 2], "q": ["x", "y"]}, [{"p": "1", "q": "x"}, {"p": "2", "q": "y"}]),
        ({"k": "v", "l": 2}, [{"key": "k", "value": "v"}, {"key": "l", "value": "2"}]),
        ("word", [{"value": "word"}]),
        ([], []),
    ],
)
def test_json_shapes(spark, tmp_path, value, rows):
    path = tmp_path / "x.json"
    path.write_text(json.dumps(value))
    assert [r.asDict() for r in readers.json_rows(spark, str(path)).collect()] == rows


def test_readers(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" a \n\n# no\nb\n")
    assert [r[0] for r in readers.lines(spark, str(tmp_path / "q.txt")).collect()] == ["a", "# no", "b"]
    assert readers.lines(spark, str(tmp_path / "q.txt"), comments=True).count() == 2
    (tmp_path / "l.jsonl").write_text('{"context": "x"}\n\n{"context": null}\n')
    frame = readers.json_lines(spark, str(tmp_path / "l.jsonl"))
    assert readers.column(frame, "context").count() == 1
    with pytest.raises(ValueError):
        readers.column(frame, "none")
    with pytest.raises(FileNotFoundError):
        readers.prompt("none")
    (tmp_path / "a.json").write_text('[{"query": "q", "answer": "a"}]')
    assert readers.answers(spark, str(tmp_path / "a.json")).count() == 1
    (tmp_path / "b.json").write_text('[{"query": "q"}]')
    with pytest.raises(Exception, match="array of answers"):
        readers.answers(spark, str(tmp_path / "b.json")).collect()
    articles = spark.createDataFrame([([(" t ", "x"), ("", " "), (None, "y")],), (None,)], "a array<struct<title:string,text:string>>")
    assert [r[0] for r in articles.select(readers.articles_corpus(F.col("a"))).collect()] == ["t\n\nx\n\n---\n\ny", ""]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "answers")
    new = lambda *rows: spark.createDataFrame(list(rows), "query string, answer string")
    assert readers.append_answers(spark, new(("a", "1")), path).count() == 1
    assert sorted(tuple(r) for r in readers.append_answers(spark, new(("a", "2"), ("b", "3"), ("b", "4")), path).collect()) == [("a", "1"), ("b", "3")]
    one_file = str(tmp_path / "answers.json")
    assert [tuple(r) for r in readers.resume_answers(spark, new(("b", "1")), one_file).collect()] == [("b", "1")]
    readers.resume_answers(spark, new(("b", "2"), ("a", "ü")), one_file)
    assert json.loads((tmp_path / "answers.json").read_text()) == [{"query": "b", "answer": "1"}, {"query": "a", "answer": "ü"}]
    (tmp_path / ".answers.json.crc").unlink()
    (tmp_path / "answers.json").write_text("{broken")
    assert readers.resume_answers(spark, new(("c", "3")), one_file).count() == 1 and readers.answers(spark, one_file).count() == 1
    assert readers.write_queries(["q 1", "q 2"], spark, str(tmp_path), "d") == f"{tmp_path}/d_queries.txt" and (tmp_path / "d_queries.txt").read_text() == "q 1\nq 2\n"
    with pytest.raises(ValueError):
        readers.joined(new(("a", "1")), "answer", ["query"], [])
    assert readers.answers_path("x/y.json") == "x/y.json" and readers.answers_path("x") == "x/answers.json"
    items = spark.createDataFrame([("q", {"Diversity": ("Answer 1", "")})], "query string, evaluation map<string,struct<Winner:string,Explanation:string>>")
    out = json.loads(readers.judgment_json(items, evaluation.tally(items), "d", "x", "y").first()[0])
    assert out["final_eval"]["Diversity"]["method_a"] == {"count": 1, "percent": 100.0} and readers.judgment_name("d", "x", "y") == "d__x_vs_y.json"
    rows = spark.createDataFrame([("q", 1.0, "m", None, None)], "question string, ground_truth double, model_answer string, model_score double, brier double")
    assert json.loads(readers.brier_json(rows, None).first()[0])["overall_brier"] is None
    with pytest.raises(ValueError):
        readers.plot_data("pairs", spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "i int, j int, similarity double"))


def test_first_of_equal_texts(spark):
    rows = spark.createDataFrame([(2, 0, "x"), (1, 5, "x"), (1, 6, "y")], "doc_id long, chunk_idx int, text string")
    assert sorted(tuple(r) for r in catalog.first_of_equal_texts(rows, ["doc_id", "chunk_idx"]).collect()) == [(1, 5, "x"), (1, 6, "y")]


def test_vectors_are_read_through_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "c")], "i int, t string")
    first = {r.i: r.v for r in models.embed_cached(rows, "t", "v", models.hashing_embedder, str(tmp_path / "v")).collect()}
    assert first[1] == first[3] and first[2] is None and spark.read.parquet(str(tmp_path / "v")).count() == 2
    broken = lambda: lambda texts: (_ for _ in ()).throw(ValueError("asked again"))
    again = {r.i: r.v for r in models.embed_cached(rows, "t", "v", broken, str(tmp_path / "v")).collect()}
    assert again == first


def test_calls_are_logged_and_counted(spark, tmp_path):
    it = loom(spark, tmp_path, log_calls=True, cache_vectors=True)
    it.insert(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    log = it.catalog.path("calls")
    assert readers.call_count(spark, log) == 0
    it.retrieve("floods in towns")
    assert readers.call_count(spark, log) >= 3 and spark.read.parquet(log).where("answer is null").count() == 0
    assert {r.stop_reason for r in it.diagnostics.collect()} <= {"max_n", "quota_exhausted", "gain_drop", "min_gain", "negative", "sim_floor"}


def judging_client():
    def answer(message, parameters):
        said = message[-1]["content"]
        if "kinds of users" in said:
            return "- User 1\n  - Task 1\n    - **Question 1**: What rains?\n    - Question 2: Who pays? \n"
        if "broken" in said:
            raise OSError("no service")
        if "odd" in said:
            return "I cannot say"
        return json.dumps({"content": json.dumps({k: {"Winner": "Answer 1", "Explanation": message[0]["role"]} for k in ("Comprehensiveness", "Diversity", "Empowerment", "Overall Winner")})})

    return lambda: answer


def test_questions_and_judgments(spark, tmp_path):
    contexts = spark.createDataFrame([(1, "rain and floods"), (2, None), (3, " "), (4, "banks")], "i int, context string")
    assert flows.description(contexts, ["i"]).first()[0] == "rain and floods\n\nbanks"
    assert flows.generate_questions(contexts, ["i"], judging_client(), str(tmp_path), "d") == ["What rains?", "Who pays?"]
    assert (tmp_path / "d_queries.txt").read_text() == "What rains?\nWho pays?\n"
    assert flows.generate_questions(contexts.limit(0), ["i"], judging_client(), str(tmp_path), "e") == [] and (tmp_path / "e_queries.txt").read_text() == ""
    side = lambda *q: spark.createDataFrame([(x, f"about {x}") for x in q], "query string, answer string")
    found = {r.query: r for r in flows.judge(side("q", "odd", "broken"), side("broken", " q\t", "odd", "z"), judging_client()).collect()}
    assert set(found) == {"q", "odd", "broken"} and found["q"].evaluation["Diversity"].Explanation == "system"
    assert found["odd"].parse_error and found["odd"].raw_text == "I cannot say" and found["broken"].error and found["broken"].evaluation is None
    tally = {r.category: r for r in flows.compare(spark, "d", "x", side("q", "odd"), "y", side("q", "odd"), judging_client(), str(tmp_path)).collect()}
    assert (tally["Overall"].first, tally["Overall"].second) == (1, 0)
    assert json.loads((tmp_path / "d__x_vs_y.json").read_text())["final_eval"]["Diversity"]["total"] == 1


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext, conf = Context, type("Conf", (), {"get": staticmethod(lambda *_: None)})

    class Nothing:
        isDefined = staticmethod(lambda: False)

    monkeypatch.setattr(Context, "_jsc", type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Nothing)}))}))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session)
