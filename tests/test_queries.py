import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.operators import clustering, sentences
from eventloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["sentence_spans", "paragraph_spans", "embed_clean", "rake_keywords", "yake_keywords"])
def test_other_queries_give_rows(name, spark, sf_dir):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_sentence_sql_splits_dialogue(spark, duck, tmp_path):
    """The SQL of the line mode against the operator's own split on made texts."""
    rng = random.Random(9)
    bits = ['He said "No." ', "Then left. ", "(Why?) ", "\t", "\n", "\r\n", "…", "e.g.", "»Ja!« ", "Plain words", "\u00a0", "!", "'Go!']] on", "\u3000x", "."]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    want = sorted((i, n, s) for i, t in texts for n, (s, _) in enumerate(sentences.split_sentences(t)))
    duck.register("made", pd.DataFrame(texts, columns=["doc_id", "text"]))
    got = duck.execute(catalogue.ORACLE_SQL["sentence_lines"].replace("FROM documents", "FROM made")).fetchall()
    assert sorted((i, n, s) for i, n, s in got) == want


def test_sentence_queries_split_dialogue(spark, tmp_path):
    """Quote-ended sentences within a line and lines of tabs, by a split of our own."""
    texts = {1: 'He said "Go." Then he left.\nA plain line. It stays whole.', 2: "\t\nFirst line here\r\n\t \n\tSecond line here\t", 3: None}
    want = {
        1: ['He said "Go."', "Then he left.", "A plain line. It stays whole."],
        2: ["First line here", "Second line here"],
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path))
    lines = [(d, i, x) for d, all_of in want.items() for i, x in enumerate(all_of)]
    assert sorted(map(tuple, run("sentence_lines").collect())) == lines
    windows = [(d, i, len(" ".join(want[d][max(0, i - 2) : i + 3]))) for d, i, _ in lines]
    assert sorted((r.doc_id, r.idx, r.n_chars) for r in run("sentence_windows").collect()) == windows
    assert run("chunk_text_unique").count() == len(lines)
    assert {r.doc_id: r.n for r in run("keyword_interleave").collect()}.keys() == want.keys()
    made = run("segments").groupBy("doc_id").agg({"n_chars": "sum", "to_idx": "max"}).collect()
    assert {r.doc_id: (r["sum(n_chars)"], r["max(to_idx)"]) for r in made} == {d: (sum(map(len, x)), len(x) - 1) for d, x in want.items()}


def test_kmeans_sweep_finds_more_than_seven_clusters(spark, tmp_path):
    """Eight far points, two of them twice: k = 8 is best, and every k that ten rows allow is tried."""
    points = [[100.0 * (i == j) for j in range(8)] for i in range(8)]
    rows = [(i, p) for i, p in enumerate(points + [[x + 0.1 for x in points[0]], [x + 0.1 for x in points[1]]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.k: r.is_best for r in catalogue.QUERIES["kmeans_sweep"](spark, str(tmp_path)).collect()}
    assert set(found) > {5, 6, 7, 8} and [k for k, best in found.items() if best] == [8]


def test_sweep_works_out_runs_and_distances_once(spark, monkeypatch):
    """Every k has its runs once, the best k as well; one pass over the pairs gives the scores that each k has by itself."""
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)], i % 2) for i in range(12)], "n long, v array<double>, label int")
    runs, passes, own = [], [], clustering.silhouettes

    class Counted(clustering.KMeans):
        def fit(self, *args):
            runs.append(self.getK())
            return super().fit(*args)

    monkeypatch.setattr(clustering, "KMeans", Counted)
    monkeypatch.setattr(clustering, "silhouettes", lambda *args: passes.append(1) or own(*args))
    made, scores = clustering.sweep(rows, "n", "v", 2, 4, 3)
    assert sorted(runs) == [2] * 3 + [3] * 3 + [4] * 3 and len(passes) == 1
    assert made.columns == ["n", "v", "label", "cluster_id"]
    found = {r.k: r for r in scores.collect()}
    best = next(k for k, r in found.items() if r.is_best)
    assert best == max(found, key=lambda k: found[k].score)
    each = {k: clustering.kmeans(rows, "v", k, 3) for k in (2, 3, 4)}
    for k, one in each.items():
        assert clustering.silhouette_scores(one, "n", "v", "cluster_id").agg({"silhouette": "avg"}).first()[0] == pytest.approx(found[k].score)
    ids = lambda df: sorted((r.n, r.cluster_id) for r in df.collect())
    assert ids(made) == ids(each[best])


def test_a_pass_answers_all_runs(spark, monkeypatch):
    """Far groups are found by the best run, and all runs of all k share the passes over the rows, which are tens."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, (np.eye(6)[i % 6] + rng.normal(size=6) * 0.02).tolist()) for i in range(120)], "n long, v array<double>")
    passes, own = [], clustering._answers
    monkeypatch.setattr(clustering, "_answers", lambda held, asked: passes.append(len(asked)) or own(held, asked))
    made, scores = clustering.sweep(rows, "n", "v", 5, 7, 4)
    groups = {(r.n % 6, r.cluster_id) for r in made.collect()}
    assert len(groups) == 6 and [r.k for r in scores.collect() if r.is_best] == [6]
    assert passes[0] == 12 and len(passes) < 60
    monkeypatch.setattr(clustering, "MOST_NUMBERS", 1)
    assert {(r.n % 6, r.cluster_id) for r in clustering.kmeans(rows, "v", 6, 2).collect()} and max(passes[-3:]) == 1
    assert clustering.kmeans(rows.limit(0), "v", 2).count() == 0


def test_silhouettes_are_of_all_pairs(spark):
    """Rows in several blocks, copies, a row alone, a row without a cluster, two clusterings at once, by brute force."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 3)).round(1)
    v[7], v[8] = v[6], v[6]
    a = [None if i == 9 else 77 if i == 10 else int(i % 3) for i in range(300)]
    rows = spark.createDataFrame([(i, v[i].tolist(), a[i], i % 2) for i in range(300)], "id long, v array<double>, a int, b int")
    gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    want = {}
    for n, label in enumerate((a, [i % 2 for i in range(300)])):
        for i, own in enumerate(label):
            mean = {c: np.mean(gap[i][[j for j in range(300) if j != i and label[j] == c] or [i]]) for c in set(label) - {None}}
            lone = own is None or label.count(own) == 1
            near = 0 if lone else min(d for c, d in mean.items() if c != own)
            want[n, i] = 0.0 if lone else (near - mean[own]) / max(near, mean[own])
    got = clustering.silhouettes(rows, "id", "v", ["a", "b"]).collect()
    assert {(r.n, r.k): r.silhouette for r in got} == {k: pytest.approx(x, abs=1e-12) for k, x in want.items()}
    assert {(r.n, r.k): r.c for r in got} == {(n, i): (a[i], i % 2)[n] for n, i in want}


def test_silhouette_has_no_sample(spark, tmp_path):
    rows = spark.range(10_101).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted((r.label, r.n) for r in catalogue.QUERIES["silhouette_exact"](spark, str(tmp_path)).collect()) == [(0, 5051), (1, 5050)]


def test_tfidf_counts_every_term(spark, tmp_path):
    """More terms than the 200,000 that counted once, each in two texts: all weights of a text are equal, and none is missing."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.char(97 + F.pmod(F.floor(F.col("id") / F.pow(F.lit(26), i)), F.lit(26)).cast("int")))
    terms = spark.range(250_000).select(F.array_join(letters, "").alias("t"), (F.col("id") % 25_000).alias("doc_id"))
    half = terms.groupBy("doc_id").agg(F.array_join(F.collect_list("t"), " ").alias("text"))
    half.unionByName(half.withColumn("doc_id", F.col("doc_id") + 25_000)).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["tfidf_topk"](spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("weight").alias("a"), F.max("weight").alias("b"))
    assert [tuple(r) for r in got.groupBy("n", "a", "b").count().collect()] == [(5, round(10**-0.5, 6), round(10**-0.5, 6), 50_000)]
