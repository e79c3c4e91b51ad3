import json
import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from eventloom.functions import blocks, models, parsing, stemming, text, vectors
from eventloom.operators import chunking, context, evaluation, graph, keywords, selection, sentences
from eventloom.plans import catalogue


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()[0]


def test_line_mode_takes_the_rest_of_the_line_unless_a_quote_ends_the_sentence():
    assert sentences.split_sentences('One. Two here.\r\nHe said "No." Then left\n\n...  ok then') == [("One. Two here.", 0), ('He said "No."', 15), ("Then left", 29), ("ok then", 45)]
    assert sentences.split_sentences("e.g.\nLonger line etc.") == [("Longer line etc.", 5)]


def test_sentence_mode_splits_inside_lines():
    assert [s for s, _ in sentences.split_sentences('One two. Three four! "Five?" six', "sentence")] == ["One two.", "Three four!", '"Five?"', "six"]


def test_paragraphs_tile_the_text():
    body = "# Head\n\nPara one\nline two\n\n- item\n<p>x</p>"
    for mode in ("line", "sentence"):
        spans = sentences.paragraph_spans(body, mode)
        assert spans[0][0] == 0 and spans[-1][1] == len(body) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sentences.paragraph_spans("") == []


def test_sentences_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "A b c.\nD", "c")], "doc_id long, text string, idx string")
    assert [tuple(r) for r in sentences.sentences(docs).orderBy("doc_id", "idx").collect()] == [(3, 0, 0, "A b c."), (3, 1, 7, "D")]


def test_windows_are_cut_at_the_ends(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate("abcde")], "doc_id long, idx int, sentence string")
    assert [r.combined for r in sentences.context_windows(rows).orderBy("idx").collect()] == ["a b c", "a b c d", "a b c d e", "b c d e", "c d e"]


def merge_by_hand(lengths, least):
    held, i = [[n, i, i] for i, n in enumerate(lengths)], 0
    while i < len(held):
        if held[i][0] < least or (i + 1 < len(held) and held[i + 1][0] < least):
            first = True
            while i + 1 < len(held) and (first or held[i][0] + held[i + 1][0] <= least or held[i + 1][0] < least):
                first = False
                nxt = held.pop(i + 1)
                held[i] = [held[i][0] + 1 + nxt[0], held[i][1], nxt[2]]
        i += 1
    return [tuple(x) for x in held]


def test_merge_of_short_chunks(spark):
    rng = random.Random(3)
    cases = {d: [rng.randint(1, 30) for _ in range(rng.randint(1, 12))] for d in range(40)}
    rows = [(d, i, i, i, "x" * n) for d, ns in cases.items() for i, n in enumerate(ns)]
    made = chunking.merge_short(spark.createDataFrame(rows, "doc_id long, chunk_idx int, from_idx int, to_idx int, text string"), least=15)
    found = {}
    for r in made.orderBy("doc_id", "from_idx").collect():
        found.setdefault(r.doc_id, []).append((len(r.text), r.from_idx, r.to_idx))
    assert found == {d: merge_by_hand(ns, 15) for d, ns in cases.items()}


def snap_by_hand(breaks, starts, ends, bounds):
    out = []
    paragraph = lambda at: min(len(bounds) - 1, sum(e < at for e in bounds))
    size = lambda p: bounds[p] - (bounds[p - 1] if p else 0)
    for i in breaks:
        if i + 1 >= len(starts):
            out.append(i)
            continue
        at = starts[i + 1]
        p = min(len(bounds) - 1, sum(e <= at for e in bounds))
        ok = lambda q: at < bounds[q] <= at + min(400, int(size(q) * 0.6))
        near = [bounds[p]] if ok(p) else []
        if p + 1 < len(bounds) and (size(p) < 120 or not near) and ok(p + 1):
            near.append(bounds[p + 1])
        if not near:
            out.append(i)
            continue
        target = min(near, key=lambda e: abs(e - at))
        new = max(0, min(len(starts) - 2, sum(e < target for e in ends) - 1))
        out.append(i if paragraph(ends[new]) < paragraph(ends[i]) else new)
    return sorted(set(out))


def test_snapping_to_paragraph_ends(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        sizes = [rng.randint(5, 90) for _ in range(rng.randint(2, 14))]
        ends = np.cumsum(sizes).tolist()
        starts = [0] + [e + 1 for e in ends[:-1]]
        bounds = sorted({*rng.sample(range(1, ends[-1]), k=min(4, ends[-1] - 1)), ends[-1]})
        rows.append((sorted(rng.sample(range(len(sizes)), k=rng.randint(0, len(sizes) - 1))), starts, ends, bounds))
    df = spark.createDataFrame(rows, "b array<int>, s array<int>, e array<int>, p array<int>")
    got = df.select("*", chunking.snapped(*map(F.col, "bsep")).alias("x")).collect()
    assert [r.x for r in got] == [snap_by_hand(r.b, r.s, r.e, r.p) for r in got]
    assert one(spark, chunking.snapped(F.array(F.lit(3), F.lit(1)), F.array(F.lit(0)), F.array(F.lit(1)), F.array().cast("array<int>"))) == [1, 3]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0.0
    assert one(spark, vectors.unit(v(0, 0))) == [0.0, 0.0]
    assert one(spark, vectors.unit(v(3, 4))) == pytest.approx([0.6, 0.8])
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (1, None)], "k long, v array<double>")
    assert vectors.mean_pool(rows, "k", "v").first().v == pytest.approx([math.sqrt(0.5)] * 2)


def test_text_functions(spark):
    assert one(spark, text.fill("$a and ${b} $$ $c", a=F.lit("$b"), b=F.lit("2"))) == "$b and 2 $ $c"
    assert one(spark, text.star_number(F.lit("so *0,35* \n"))) == 0.35
    assert one(spark, text.star_number(F.lit("*0.35* more"))) is None
    assert [one(spark, text.truth(F.lit(x))) for x in ("1", "0.0", "0.5", "x", "")] == [1.0, 0.0, None, None, None]
    assert one(spark, text.join_list(F.array(F.lit("a"), F.lit(" "), F.lit(None), F.lit("b")))) == "a; b"
    assert one(spark, text.join_list(F.lit(None).cast("array<string>"))) == "-"
    assert one(spark, text.split_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, text.embed_clean(F.lit("The Café’s 12 cats, und Übung!"))) == unicodedata.normalize("NFKD", "café’s cats übung")


def test_white_space_of_every_kind_is_stripped(spark):
    for x in ("\t a \u00a0b\u3000\x1f", "\n\u2028", "", "x"):
        assert one(spark, text.strip(F.lit(x))) == x.strip()
    assert all(c.isspace() for c in text.WHITE_SPACE) and len(text.WHITE_SPACE) == sum(chr(c).isspace() for c in range(0x110000))
    assert one(spark, text.questions(F.lit("- Question 1:\u00a0why\t\n"))) == ["why"]


def test_head_tail(spark):
    words = [f"w{i}" for i in range(3000)]
    assert one(spark, text.head_tail(F.lit(" ".join(words)))).split() == words[1000:1100] + words[1900:2000]
    assert one(spark, text.head_tail(F.lit(" ".join(words[:600])))).split() == words[500:600] + words[500:600]
    assert one(spark, text.head_tail(F.lit(" a  b "))) == "a  b"


def test_answers_of_models():
    assert parsing.split_answer("None") == ("None", "[]")
    assert parsing.split_answer("**Thoughts** hm **JSON** [1]") == ("hm", "[1]")
    assert parsing.split_answer('{"events": [{"a": 1}]}') == (None, '[{"a": 1}]')
    assert parsing.split_answer("see [x] then [[1], 2] ok") == (None, "[[1], 2]")
    assert parsing.split_answer("nothing [") == (None, None)
    assert [parsing.is_readable(x) for x in ("None", "[]", "**THOUGHTS** **JSON** ```[1]```", "x", None)] == [True, True, False, False, False]


def test_events_and_verdicts(spark):
    events = one(spark, parsing.events_of(F.lit('{"events": [{"title": "t", "influence": ["i"], "confidence": 0.5}]}')))
    assert events[0].title == "t" and events[0].influence == ["i"]
    assert one(spark, parsing.verdict_of(F.lit('so: {"Diversity": {"Winner": "Answer 1", "Explanation": "e"}} end'))).evaluation["Diversity"].Winner == "Answer 1"
    assert one(spark, parsing.verdict_of(F.lit("no"))).parse_error is True and one(spark, parsing.verdict_of(F.lit("no "))).raw_text == "no"
    inner = '{"Diversity": {"Winner": "Answer 2", "Explanation": "e"}}'
    for shape in ({"content": inner}, {"choices": [{"message": {"content": inner}}]}, [{"content": inner}]):
        assert one(spark, parsing.verdict_of(F.lit(json.dumps(shape)))).evaluation["Diversity"].Winner == "Answer 2"
    assert one(spark, parsing.relation_label(F.lit(None).cast("string"), F.lit('{"relation": " Causal "}'))) == "causal"
    assert one(spark, parsing.relation_label(F.lit(None).cast("string"), F.lit("```{}```"))) is None


def test_stems():
    english = {"consign": "consign", "consistency": "consist", "knightly": "knight", "generously": "generous", "happy": "happi", "relational": "relat", "hopping": "hop", "hoping": "hope", "cries": "cri", "ties": "tie", "agreed": "agre", "skies": "sky", "goodness": "good", "gas": "gas", "activation": "activ"}
    assert {w: stemming.english(w) for w in english} == english
    german = {"aufeinanderfolge": "aufeinanderfolg", "kategorien": "kategori", "häuser": "haus", "verantwortungen": "verantwort", "arbeitest": "arbeit", "ergebnisse": "ergebnis"}
    assert {w: stemming.german(w) for w in german} == german
    assert stemming.language_of("Über uns") == "german" and stemming.language_of("about us") == "english"


def test_terms_stems_and_entities(spark):
    rows = spark.createDataFrame([(1, "The dogs were running, well-known Dogs 42"), (2, "Häuser und Straßen"), (3, None)], "k long, t string")
    got = {r.k: r.s for r in rows.select("k", keywords.stems(F.col("t")).alias("s")).collect()}
    assert got == {1: ["dog", "run", "dog"], 2: ["haus", "strass"], 3: []}
    made = spark.createDataFrame([("Ada met Bob", ["met", "Ada"]), (None, ["x"])], "t string, w array<string>")
    assert [r[0] for r in made.select(keywords.with_entities(F.col("t"), F.col("w"), models.capital_entities)).collect()] == [["Ada", "Bob", "met"], ["x"]]
    docs = spark.createDataFrame([(i, ["the", "a", "b"] if i % 2 else ["a", "c"]) for i in range(6)], "k long, w array<string>")
    terms = lambda **how: {r.term for r in keywords.tfidf(docs, ["k"], F.col("w"), **how).collect()}
    assert terms() == {"the", "a", "b", "c"} and terms(stops=("the",)) == {"a", "b", "c"} and terms(stops=("the",), most=2) == {"a", "b"} and terms(most=1) == {"a"}


def test_keyword_lists(spark):
    rows = spark.createDataFrame([(1, 0, ["A", "b"]), (1, 1, ["a", "c", "d"]), (2, 0, [])], "k long, idx int, words array<string>")
    assert keywords.interleave(rows, "k", "idx", "words").first().keywords == ["A", "b", "c", "d"]
    assert keywords.interleave(rows, "k", "idx", "words", limit=2).first().keywords == ["A", "b"]
    assert keywords.rake("fast red fox and the slow dog", stops=frozenset(["and", "the"])) == ["fast red fox", "slow dog"]
    assert "fox" in keywords.yake("The fox runs. A fox sleeps. Dogs bark.", stops=frozenset(["the", "a"]))
    with pytest.raises(ValueError):
        keywords.text_keywords(F.col("x"), "textrank")


def test_interleaving_shuffles_few_words_of_a_key(spark):
    """Struct keys, lists in several tasks, repeats in other case, by brute force; no task gives more than ``limit`` words of a key."""
    rng = random.Random(3)
    made = [(Row(a=n % 3, b="x"), n, [rng.choice("abcdefghijABCDEFGHIJ") + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 12))]) for n in range(300)]
    rows = spark.createDataFrame(made, "k struct<a:int,b:string>, idx int, words array<string>").repartition(5)
    want = {}
    for a in range(3):
        lists, seen = [w for k, _, w in made if k.a == a], {}
        for i in range(12):
            for w in lists:
                if i < len(w):
                    seen.setdefault(w[i].lower(), w[i])
        want[a] = list(seen.values())[:50]
    found = keywords.interleave(rows, "k", "idx", "words")
    assert {r.k.a: r.keywords for r in found.collect()} == want
    lists = keywords.interleave(rows, "k", "idx", "words", limit=4)._jdf.queryExecution()
    plan = lists.executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")  # outermost first: words are cut before they travel


def pick_by_hand(vectors_, sim, cluster, quota, s, doc=None):
    """The rule: the best allowed candidate is held against every stop, its own similarity against the floor, then picked."""
    picks, near, doc = [], [0.0] * len(sim), doc or list(range(len(sim)))
    while len(picks) < min(s.most, len(sim)):
        used = [i for i, _ in picks]
        taken = lambda i: sum(cluster[j] == cluster[i] for j in used)
        ok = [i for i in range(len(sim)) if i not in used and (s.soft_quotas or taken(i) < quota.get(cluster[i], 0))]
        if s.per_doc_max is not None:
            ok = [i for i in ok if sum(doc[j] == doc[i] for j in used) < s.per_doc_max]
        if not ok:
            return picks, "quota_exhausted"
        gain = {i: s.lam * sim[i] - (1 - s.lam) * near[i] - (s.overflow_penalty * max(0, taken(i) + 1 - quota.get(cluster[i], 0)) if s.soft_quotas else 0) for i in ok}
        best = max(ok, key=lambda i: (gain[i], -i))
        if len(picks) >= s.fewest:
            if np.mean([g for _, g in picks[-3:]]) <= s.gain_drop * abs(picks[0][1]):
                return picks, "gain_drop"
            if gain[best] <= s.min_gain:
                return picks, "min_gain"
            if gain[best] <= 0 and s.stop_negative:
                return picks, "negative"
            if sim[best] <= np.quantile([sim[i] for i in ok], s.floor_quantile):
                return picks, "sim_floor"
        picks.append((best, gain[best]))
        near = [max(near[i], float(vectors_[i] @ vectors_[best])) for i in range(len(sim))]
    return picks, "max_n"


def test_greedy_picks():
    rng, reasons = np.random.default_rng(1), set()
    for i in range(60):
        v = rng.normal(size=(40, 8)) + (1 if i % 2 else 0.2)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sim, cluster, quota = v @ v[0], rng.integers(0, 4, 40), {0: 9, 1: 3, 2: 8, 3: 8}
        s = selection.Settings(min_n=4, max_n=15, soft_quotas=i % 3 == 0, per_doc_max=2 if i % 5 == 0 else None, floor_quantile=0.7 if i % 4 else 0.0)
        doc = rng.integers(0, 12, 40)
        got, want = selection.pick(v, sim, cluster, doc, quota, s), pick_by_hand(v, sim, cluster.tolist(), quota, s, doc.tolist())
        assert [i for i, _ in got[0]] == [i for i, _ in want[0]] and got[1] == want[1]
        reasons.add(got[1])
    assert {"sim_floor", "max_n"} <= reasons


def test_normalised_similarity_comes_before_quotas(spark):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(i, int(i % 3), rng.normal(size=6).tolist() if i else None) for i in range(31)], "chunk_id long, cluster_id int, embedding array<double>")
    asked = spark.createDataFrame([(7, rng.normal(size=6).tolist())], "query_id long, query_vector array<double>")
    plain = {r.chunk_id: r.similarity for r in selection.scored(chunks, asked).collect()}
    raw = np.array(list(plain.values()))
    z = {r.chunk_id: r.similarity for r in selection.scored(chunks, asked, selection.Settings(zscore=True)).collect()}
    assert len(plain) == 30 and z == {i: pytest.approx((x - raw.mean()) / (raw.std() + 1e-6)) for i, x in plain.items()}
    assert selection.scored(chunks, asked.limit(0)).count() == 0
    rows = selection.scored(chunks, asked, selection.Settings(zscore=True))
    quotas = selection.cluster_quotas(rows)
    chosen = selection.select(rows, quotas)
    found = selection.diagnostics(chosen, quotas).collect()
    assert sum(r.picked for r in found) == chosen.count() and all(r.picked <= r.quota for r in found)


def test_compared_in_blocks_equals_the_table_of_pairs(spark):
    """Ties, null vectors, a zero vector, a cluster of one: all that is asked of the pairs, by the operators over their table."""
    rng = np.random.default_rng(11)
    made = [(i, 9 if i == 5 else int(i % 3), None if i == 6 else [0.0] * 4 if i == 7 else rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(400)]
    chunks = spark.createDataFrame(made, "chunk_id long, cluster_id int, embedding array<double>")
    asked = spark.createDataFrame([(q, rng.normal(size=4).round(1).tolist()) for q in (3, 1, 8)], "query_id long, query_vector array<double>")
    for how in ({"order": "blend"}, {"zscore": True}, {"gain_drop": -1.0, "min_gain": -9.0, "stop_negative": False, "max_n": 40, "floor_quantile": 0.2}, {"per_doc_max": 1}):
        s = selection.Settings(**how)
        rows = selection.scored(chunks, asked, s).withColumn("similarity", F.round("similarity", 9))
        found = selection.Compared(chunks, asked, s, digits=9)
        quotas = selection.cluster_quotas(rows, s)
        plain = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())
        assert plain(found.quotas()) == plain(quotas)
        assert plain(found.select()[0]) == plain(selection.select(rows, quotas, s)), how
        if s.max_n == 40 or s.per_doc_max:
            continue
        assert plain(found.floors()) == plain(selection.floors(rows, s)) == plain(found.floors(bins=1))
        best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "chunk_id")
        top = rows.withColumn("r", F.row_number().over(best)).where("r <= 30").select("query_id", "chunk_id", "cluster_id", "similarity", "r")
        assert plain(found.best(30)) == plain(top)
        assert plain(found.zscores().select("query_id", "chunk_id", F.round("z", 5))) == plain(selection.zscores(rows, "similarity", "query_id").select("query_id", "chunk_id", F.round("z", 5)))
    none = selection.Compared(chunks, asked.limit(0), digits=9)
    assert [x.count() for x in (none.best(3), none.floors(), none.zscores(), *none.select())] == [0] * 5


def test_picks_of_the_most_similar_are_sure_or_say_so():
    """Picks over the candidates above a bound are those of all candidates, wherever they do not say that they are unsure."""
    rng, said = np.random.default_rng(5), set()
    for i in range(80):
        v = rng.normal(size=(60, 6)) + (1 if i % 2 else 0.1)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        sim, cluster, quota = v @ v[0], rng.integers(0, 4, 60), {0: 9, 1: 3, 2: 8, 3: 0}
        s = selection.Settings(min_n=4, max_n=15, soft_quotas=i % 3 == 0, floor_quantile=0.7 if i % 4 else 0.97)
        below = float(np.quantile(sim, rng.random() * 0.9))
        at = np.flatnonzero(sim >= below)
        rest = selection.Rest({c: int((cluster == c).sum()) for c in range(4)}, below)
        want, got = selection.pick(v, sim, cluster, np.arange(60), quota, s), selection.pick(v[at], sim[at], cluster[at], np.arange(len(at)), quota, s, rest)
        said.add(got[1])
        if got[1] == "unsure":
            assert [at[j] for j, _ in got[0][:-1]] == [j for j, _ in want[0]][: len(got[0][:-1])]
        else:
            assert [at[j] for j, _ in got[0]] == [j for j, _ in want[0]] and got[1] == want[1]
    assert {"unsure", "max_n"} < said


def test_no_query_makes_a_table_of_pairs(spark, tmp_path):
    """Neither the plans nor the shuffles of queries that keep few rows hold each pair of a chunk and a query."""
    rng = np.random.default_rng(2)
    spark.createDataFrame([(i, rng.normal(size=8).tolist(), i % 3) for i in range(500)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("relevance_topk", "cluster_quota", "zscore_relevance", "sim_floor", "mmr_select", "blend_order", "cluster_picks"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_quotas_add_up(spark):
    rng = random.Random(2)
    rows = [(0, i, rng.choice([1, 2, 2, 2, 5]), rng.random()) for i in range(60)]
    found = selection.cluster_quotas(spark.createDataFrame(rows, "query_id long, chunk_id long, cluster_id int, similarity double")).collect()
    assert sum(r.quota for r in found) == 25 and all(r.quota <= r.size for r in found)


def test_edges_and_rank(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    relations = spark.createDataFrame([(1, 2, "Causal "), (2, 3, "mitigation"), (1, 3, "none"), (1, 9, "causal"), (3, 1, "odd"), (None, 1, "causal"), (1, 2, "causal")], "source_id long, target_id long, label string")
    made = graph.edges(relations, nodes)
    assert sorted((r.src, r.dst, r.w_in) for r in made.collect()) == [(1, 2, 1.0), (1, 2, 1.0), (2, 3, 0.6)]
    m = np.zeros((4, 4))
    m[0, 1], m[1, 2] = 1, 1
    r = np.full(4, 0.25)
    for _ in range(100):
        r = 0.85 * (r @ m + (r[2] + r[3]) / 4) + 0.15 / 4
    got = {x.id: x for x in graph.ratings(made, nodes).collect()}
    assert [got[i + 1].pagerank for i in range(4)] == pytest.approx((r / r.sum()).tolist(), abs=1e-5)
    assert got[1].outgoing_bonus == 1.0 and got[1].score == pytest.approx(0.7 * got[1].pagerank + 0.3)
    spread = {x.id: x.pagerank for x in graph.pagerank(made, nodes, few=0).collect()}
    assert spread == {i: pytest.approx(got[i].pagerank, abs=1e-5) for i in spread} and len(spread) == 4
    assert [r.id for r in graph.ratings(made, nodes).collect()] == sorted(got, key=lambda i: (-got[i].score, i))
    assert graph.pagerank(made, nodes.limit(0)).count() == 0


def test_pairs_in_blocks_by_brute_force(spark):
    """Several influences of an event, none, null ones, equal pairs, more events than blocks; the best ones without all pairs."""
    rng = np.random.default_rng(6)
    s = [(e, None if e == 3 else rng.integers(-2, 3, 3).astype(float).tolist()) for e in range(150)]
    f = [(int(e), None if n % 31 == 0 else rng.integers(-2, 3, 3).astype(float).tolist()) for n, e in enumerate(rng.integers(0, 170, 260))]

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a or [])) * math.sqrt(sum(x * x for x in b or []))
        return sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0.0

    want = {(i, j): max((cosine(a, b) for e, b in f if e == j), default=0.0) for i, a in s for j, _ in s if i != j}
    left, right = spark.createDataFrame(s, "event long, vector array<double>"), spark.createDataFrame(f, "event long, vector array<float>")
    got = {(r.i, r.j): r.similarity for r in graph.candidate_pairs(left, right, digits=9).collect()}
    assert got == {k: pytest.approx(x, abs=1e-9) for k, x in want.items()}
    top = [(r.i, r.j, r.similarity) for r in graph.best_pairs(left, right, 40, digits=9).collect()]
    assert top == sorted(((i, j, x) for (i, j), x in got.items()), key=lambda r: (-r[2], r[0], r[1]))[:40]
    assert graph.best_pairs(left.limit(0), right).count() == 0 and graph.best_pairs(left.limit(1), right).count() == 0


def test_pairs_have_no_bound_of_their_own(spark):
    """More events than the 20,000 that were an error before; one of each side has a length, so the best pair is known."""
    v = lambda n: F.when(F.col("id") == n, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.0)))
    left, right = (spark.range(20_001).select(F.col("id").alias("event"), v(n).alias("vector")) for n in (20_000, 7))
    assert [tuple(r) for r in graph.best_pairs(left, right, 2).collect()] == [(20_000, 7, 1.0), (0, 1, 0.0)]


def test_candidate_pairs_without_influence_are_zero(spark):
    s = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "event long, vector array<double>")
    i = spark.createDataFrame([(2, [1.0, 0.0]), (2, [0.0, 1.0])], "event long, vector array<double>")
    assert [(r.i, r.j, r.similarity) for r in graph.top_pairs(graph.candidate_pairs(s, i)).collect()] == [(1, 2, 1.0), (2, 1, 0.0)]
    with pytest.raises(ValueError):
        graph.candidate_pairs(s, i, most=1)
    assert graph.candidate_pairs(s.limit(0), i).count() == 0


def test_missing_ids_come_from_positions(spark):
    relations = spark.createDataFrame([(None, 7, 0, None)], "source_id long, target_id long, _source_idx int, _target_idx int")
    events = spark.createDataFrame([(0, 5), (1, 7)], "pos int, id long")
    assert graph.with_ids(relations, events).first().source_id == 5


def test_context_text(spark):
    kind = "id long, pos long, title string, summary string, description string, actors array<string>, locations array<string>, associated_numbers array<struct<value:string,explanation:string>>, influence array<string>"
    events = spark.createDataFrame([(1, 1, "", None, "d", ["a", "b"], None, [("3", "three"), (None, "x")], []), (2, 2, "T", "s", None, [], ["l"], None, ["i"])], kind)
    top = context.top_events(events, spark.createDataFrame([(2, 0.5)], "id long, score double"))
    relations = spark.createDataFrame([(1, 2, 1, "causal"), (2, 2, 1, None), (3, 1, 2, "none")], "pos int, source_id long, target_id long, label string")
    out = context.context(context.cards(top, context.relation_lists(relations, top))).first()[0]
    assert out.startswith("# Top Events Overview\n\nBelow are the top 2 events ranked by their influence score.\n\n## 1. [2] T\n**Score:** 0.5000\n**Description:** s\n")
    assert "**Relations (outgoing):** (2 -> 1: causal), (2 -> 1: none)\n" in out and "## 2. [1] Event 1\n" in out and "3 (three); None (x)" in out and not out.endswith("\n")


def test_evaluation(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "query string, answer string")
    assert [tuple(r) for r in evaluation.align(side((" b", "1"), ("a", "2")), side(("a ", "3"), ("b", "4"), ("c", "5"))).collect()] == [("a", "2", "3"), ("b", "1", "4")]
    with pytest.raises(Exception, match="repeated query"):
        evaluation.align(side(("a", "1"), ("a ", "2")), side(("a", "3"))).collect()
    w = lambda x: Row(Winner=x, Explanation="")
    rows = spark.createDataFrame([({"Diversity": w("Answer 1"), "Overall Winner": w(" Answer 2 ")},), ({"Diversity": w("both")},), ({"Diversity": w("Answer 2")},)], "evaluation map<string,struct<Winner:string,Explanation:string>>")
    got = {r.category: r for r in evaluation.tally(rows).collect()}
    assert (got["Diversity"].first, got["Diversity"].second, got["Diversity"].first_percent) == (1, 1, 50.0)
    assert got["Overall"].second_percent == 100.0 and got["Empowerment"].first_percent == 0.0
    scores = spark.createDataFrame([(1.5, "1"), (0.25, "0"), (None, "1"), (0.5, "x")], "p double, y string")
    found = evaluation.overall_brier(scores, "p", "y").first()
    assert found.n == 2 and found.overall_brier == pytest.approx(0.03125)


def test_models(spark):
    with pytest.raises(ValueError):
        models.Registry().embedder("none")
    with pytest.raises(KeyError):
        models.Registry().client("none")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.retry(flaky, sleep=lambda _: None) == "ok"
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "i int, t string")
    got = {r.i: r.v for r in models.embed_distinct(rows, "t", "v", models.hashing_embedder).collect()}
    assert got[1] == got[3] and len(got[1]) == 64 and got[2] is None
    tries = []

    def service(x):
        tries.append(x)
        if len(tries) == 1:
            raise OSError
        return [float(len(x)), 1.0]

    made = models.remote_embedder(service, 2, most=3, workers=1, sleep=lambda _: None)
    assert made(["abcdef", "", "x"]).tolist() == [[3.0, 1.0], [0.0, 0.0], [1.0, 1.0]] and tries == ["abc", "abc", "x"]
    told = models.ask(rows, "t", "answer", lambda: lambda m, p: m[0]["content"].upper(), failed="failed", tries=1)
    assert {r.i: r.answer for r in told.collect()} == {1: "A B", 2: "failed", 3: "A B"}
    chat = spark.createDataFrame([([("system", "s"), ("tool", "x"), ("assistant", "y")],)], "m array<struct<role:string,content:string>>")
    got = chat.select(models.chat_messages(F.col("m")).alias("c")).first().c
    assert got.system == "s" and [t.role for t in got.turns] == ["user", "assistant"]
    assert models.capital_entities("in New York with Ada") == ["New York", "Ada"]


def test_texts_are_few_at_a_time(spark, monkeypatch):
    """A worker turns parts of a batch into Python objects, never a whole batch: sentences, paragraphs, cleaning, keywords."""
    texts = pa.array(["One two. Three \u00e4\ufb01!\n\nFour" if n % 3 else None for n in range(1000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), texts], names=["doc_id", "text"])
    docs, made = spark.createDataFrame([(1, "x")], "doc_id long, text string"), []
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, kind: made.append(f) or own(self, f, kind))
    sentences.sentences(docs, "sentence"), sentences.paragraphs(docs)
    for f, (first, n) in zip(made, ((("One two.", 0), 3), ((0, 18), 3)), strict=True):
        parts = list(f(iter([batch])))
        assert max(map(len, parts)) <= blocks.TEXTS and sum(map(len, parts)) == 1000
        found = [x for p in parts for x in p.column(1).to_pylist()]
        assert found[0] == [] and tuple(found[1][0].values()) == first and len(found[1]) == n
    udfs = []
    monkeypatch.setattr(blocks.F, "arrow_udf", lambda kind: lambda f: udfs.append(f) or (lambda c: c))
    text.embed_clean(F.col("text")), keywords.text_keywords(F.col("text"), "yake")
    for f, want in zip(udfs, ("One two. Three a\u0308fi!\n\nFour", ["two", "three", "four"]), strict=True):
        parts = list(f(iter([texts])))
        found = [x for p in parts for x in p.to_pylist()]
        assert max(map(len, parts)) <= blocks.TEXTS and len(found) == 1000 and found[0] is None
        assert found[1] == want if isinstance(want, str) else set(found[1]) <= {*want, "one", "\u00e4\ufb01"}
