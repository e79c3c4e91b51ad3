"""Keywords of text windows: TF-IDF as relational steps, RAKE and YAKE per text, and the interleaving of lists."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.blocks import mapped, pieces
from eventloom.functions.stemming import STEMMERS, language_of
from eventloom.functions.text import split_list, stop_words

TOP, LIMIT = 30, 50


#: Terms of a document that count where chunks are inserted, the most frequent ones.
MOST_TERMS = 200_000


def tfidf(rows: DataFrame, keys: list[str], tokens: Column, corpus: list[str] | None = None, min_df: int = 2, top: int | None = TOP, stops: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """keys, term, weight (unit length per row set), rank: the strongest terms of each text.

    idf is ln((1 + n) / (1 + df)) + 1 over the texts that share the ``corpus`` columns (all texts if there are none).
    Term counts aggregate before they are shuffled; document frequencies join back by term, so a frequent term costs rows
    of counts, never a gathered list. ``stops`` are no terms; all terms in at least ``min_df`` texts count, or the ``most``
    frequent ones of them if that is given. Null and wordless texts have no terms, but count as texts.
    """
    corpus = corpus or []
    words = F.filter(tokens, lambda t: ~t.isin(*stops)) if stops else tokens
    one = rows.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    n = rows.groupBy(*corpus).agg(F.count("*").alias("n")) if corpus else rows.agg(F.count("*").alias("n"))
    df = one.groupBy(*corpus, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where(F.col("df") >= min_df)
    if most and corpus:
        place = F.row_number().over(Window.partitionBy(*corpus).orderBy(F.desc("all"), "term"))
        df = df.withColumn("place", place).where(F.col("place") <= most).drop("place")
    elif most:
        df = df.orderBy(F.desc("all"), "term").limit(most)
    df = df.drop("all")
    df = df.join(n, corpus) if corpus else df.crossJoin(F.broadcast(n))
    weighed = one.join(df, [*corpus, "term"]).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    whole = Window.partitionBy(*keys)
    weighed = weighed.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))
    ranked = weighed.withColumn("rank", F.row_number().over(whole.orderBy(F.round("weight", 9).desc(), "term")))
    return (ranked.where(F.col("rank") <= top) if top else ranked).select(*keys, "term", "weight", "rank")


def english_stops() -> tuple[str, ...]:
    """English stop words of the Spark distribution."""
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


_TOKEN = re.compile(r"\w+(?:-\w+)*")


def stems(text: Column, language: Callable[[str], str] = language_of) -> Column:
    """Array of the stems of a text's words: lower case, letters only, without the stop words of its language, in order.
    Words of one letter, which are no terms, are left out; null and wordless texts have none."""
    stops = {name: frozenset(StopWordsRemover.loadDefaultStopWords(name)) for name in STEMMERS}

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def of(x: str | None) -> list[str]:
            if not x:
                return []
            name = language(x)
            return [s for w in _TOKEN.findall(x.lower()) if w.isalpha() and w not in stops[name] and len(s := STEMMERS[name](w)) > 1]

        for batch in batches:
            yield batch.map(of)

    return run(text)


def with_entities(text: Column, words: Column, entities: Callable[[str], list[str]]) -> Column:
    """The text's entities, then the words, repeats left out, the first of equals kept."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: list(entities(x)) if x else [])

    return F.array_distinct(F.concat(run(text), words))


def keyword_text(entities: Column, keywords: Column, reverse: bool = True) -> Column:
    """Entities, then keywords (least important first, unless told otherwise), repeats left out, joined by ", "."""
    return F.array_join(F.array_distinct(F.concat(entities, F.reverse(keywords) if reverse else keywords)), ", ")


def interleave(rows: DataFrame, key: str, order: str, keywords: str, limit: int = LIMIT) -> DataFrame:
    """key, keywords: round robin over a key's lists in order, the first of equals without regard to case, ``limit`` at most.

    Each task first takes the first ``limit`` different words of the lists of a key that it holds, which are all that can be
    among those of the whole key; only these are shuffled.
    """
    own = rows.select(F.col(key).alias("__key"), F.col(order).alias("i"), F.col(keywords).alias("words"), F.transform(keywords, F.lower).alias("low"))
    types = dict(own.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            lists: dict = defaultdict(list)
            keys, there = batch.column("__key").to_pylist(), batch.column("words").is_valid().to_pylist()
            for n, (k, i) in enumerate(zip(keys, batch.column("i").to_pylist(), strict=True)):
                if there[n]:
                    lists[_hashable(k)].append((i, n))
            words, low = batch.column("words"), batch.column("low")
            at, out = [], []
            for held in lists.values():
                at.append(held[0][1])
                out.append(_first(sorted(held, key=lambda x: (x[0] is not None, x[0])), words, low, limit))
            kind = pa.list_(pa.struct([("k", pa.int32()), ("i", batch.column("i").type), ("word", pa.string()), ("low", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column("__key").take(pa.array(at, pa.int64())), pa.array(out, kind)], names=["__key", "f"])

    part = own.mapInArrow(run, f"__key {types['__key']}, f array<struct<k:int,i:{types['i']},word:string,low:string>>")
    flat = part.select("__key", F.explode("f").alias("x"))
    first = flat.groupBy("__key", F.col("x.low").alias("low")).agg(F.min(F.struct("x.k", "x.i", "x.word")).alias("f"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("__key").orderBy("f.k", "f.i", "low"))).where(F.col("n") <= limit)
    return ranked.groupBy(F.col("__key").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("f.word").alias("w")))), lambda x: x.w).alias("keywords"))


def _hashable(k: Any) -> Any:
    return tuple(map(_hashable, k.values())) if isinstance(k, dict) else tuple(map(_hashable, k)) if isinstance(k, list) else k


def _first(held: list[tuple[Any, int]], words: pa.Array, low: pa.Array, limit: int) -> list[dict]:
    """The first different words of lists (order, row), round by round."""
    found: dict = {}
    open_lists = [(i, words[n], low[n]) for i, n in held]
    k = 0
    while open_lists and len(found) < limit:
        open_lists = [x for x in open_lists if len(x[1]) > k]
        for i, w, small in open_lists:
            same = small[k].as_py()
            if same not in found:
                found[same] = {"k": k, "i": i, "word": w[k].as_py(), "low": same}
            elif found[same]["k"] == k and found[same]["i"] == i:  # rows of equal order: the lesser word, as among tasks
                found[same]["word"] = min(found[same]["word"], w[k].as_py())
        k += 1
    return sorted(found.values(), key=lambda x: (x["k"], x["i"] is not None, x["i"], x["low"] or ""))[:limit]


_WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def rake(text: str, top: int = 15, stops: frozenset = frozenset()) -> list[str]:
    """Phrases between stop words and punctuation, by the sum of their words' degree over frequency."""
    phrases = []
    for part in re.split(r"[^\w\s'-]+|\n", text.lower()):
        phrase: list[str] = []
        for word in [*_WORD.findall(part), None]:
            if word is None or word in stops:
                if phrase:
                    phrases.append(tuple(phrase))
                phrase = []
            else:
                phrase.append(word)
    frequency, degree = Counter(), Counter()
    for p in phrases:
        for w in p:
            frequency[w] += 1
            degree[w] += len(p)
    score = {p: sum(degree[w] / frequency[w] for w in p) for p in set(phrases)}
    return [" ".join(p) for p in sorted(score, key=lambda p: (-score[p], p))[:top]]


def yake(text: str, top: int = 15, stops: frozenset = frozenset()) -> list[str]:
    """Single words by the statistics of case, place, frequency, context and spread; the lowest score is best."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    count, upper, places, within = Counter(), Counter(), defaultdict(list), Counter()
    starts, ends, pairs = Counter(), Counter(), set()
    for i, sentence in enumerate(sentences):
        words = _WORD.findall(sentence)
        if not words:
            continue
        low = [w.lower() for w in words]
        count.update(low)
        upper.update([b for a, b in zip(words[1:], low[1:], strict=True) if a[0].isupper()])
        within.update(set(low))
        for w in low:
            places[w].append(i)
        starts[low[0]] += 1
        ends[low[-1]] += 1
        pairs.update(zip(low, low[1:]))  # noqa: B905  a word and the next one
    kept = [w for w in count if w not in stops and len(w) > 2 and not w.isdigit()]
    if not kept:
        return []
    left, right = Counter(b for _, b in pairs), Counter(a for a, _ in pairs)  # different neighbours
    values = [count[w] for w in kept]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    most = max(count.values())
    score = {}
    for w in kept:
        n = count[w]
        case = upper[w] / (1 + math.log(n))
        place = math.log(math.log(3 + places[w][n // 2]) + 1e-9)
        frequency = n / (mean + spread)
        sides = [left[w] / max(1, n - starts[w]), right[w] / max(1, n - ends[w])]
        relation = 1 + sum(sides) * n / most
        different = within[w] / len(sentences)
        score[w] = max(place, 1e-6) * relation / (case + frequency / relation + different / relation)
    return sorted(kept, key=lambda w: (score[w], w))[:top]


METHODS = ("none", "tfidf", "rake", "yake")


def text_keywords(text: Column, method: str, entities: Callable[[str], list[str]] | None = None, top: int = TOP) -> Column:
    """Array of keywords of each text on its own: none (the text split at commas), rake or yake."""
    if method not in METHODS or method == "tfidf":
        raise ValueError(f"unknown method for single texts: {method}")
    if method == "none":
        return split_list(text)
    find, stops = (rake if method == "rake" else yake), stop_words()

    def one(x: str) -> list[str]:
        return list(dict.fromkeys([*(entities(x) if entities else []), *find(x, top, stops)])) if x else []

    return F.coalesce(mapped(text, one, "array<string>", pa.list_(pa.string())), F.array().cast("array<string>"))
