"""Language identification: script ranges, per-word scores, Viterbi over words.

A word is a run of letters and combining marks with a letter in it. Its score under a language is the log-likelihood of its letter trigrams (word bounds
included), learned with add-one smoothing. The script of a word narrows the candidates to languages that were seen in
that script; a word in a script of no learned language says nothing. Viterbi over the words of a text, with a fixed
penalty for every change of language, labels spans of mixed text; the text's language is the one that labels most
letters, its score that share.

Learning is bounded: at most ``sample`` labelled rows (by hash of the id), whatever the corpus holds. Prediction is a
narrow stage over whole texts that sees nothing but the text.

Defined results: null, empty and letterless texts are ``und`` with score 0 and no spans; equal shares go to the first
language in alphabetical order; repeated rows are predicted each on its own; extra columns are ignored. Without a single
labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.codes import ALPHABET, SCRIPT_NAMES, codepoints, runs, tables, text_batches

SAMPLE = 6000
SWITCH = 12.0
UNKNOWN = "und"
#: A language has a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.02


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    scores: np.ndarray  # trigram x language, float32; the row of a trigram whose middle is no letter is zero
    scripts: np.ndarray  # script x language, bool
    switch: float = SWITCH


def _words(texts: list[str]):
    points = codepoints(texts)
    code, script, proper = tables()
    letters = code[points]
    letters[letters == 1] = 0
    starts, ends = runs(letters > 0)
    if len(starts):
        full = np.add.reduceat(proper[points].astype(np.int64), starts) > 0  # what lies between runs is no letter
        starts, ends = starts[full], ends[full]
    padded = np.concatenate([[0], letters, [0]]).astype(np.int64)
    grams = (padded[:-2] * ALPHABET + padded[1:-1]) * ALPHABET + padded[2:]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    return grams, script[points[starts]], starts, ends, bounds


def fit(rows: list[tuple[str, str]], switch: float = SWITCH) -> LanguageModel:
    """The model of (text, language) rows."""
    names = tuple(sorted({x for _, x in rows}))
    counts = np.zeros((ALPHABET**3, max(1, len(names))))
    scripts = np.zeros((len(SCRIPT_NAMES), max(1, len(names))))
    for j, name in enumerate(names):
        texts = [t for t, x in rows if x == name]
        for i in range(0, len(texts), 200):
            grams, script, starts, ends, _ = _words(texts[i : i + 200])
            counts[:, j] += np.bincount(grams, minlength=len(counts))
            scripts[:, j] += np.bincount(script, weights=ends - starts, minlength=len(scripts))
    middle = (np.arange(len(counts)) // ALPHABET) % ALPHABET > 0
    counts[~middle] = 0
    # smoothing backs off to the corpus-wide trigram share
    prior = counts.sum(1, keepdims=True) + 0.5
    prior /= prior[middle].sum()
    smooth = (counts + 20 * prior * middle[:, None]) / (counts.sum(0) + 20)
    scores = np.zeros_like(counts, dtype=np.float32)
    scores[middle] = np.log(np.maximum(smooth[middle], 1e-12))
    return LanguageModel(names, scores, scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0)), switch)


def word_scores(model: LanguageModel, grams: np.ndarray, script: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """word x language; languages outside the word's script are out of reach."""
    if not len(starts):
        return np.zeros((0, len(model.languages)), dtype=np.float32)
    scores = np.add.reduceat(model.scores[grams], starts, axis=0)
    allowed = model.scripts[script]
    scores[~allowed.any(1)] = 0
    return np.where(allowed | ~allowed.any(1)[:, None], scores, -1e6)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word; all texts take each step together, longest texts first."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = bounds[:-1][order], sizes[order]
    labels = np.zeros(len(scores), dtype=np.int8)
    if not len(scores):
        return labels
    back = np.zeros(scores.shape, dtype=np.int8)
    own = np.arange(scores.shape[1], dtype=np.int8)
    # texts still running at step t are a prefix of the order
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    value = scores[begin[: alive[0]]].astype(np.float64)
    last = np.zeros(len(sizes), dtype=np.int64)
    for t in range(1, len(alive)):
        n = alive[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        at = begin[:n] + t
        top = value.argmax(1)
        jump = value[np.arange(n), top][:, None] - switch
        stay = value >= jump
        back[at] = np.where(stay, own, top[:, None])
        value = np.where(stay, value, jump) + scores[at]
    last[: len(value)] = value.argmax(1)
    now = last
    for t in range(len(alive) - 1, -1, -1):
        at = begin[: alive[t]] + t
        labels[at] = now[: alive[t]]
        now[: alive[t]] = back[at, now[: alive[t]]]
    return labels


def label_texts(model: LanguageModel, texts: list[str]) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans); a span is (first code point, end, language) from its first word to its last."""
    grams, script, starts, ends, bounds = _words(texts)
    if not model.languages:
        yield from ((UNKNOWN, 0.0, []) for _ in texts)
        return
    labels = viterbi(word_scores(model, grams, script, starts), bounds, model.switch)
    letters = ends - starts
    offset = 0
    for text, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            yield UNKNOWN, 0.0, []
        else:
            own = labels[a:b]
            share = np.bincount(own, weights=letters[a:b], minlength=len(model.languages))
            best = int(share.argmax())
            cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]])
            spans = [(int(starts[a + i]) - offset, int(ends[a + j - 1]) - offset, model.languages[own[i]]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield model.languages[best], float(share[best] / share.sum()), spans
        offset += len(text) + 1


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, switch: float = SWITCH) -> LanguageModel:
    """The model of at most ``sample`` rows with a language, the least by hash of their id."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    ids = rows.select(F.col("doc_id").alias("l_id")).distinct().orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"), "left_semi")
    # ids may repeat; the order makes the bound take the same rows every time
    held = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "lang").limit(2 * sample).select("text", "lang").collect()
    return fit([(r[0], r[1]) for r in held], switch)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans (start, end, lang) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            got = [x for texts in text_batches(batch.column(1)) for x in label_texts(shared.value, texts)]
            spans = pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in g[2]] for g in got], span)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), spans], names=["doc_id", "lang_pred", "score", "spans"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
