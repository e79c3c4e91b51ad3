"""Toxicity: support vector machine on a gapped-subsequence string kernel with Nystrom landmarks.

A word (white-space separated, letters only, common look-alike digits and signs read as letters, runs of three or more
single letters joined) is its four-letter subsequences with at most two letters skipped, each skip weighing ``DECAY``;
word bounds count as letters. The kernel of two words is the inner product of these maps, divided by their lengths, so a
word's kernel with itself is 1, and ``idiiot``, ``i.d.i.o.t`` and ``i d i o t`` stay close to ``idiot``. The machine is
linear in the Nystrom features ``K(x, L) K(L, L)^-1/2`` of landmark words L.

It is trained on labelled sentences, as a machine of many instances: a harmless text has harmless words only, a toxic one
has at least one that is not. Which one is not known; it begins as the word whose texts are likeliest toxic, and after
each training it is the word that the machine finds worst (``ROUNDS`` times). An insult of several words is judged by the
worst of its words: subsequences do not cross a word.

Because the map is explicit, the trained machine folds into one weight for each subsequence: scoring a text is a table
look-up for each letter and gap pattern of its different words, and the text's score is that of its worst word, through a
fitted sigmoid.

Learning is bounded: at most ``sample`` labelled rows of either label, by hash of the id; the sigmoid is fitted on every
fourth of them, which the machine has not seen. Landmarks are the commonest of the words held for toxic, the commonest
harmless ones, and the harmless ones that the last machine found worst.

Defined results: null, empty and letterless texts get the score of no evidence; repeated rows are scored alike; extra
columns are ignored; if one of the labels has no row the machine is flat and every text scores below 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.codes import ALPHABET, codepoints, tables, text_batches
from eventloom.llm.shingles import mix

SAMPLE = 3000
DECAY = 0.75
#: Steps between the four letters, at most two letters skipped in all.
PATTERNS = tuple((a, b, c) for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3) if a + b + c <= 5)
SUBSEQUENCES = ALPHABET**4
LANDMARKS = 320
HARMLESS = 20_000
#: Times that the machine is trained again on its worst mistakes.
ROUNDS = 4
NO_WORD = -3.0
BOUND = 1
#: Signs that stand for letters.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _lookalike_codes() -> np.ndarray:
    code = tables()[0].copy()
    for sign, letter in LOOK_ALIKES.items():
        code[ord(sign)] = code[ord(letter)]
    return code


_codes: list[np.ndarray] = []


def squeeze(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of the texts with BOUND between words, and the word number at which each text begins.

    Look-alikes become letters only beside a letter, so numbers and rows of signs stay out.
    """
    if not _codes:
        _codes.extend((tables()[0], _lookalike_codes()))
    points = codepoints(texts)
    plain, alike = _codes[0][points], _codes[1][points]
    letter = plain > BOUND
    near = np.zeros_like(letter)
    near[1:] |= letter[:-1]
    near[:-1] &= letter[1:]
    code = np.where(letter | near, alike, np.where(plain == BOUND, BOUND, 0)).astype(np.int64)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kept = np.flatnonzero(code)
    code = code[kept]
    ends = np.searchsorted(kept, text_ends)  # where each text's own newline is kept
    bound = code == BOUND
    # no bound between letters that stand alone three or more times in a row
    first = np.concatenate([[True], bound[:-1]])
    alone = ~bound & first & np.concatenate([bound[1:], [True]])
    at = np.flatnonzero(alone)
    if len(at) > 2:
        linked = np.flatnonzero(np.diff(at) == 2)
        run = np.zeros(len(at) + 1, dtype=np.int64)
        step = np.zeros(len(at), dtype=bool)
        step[linked] = True
        group = np.cumsum(np.concatenate([[1], ~step[:-1]]))
        run = np.bincount(group)
        long = run[group] >= 3
        inner = at[:-1][step[:-1] & long[:-1]] + 1
        inner = np.setdiff1d(inner, ends)
        keep = np.ones(len(code), dtype=bool)
        keep[inner] = False
        ends = ends - np.searchsorted(inner, ends)
        code = code[keep]
    # one bound for a run of them, one before the first word
    bound = code == BOUND
    extra = bound & np.concatenate([[True], bound[:-1]])
    word_of = np.cumsum(bound & ~extra)
    begins = np.concatenate([[0], word_of[ends]])
    return np.concatenate([[BOUND], code[~extra]]), begins


def _occurrences(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: subsequence numbers, where they start, their weight. Only the ends may be bounds."""
    inside = np.cumsum(code == BOUND)
    low = code.astype(np.uint32)
    for a, b, c in PATTERNS:
        span = a + b + c
        n = len(code) - span
        if n > 0:
            # bounds strictly between the ends rule an occurrence out
            at = np.flatnonzero(inside[span - 1 : span - 1 + n] == inside[:n])
            key = ((low[at] * np.uint32(ALPHABET) + low[at + a]) * np.uint32(ALPHABET) + low[at + a + b]) * np.uint32(ALPHABET) + low[at + span]
            yield key, at, DECAY ** (span - 3)


def _word_numbers(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of each position (a leading bound belongs to the word after it) and the length of each word's map."""
    number = np.cumsum(code == BOUND) - 1
    words = int(number[-1]) + 1 if len(number) else 0
    keys, weights = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for key, at, weight in _occurrences(code):
        keys.append(number[at] * SUBSEQUENCES + key)
        weights.append(np.full(len(at), weight))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    # a subsequence that a word has several times counts by its summed weight
    sums = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0)
    squares = np.bincount(keys[first] // SUBSEQUENCES, weights=sums * sums, minlength=words)
    return number, np.sqrt(np.maximum(squares, 1e-9))


_SPREAD, _SPREAD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _different(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each different word once, with a bound at the end, and for every word its place among them."""
    bounds = np.flatnonzero(code == BOUND)
    starts, ends = bounds[:-1], bounds[1:]
    if not len(starts):
        return code, np.zeros(0, dtype=np.int64)
    steps = np.ones((2, len(code) + 1), dtype=np.uint64)
    steps[0, 1:], steps[1, 1:] = _SPREAD, _SPREAD_INVERSE
    power, back = np.cumprod(steps, axis=1, dtype=np.uint64)
    sums = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * back[starts] + mix((ends - starts).astype(np.uint64))
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    at = np.repeat(starts[first] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return np.concatenate([code[at], [BOUND]]), place


def word_margins(code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The machine's value of every word, without its bias; the code ends with a bound, whose own empty word has 0."""
    own, place = _different(code)
    number, norm = _word_numbers(own)
    total = np.zeros(len(own))
    for key, at, weight in _occurrences(own):
        total[at] += weight * weights[key]
    margins = np.bincount(number, weights=total, minlength=len(norm))[: len(norm)] / norm
    return np.append(margins[:-1][place], 0.0)


@dataclass
class ToxicityModel:
    keys: np.ndarray  # subsequences that weigh anything
    values: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: tuple[str, ...] = ()

    @cached_property
    def weights(self) -> np.ndarray:
        """One value for every subsequence; a worker spreads it out once, only keys and values travel."""
        dense = np.zeros(SUBSEQUENCES, dtype=np.float32)
        dense[self.keys] = self.values
        return dense

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "weights"}


FLAT = ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), NO_WORD, 1.0, 0.0)


def _encode(words: list[str]) -> np.ndarray:
    code = _codes[0] if _codes else tables()[0]
    return np.concatenate([np.concatenate([[BOUND], code[np.minimum([ord(c) for c in w], 0x3FFFF)]]) for w in words] + [[BOUND]]).astype(np.int64)


@dataclass
class Landmarks:
    """The normalised maps of landmark words, as rows of the subsequences that any of them has."""

    words: list[str]

    def __post_init__(self) -> None:
        code = _encode(self.words)
        number, norm = _word_numbers(code)
        found = [(key, number[at], weight) for key, at, weight in _occurrences(code)]
        self.keys = np.unique(np.concatenate([x[0] for x in found]))
        self.table = np.zeros((len(self.keys), len(self.words)), dtype=np.float32)
        for key, own, weight in found:
            np.add.at(self.table, (np.searchsorted(self.keys, key), own), weight)
        self.table /= norm[: len(self.words)].astype(np.float32)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel values of words (rows) with the landmarks (columns)."""
        out = []
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            code = _encode(part)
            number, norm = _word_numbers(code)
            rows = np.zeros((len(part), len(self.words)), dtype=np.float32)
            for key, at, weight in _occurrences(code):
                row = np.searchsorted(self.keys, key)
                row[row == len(self.keys)] = 0
                hit = np.flatnonzero((self.keys[row] == key) & (number[at] < len(part)))
                if len(hit):
                    own = number[at[hit]]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    rows[own[first]] += weight * np.add.reduceat(self.table[row[hit]], first, axis=0)
            out.append(rows / norm[: len(part), None])
        return np.concatenate(out)

    def machine(self, bad: list[str], good: list[str], evidence: np.ndarray, frequency: np.ndarray) -> ToxicityModel:
        """The machine that tells bad from good words, without its sigmoid."""
        k = self.kernel(self.words).astype(np.float64)
        value, vector = np.linalg.eigh((k + k.T) / 2)
        kept = value > 1e-5 * value.max()
        root = (vector[:, kept] / np.sqrt(value[kept])).astype(np.float32)
        x = np.empty((len(bad) + len(good), root.shape[1] + 1), dtype=np.float32)
        x[:, -1] = 1
        for first, words in ((0, bad), (len(bad), good)):
            for i in range(0, len(words), 2000):
                part = self.kernel(words[i : i + 2000])
                x[first + i : first + i + len(part), :-1] = part @ root
        y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
        weight = np.concatenate([0.5 * frequency.sum() * evidence / evidence.sum(), frequency])
        w = _svm(x, y, weight / weight.mean())
        return ToxicityModel(self.keys.astype(np.int64), self.table @ (root @ w[:-1]), float(w[-1]), 1.0, 0.0, tuple(self.words))


def _svm(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray, cost: float = 2.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps with halving; the last column of x is one, the last value the bias."""
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(v: np.ndarray) -> float:
        return 0.5 * (ridge * v * v).sum() + 0.5 * cost * (sample_weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()

    now = loss(w)
    for _ in range(60):
        bad = 1 - y * (x @ w) > 0
        matrix, target = np.diag(ridge), np.zeros(len(w))
        for i in range(0, len(x), 4096):
            at = np.flatnonzero(bad[i : i + 4096]) + i
            xb, c = x[at].astype(np.float64), cost * sample_weight[at]
            matrix = matrix + xb.T @ (xb * c[:, None])
            target += xb.T @ (c * y[at])
        step = np.linalg.solve(matrix, target) - w
        rate = 1.0
        while (new := loss(w + rate * step)) > now and rate > 1e-4:
            rate /= 2
        if new >= now - 1e-6 * abs(now):
            break
        w, now = w + rate * step, new
    return w


def _word_strings(texts: Iterator[str]) -> Iterator[list[str]]:
    """Squeezed words of each text as lower-case strings, look-alikes resolved."""
    alike = str.maketrans(LOOK_ALIKES)
    for t in texts:
        words = []
        for w in t.lower().split():
            w = "".join(c for c in (w if w.isalpha() else w.strip("0123456789!$@").translate(alike)) if c.isalpha())
            if w:
                words.append(w)
        yield words


#: Letters of the longest words that the machine learns from; scoring takes words of any length.
LONGEST = 60


def _margins_of(model: ToxicityModel, words: list[str], size: int = 5_000) -> np.ndarray:
    return np.concatenate([word_margins(_encode(words[i : i + size]), model.weights)[:-1] for i in range(0, len(words), size)] or [np.zeros(0)]) + model.bias


def fit(rows: list[tuple[str, int]], totals: dict[int, int] | None = None) -> ToxicityModel:
    """The machine of (text, toxic) rows; totals are the labels' numbers in what the rows were sampled from."""
    totals = totals or {x: sum(label == x for _, label in rows) for x in (0, 1)}
    rows, rest = [x for i, x in enumerate(rows) if i % 4], rows[::4]
    if len({x for _, x in rows}) < 2:
        return FLAT
    number = {0: 0, 1: 0}
    toxic, harmless, bags = Counter(), Counter(), []
    for words, (_, label) in zip(_word_strings(t for t, _ in rows), rows, strict=True):
        number[label] += 1
        own = sorted({w for w in words if len(w) <= LONGEST})
        (toxic if label else harmless).update(own)
        if label:
            bags.append([w for w in own if len(w) > 2])
    bags = [b for b in bags if b]
    if not bags:
        return FLAT
    # before there is a machine: the log-odds that a text with the word is toxic
    value = {w: np.log((toxic[w] + 0.5) / (number[1] + 1)) - np.log((harmless.get(w, 0) + 0.5) / (number[0] + 1)) for w in toxic}
    words = sorted(toxic)
    common = sorted(harmless, key=lambda w: (-harmless[w], w))
    quarter = LANDMARKS // 4
    hard, good = [], common[: HARMLESS // 2]
    spread = np.sqrt(np.array([harmless[w] for w in common], dtype=np.float64))
    for last in (False,) * ROUNDS + (True,):
        # the word that makes each toxic text toxic, as far as is known
        worst_of = Counter(max(b, key=lambda w: (value[w], w)) for b in bags)
        bad = sorted(worst_of, key=lambda w: (-worst_of[w], w))
        landmarks = list(dict.fromkeys(bad[:quarter] + common[:quarter] + hard))
        # a word in many texts weighs more, but not so much that rare words stop to count
        evidence = np.sqrt(np.array([worst_of[w] for w in bad], dtype=np.float64))
        frequency = np.sqrt(np.array([harmless[w] for w in good], dtype=np.float64))
        model = Landmarks(landmarks).machine(bad, good, evidence, frequency)
        if last:
            break
        value = dict(zip(words, _margins_of(model, words).tolist(), strict=True))
        # the harmless words that this machine finds worst become examples and landmarks of the next one
        margin = _margins_of(model, common)
        good = list(dict.fromkeys(good + [common[i] for i in np.argsort(-margin, kind="stable")[: HARMLESS // 2 // ROUNDS]]))
        harm = np.maximum(0, margin + 0.5) * spread
        hard = list(dict.fromkeys(hard + [common[i] for i in np.argsort(-harm, kind="stable")[: 2 * quarter // ROUNDS]]))
    rest = rest if {x for _, x in rest} == {0, 1} else rows
    margin = np.concatenate([text_margins(model, [t for t, _ in rest[i : i + 200]]) for i in range(0, len(rest), 200)])
    slope, offset = _sigmoid(margin, np.array([x for _, x in rest]), totals)
    return replace(model, slope=slope, offset=offset)


def _sigmoid(margin: np.ndarray, label: np.ndarray, totals: dict[int, int]) -> tuple[float, float]:
    """Regularised logistic fit of the label on the margin; labels weigh by their totals, not by their share of the sample."""
    target = np.where(label == 1, 0.99, 0.01)
    each = {x: totals[x] / max(1, (label == x).sum()) for x in (0, 1)}
    weight = np.where(label == 1, each[1], each[0])
    weight = weight / weight.mean()
    x, w = np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-2 * w
        w = w - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def text_margins(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    """The value of each text's worst word; NO_WORD for texts without words."""
    code, begins = squeeze(texts)
    margins = np.append(word_margins(code, model.weights) + model.bias, NO_WORD)
    out = np.full(len(texts), NO_WORD)
    full = np.flatnonzero(begins[1:] > begins[:-1])
    if len(full):
        cuts = np.stack([begins[:-1][full], begins[1:][full]], 1).ravel()
        out[full] = np.maximum.reduceat(margins, cuts)[::2]
    return np.maximum(out, NO_WORD)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """The machine of at most ``sample`` labelled rows of either label, the least by hash of their id."""
    held = []
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    known = labels.select(F.col(doc_id).alias("l_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    for value in (0, 1):
        ids = known.where(F.col("label") == value).select("l_id").distinct().orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
        rows = own.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"), "left_semi")
        # ids may repeat; the order makes the bound take the same rows every time
        held += [(r[0], value) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(2 * sample).select("text").collect()]
    return fit(held, {x: counts.get(x, 0) for x in (0, 1)})


def _probabilities(model: ToxicityModel, column: pa.Array) -> np.ndarray:
    margins = [text_margins(model, texts) for texts in text_batches(column)]
    return 1 / (1 + np.exp(-np.clip(model.slope * np.concatenate(margins or [np.zeros(0)]) + model.offset, -30, 30)))


def probability(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The score of each row's text as a column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(_probabilities(shared.value, column))

    return run(F.col(text))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, score double, predicted int")
