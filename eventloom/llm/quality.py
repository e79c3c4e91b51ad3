"""Quality rules: a threshold table compiled into one projection.

Every measure is a Catalyst expression over the one text of a row, so the operator is a narrow stage: no shuffle,
no state between rows, and a lost task is simply run again.

Defined results: a null, empty or blank text has zero for every count and fails the base rule (fewer than 20 words).
Repeated rows are measured each on its own. Columns other than the text column pass through ``quality_measures``
untouched unless they have the name of a measure, which replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.sqltext import SPACE, fresh, let, space_words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

#: The commonest function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be at this by from not "
    "le la les de des et un une en est que qui dans pour sur pas au du "
    "der die das und den dem ein eine zu von mit ist auf für nicht sich des im auch "
    "el los las y en una por con para se del al lo su como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure and the closed range that a kept text has it in; None leaves that side open."""

    name: str
    value: str  # SQL over the measures
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are compared by multiplication, which is exact and has no division by zero.
RULES = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 18.0),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", None, 0.25),
    Rule("stop_word_share", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines / greatest(n_lines, 1)", None, 0.40),
    Rule("long_word_share", "n_long_words / greatest(n_words, 1)", None, 0.15),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur at least twice in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of their words. A text without repeats stops after one array_distinct;
    otherwise the windows are sorted with their positions, and the union of the repeated ones is summed in one pass.
    """
    n = F.size(words)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(placed: Column) -> Column:
        twin = lambda x, i: x.h.eqNullSafe(F.get(placed, i - 1).h) | x.h.eqNullSafe(F.get(placed, i + 1).h)
        starts = F.sort_array(F.transform(F.filter(placed, twin), lambda x: x.p))
        zero = F.struct(F.lit(-WINDOW).alias("prev"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("prev"), (acc.n + F.least(F.lit(WINDOW), p - acc.prev)).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc.n)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed, covered))

    return let(hashes, count)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_long_words")


def quality_measures(docs: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """docs with the measures that the rules compare, in two narrow projections.

    The words and lines are bound inside one expression, so that a filter on a measure, which Spark moves below the
    projection, splits the text once more, not once for each word.
    """
    raw, long = F.coalesce(F.col(text), F.lit("")), lambda c: c.cast("long")

    def measures(x: Column) -> Column:
        columns = {
            "n_words": long(F.size(x.words)),
            "word_chars": long(F.length(F.array_join(x.words, ""))),
            "n_symbols": long(F.regexp_count(raw, F.lit(SYMBOLS))),
            "n_dup_lines": long(F.size(x.lines) - F.size(F.array_distinct(x.lines))),
            "n_repeat_words": _repeat_words(x.words),
            "n_lines": long(F.size(x.lines)),
            # one lookup for each word; IN over literals is a hash set
            "n_stop_words": long(F.size(F.filter(x.words, lambda w: w.isin(*stop_words)))),
            "n_long_words": long(F.size(F.filter(x.words, lambda w: F.length(w) > 40))),
        }
        return F.struct(*[columns[k].alias(k) for k in MEASURES])

    parts = F.struct(space_words(F.col(text)).alias("words"), F.filter(F.split(raw, "\n", -1), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("lines"))
    held = fresh(docs, "measures")
    return docs.withColumn(held, let(parts, measures)).withColumns({k: F.col(held)[k] for k in MEASURES}).drop(held)


def compile_rules(rules=RULES) -> Column:
    """The table as one boolean expression."""
    bounds = [F.expr(f"({r.value}) {op} {v}D") for r in rules for op, v in ((">=", r.least), ("<=", r.most)) if v is not None]
    return reduce(lambda a, b: a & b, bounds, F.lit(True))


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """docs with every measure, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return quality_measures(docs, text).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
