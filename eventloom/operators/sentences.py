"""Sentences, paragraphs and context windows of documents.

Offsets are code points of the text with \\r\\n and \\r turned into \\n.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.blocks import TEXTS, pieces

#: What ends a sentence, and what may follow it.
ENDS = ".!?…"
CLOSERS = "\"'»«‚‘’“”)]"
#: Abbreviations; a piece of under eight characters that ends with one is dropped.
ABBREVIATIONS = (
    "z. b.|z.b.|bzw.|bspw.|vgl.|ca.|usw.|u. a.|u.a.|dr.|prof.|dipl.|etc.|mr.|mrs.|ms.|miss.|sr.|jr.|rev.|hon.|fr.|st.|"
    "e.g.|eg.|i.e.|ie.|vs.|cf.|jan.|feb.|mar.|apr.|jun.|jul.|aug.|sep.|sept.|oct.|nov.|dec.|in.|ft.|yd.|mi.|oz.|lb.|pt.|"
    "qt.|gal.|mm.|cm.|m.|km.|mg.|g.|kg.|ml.|l.|a.m.|am.|p.m.|pm.|no.|nos.|vol.|vols.|pp.|chap.|ch.|ed.|eds.|al.|fig.|"
    "figs.|dept.|est.|gov.|inc.|ltd.|co.|corp.|univ.|col.|mt.|mts.|ave.|blvd.|rd.|hwy.|apt.|bldg.|misc.|min.|sec."
).split("|")
SHORT = 8
_ABBREVIATED = re.compile("(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + ")$")

_E, _C = re.escape(ENDS), re.escape(CLOSERS)
#: mode line: a piece is a quote-ended sentence or the rest of its line; mode sentence: closers are optional.
_MODES = {
    "line": re.compile(rf"[^{_E}\n]+[{_E}][{re.escape(CLOSERS[:-1])}]\]*|[^{_E}\n][^\n]*"),
    "sentence": re.compile(rf"[^{_E}\n]+[{_E}]+[{_C}]*|[^{_E}\n][^\n]*"),
}
_MARKED = re.compile(r"\n{2,}|^[ \t]*#{1,6}\s+[^\n]*$|^[ \t]*(?:[-*+]\s+|\d+\.\s+)|^[ \t]*[-*_]{3,}[ \t]*$|<\s*(?:p|div|section|article|h[1-6]|ul|ol|li|br)\b[^>]*>", re.I | re.M)
_MARKED_IN_LINE = re.compile(r"\n{2,}|^\s*|^(?:[-*+]\s+|\d+\.\s+)|^[-*_]{3,}\s*$|<\s*(?:p|div|section|article|h[1-6]|ul|ol|li|br)\b[^>]*>", re.I | re.M)


def newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_sentences(text: str, mode: str = "line") -> list[tuple[str, int]]:
    """(sentence, start) in order, trimmed; abbreviation fragments left out."""
    out = []
    for m in _MODES[mode].finditer(re.sub("\r\n?", "\n", text)):
        piece = m[0].strip()
        if piece and not (len(piece) < SHORT and _ABBREVIATED.search(piece.lower())):
            out.append((piece, m.start() + len(m[0]) - len(m[0].lstrip())))
    return out


def paragraph_spans(text: str, mode: str = "line") -> list[tuple[int, int]]:
    """Spans between the bounds of paragraphs; the delimiters are spans of their own."""
    text = re.sub("\r\n?", "\n", text)
    cuts = {0, len(text)}
    for m in (_MARKED_IN_LINE if mode == "line" else _MARKED).finditer(text):
        cuts |= set(m.span())
    ordered = sorted(cuts)
    return [(a, b) for a, b in zip(ordered[:-1], ordered[1:], strict=True) if b > a]


def _lists(found: list[list], columns: list[pa.Array], names: list[str]) -> pa.Array:
    """The columns of all that was found as a list for each text."""
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))


def sentences(docs: DataFrame, mode: str = "line", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, idx, start, sentence. Null and empty texts give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, TEXTS):
            found = [split_sentences(x.as_py() or "", mode) for x in part.column(1)]
            pair = [pa.array([x[n] for of in found for x in of], kind) for n, kind in enumerate((pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, pair, ["sentence", "start"])], names=["doc_id", "found"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, found array<struct<sentence:string,start:int>>")
    return found.select("doc_id", F.posexplode("found").alias("idx", "s")).select("doc_id", "idx", "s.start", "s.sentence")


def paragraphs(docs: DataFrame, mode: str = "line", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, p_idx, p_start, p_end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, TEXTS):
            found = [paragraph_spans(x.as_py() or "", mode) for x in part.column(1)]
            pair = [pa.array([x[n] for of in found for x in of], pa.int32()) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found, pair, ["p_start", "p_end"])], names=["doc_id", "found"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, found array<struct<p_start:int,p_end:int>>")
    return found.select("doc_id", F.posexplode("found").alias("p_idx", "p")).select("doc_id", "p_idx", "p.p_start", "p.p_end")


def context_windows(rows: DataFrame, reach: int = 2) -> DataFrame:
    """rows (doc_id, idx, sentence) with ``combined``: each sentence with its neighbours, joined by a blank."""
    near = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-reach, reach)
    return rows.withColumn("combined", F.array_join(F.collect_list("sentence").over(near), " "))
