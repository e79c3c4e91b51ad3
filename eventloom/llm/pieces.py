"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of a text has a node at every character bound and an edge for every vocabulary piece. The model at hand is
of the merge kind, whose encoding is not the best sum of piece scores but the result of greedy merges; its exact
encoding is a path all of whose neighbouring pieces are *compatible* (merging their joined text gives just these two).
So the pass scores a step 0 if the pieces are compatible and minus infinity if not: each bound then has one surviving
last piece and back pointer. The window holds the bounds that a later piece can still reach, the longest piece at most;
whenever the back pointers of all of them meet at one bound, the ids before it are committed and forgotten. A text that
fits into the window is followed back from its end, and only bounds that a path from there asks for are worked out.

No piece of the vocabulary continues past a word (a blank is written at the head of a word), which ``PieceCoder``
verifies; so all paths meet at the head of every word, as between any two characters that no piece holds side by side,
and stretches that come again are looked up. A text without such places is streamed through the window all the same. The ids equal those of the public library for the same file.

Only pieces and scores travel to the executors, not the file. Defined results: null and empty texts have no ids;
characters outside the vocabulary become byte pieces; decoding gives the text back, but U+2581, which the format itself
uses for the blank, comes back as a blank (``round_trip`` is then false); repeated rows are encoded alike; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Words kept for look-up in a worker, and the longest of them.
CACHE, LONGEST = 220_000, 64
#: Pairs of pieces, and beginnings of words with their last piece, that are kept, too.
PAIRS, BEGINNINGS = 300_000, 200_000


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # of the 256 byte pieces
    unknown: int
    special: set[int] = field(default_factory=set)

    @cached_property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.pieces, self.scores, self.byte_ids)).encode()).hexdigest()


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    return Vocabulary(pieces, [model.get_score(i) for i in range(n)], [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], model.unk_id(), special)


class PieceCoder:
    """Encodes and decodes one text at a time; keeps what it learned about words and pairs of pieces."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = vocabulary
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if i not in v.special}
        self.rank = {p: v.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece goes on past the head of a word")
        self.letters = {c for p in self.ids for c in p}
        # characters that no piece holds side by side: all paths meet between them
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.pair: dict[tuple[str, str], bool] = {}
        self.beginnings: dict[str, str] = {}
        # pieces that merging their own characters gives, and single characters that only longer pieces hold
        standing = {*(p for p in self.ids if self.merged(p) == [p]), *self.letters}
        self.ends = _ends(standing)
        self.bytes_of = _Bytes(self)
        self.after_blank, self.plain = _Words(self, BLANK), _Words(self, "")
        self.text_of = [BLANK if i in v.special else p for i, p in enumerate(v.pieces)]
        self.high = set()
        for b, i in enumerate(v.byte_ids):
            self.text_of[i] = chr(b)
            if b >= 128:
                self.high.add(i)
        for i in v.special - set(v.byte_ids):
            self.text_of[i] = ""

    def merged(self, text: str) -> list[str]:
        """Greedy merges of a short text: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        known = self.pair.get((a, b))
        if known is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            known = self.pair[a, b] = self.merged(a + b) == [a, b]
        return known

    def ending(self, text: str) -> tuple[str, ...]:
        """Pieces that the text ends with, the longest first; none if its last character is in no piece."""
        node = self.ends
        for c in reversed(text):
            further = node.get(c)
            if further is None:
                break
            node = further
        return node.get("", ())

    def last_piece(self, text: str) -> str:
        """The surviving last piece at the end of a text that fits into the window; it depends on nothing after it, so
        those of beginnings are kept."""
        known_last, letters, pair = self.beginnings, self.letters, self.pair
        for piece in self.ending(text):
            head = text[: -len(piece)]
            if not head:
                return piece
            before = known_last.get(head)
            if before is None:
                before = known_last[head] = self.last_piece(head)
            if before[-1] not in letters:
                return piece
            known = pair.get((before, piece))
            if self.compatible(before, piece) if known is None else known:
                return piece
        return text[-1]

    def word_bytes(self, text: str) -> bytes:
        """The ids of a text as bytes: back from its end if it fits into the window, streamed if not."""
        if len(text) > 2 * self.longest:
            return b"".join(map(self.bytes_of.__getitem__, self.stream(text)))
        known_last = self.beginnings
        if len(known_last) > BEGINNINGS:
            known_last.clear()
        out = b""
        while text:
            piece = known_last.get(text) if out else self.last_piece(text)
            if piece is None:
                piece = known_last[text] = self.last_piece(text)
            out = self.bytes_of[piece] + out
            text = text[: -len(piece)]
        return out

    def stream(self, text: str) -> Iterator[str]:
        """The pieces of a text of any length, committed as soon as all surviving paths agree on them."""
        base = 0  # the first bound in the window; everything before is committed
        last: list[str] = [""]  # the surviving last piece at each bound of the window
        letters, longest, compatible = self.letters, self.longest, self.compatible
        for i in range(1, len(text) + 1):
            chosen = text[i - 1]
            for piece in self.ending(text[max(base, i - longest) : i]):
                before = last[i - len(piece) - base]
                if not before or before[-1] not in letters or compatible(before, piece):
                    chosen = piece
                    break
            last.append(chosen)
            if len(last) > 2 * longest:
                # bounds that a later piece can begin at, each followed back until they meet
                alive = set(range(len(last) - longest, len(last)))
                while len(alive) > 1:
                    high = max(alive)
                    alive.remove(high)
                    alive.add(high - len(last[high]))
                meet = alive.pop()
                if meet > 0:
                    yield from self._back(last, meet)
                    # the piece that ends at the meeting bound still decides what may follow it
                    base, last = base + meet, last[meet:]
        yield from self._back(last, len(last) - 1)

    @staticmethod
    def _back(last: list[str], at: int) -> list[str]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        return [own] if own is not None else [self.v.byte_ids[b] for b in piece.encode("utf-8", "replace")]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of the text as 32-bit integers."""
        if not text:
            return b""
        out = []
        text = text.replace(BLANK, " ")  # the same sign to the format
        for number, line in enumerate(text.split("\n")):
            if number:
                out.append(self.newline)
            head, _, tail = line.partition(" ") if number else ("", "", line)
            if number and not line:
                continue
            if number and head:
                out.append(self.plain[head])
            if number and len(head) == len(line):
                continue
            if "  " in tail or tail[:1] == " " or tail[-1:] == " " or not tail:
                out += [self.plain[m] for m in re.findall(rf"{BLANK}+[^{BLANK}]*", BLANK + tail.replace(" ", BLANK))]
            else:
                out += map(self.after_blank.__getitem__, tail.split(" "))
        return b"".join(out)

    @property
    def newline(self) -> bytes:
        return array("i", self.piece_ids("\n")).tobytes()

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        if self.high and not self.high.isdisjoint(ids):
            out, held = [], bytearray()
            byte = {i: b for b, i in enumerate(self.v.byte_ids)}
            for i in ids:
                if i in byte:
                    held.append(byte[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(self.text_of[i])
            out.append(held.decode("utf-8", "replace"))
            text = "".join(out)
        else:
            text = "".join(map(self.text_of.__getitem__, ids))
        text = text.replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def _ends(pieces: set[str]) -> dict:
    """A tree of the pieces read from their last character back; "" holds the pieces met on the way, the longest first."""
    root: dict = {}
    for piece in sorted(pieces, key=len):
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = (piece,)
    waiting = [(root, ())]
    while waiting:
        node, met = waiting.pop()
        met = node.get("", ()) + met
        if met:
            node[""] = met
        waiting += [(further, met) for c, further in node.items() if c]
    return root


class _Bytes(dict):
    """Ids of pieces as bytes; byte pieces for characters outside the vocabulary."""

    def __init__(self, coder: PieceCoder) -> None:
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        own = array("i", self.coder.piece_ids(piece)).tobytes()
        if len(self) < CACHE:
            self[piece] = own
        return own


class _Words(dict):
    """Ids of words that came before, as bytes; when full, keeps one older generation to take words back from."""

    def __init__(self, coder: PieceCoder, head: str) -> None:
        super().__init__()
        self.coder, self.head = coder, head
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        coder = self.coder
        plain = word.isalpha()
        if not plain:
            core = word.rstrip(".,;:!?")
            if core and len(core) < len(word) and word[len(core) - 1 : len(core) + 1] not in coder.neighbours:
                return self[core] + coder.plain[word[len(core) :]]
        known = self.older.get(word)
        if known is not None:
            return self.keep(word, known)
        if not plain:
            cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in coder.neighbours]
            if cuts:
                found = self[word[: cuts[0]]] + b"".join([coder.plain[word[i:j]] for i, j in zip(cuts, [*cuts[1:], len(word)], strict=True)])
                return self.keep(word, found)
        return self.keep(word, coder.word_bytes(self.head + word))

    def keep(self, word: str, found: bytes) -> bytes:
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


#: The coder of this worker, kept from task to task; a second one would hold its memory until a full collection.
_coder: list[tuple[str, PieceCoder]] = []


def encode_documents(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, round_trip (whether decoding gives the text back) of every row."""
    vocabulary = load(model)
    vocabulary.digest  # worked out once, here
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        if not _coder or _coder[0][0] != v.digest:
            _coder[:] = [(v.digest, PieceCoder(v))]
        coder = _coder[0][1]
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [x.as_py() or "" for x in part.column(1)]
                held = [coder.encode_bytes(x) for x in texts]
                sizes = np.array([len(x) // 4 for x in held], dtype=np.int64)
                values = np.frombuffer(b"".join(held), dtype=np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                same = [coder.decode(np.frombuffer(b, dtype=np.int32).tolist()) == x for b, x in zip(held, texts, strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids, pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids", "round_trip"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_ids long, ids array<int>, round_trip boolean")
