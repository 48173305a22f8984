"""Encoding and decoding with a SentencePiece model of merge type, by a table of prefixes.

A merge model joins the neighbours with the best score, the leftmost of equals,
until none can be joined. What one span does depends on nothing outside it until
a join crosses its border, so tokens are a text's encoding exactly if each
encodes itself and each two neighbours, joined to one text, encode to those two.
Each prefix of a text therefore has one last token: of the pieces that end there
(an automaton finds them) the only one that fits the last token of the prefix
before it. The table of last tokens is filled from the left, in steps that do not
depend on ranks, and the ids are read off from its end backwards.

Where no piece goes on with ``SPACE`` after another character, as in models
trained on words, no join crosses a border of words; equal words then have equal
ids, and a task fills the table once for all (up to ``MEMO`` words, none longer
than ``MEMO_CHARS``). Characters that no piece holds are encoded as bytes.

Scale: texts are encoded where they lie, in Arrow batches; nothing is shuffled
and a task holds one text and the bounded memos. Time is linear in the text, also
for a text without any white space.

Null texts are empty and have no tokens: no ids, digests of the empty string.
Very long texts are encoded whole. Repeated rows each get their row; a null
doc_id stays null. An empty table gives no rows. Columns besides doc_id and the
text are ignored, so names cannot clash.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Words and pairs of pieces that a task remembers at most, and the longest word of them.
MEMO, MEMO_CHARS = 250_000, 64
#: Words whose ids are joined and digested together.
RUN_WORDS = 50_000
UNKNOWN = -1


class Model:
    """The pieces of a model whose normalisation is the identity with a blank in front."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        if own.normalize(" aÅ \n b ") != f"{SPACE * 2}aÅ{SPACE}\n{SPACE}b{SPACE}":
            raise ValueError(f"{path} normalises texts")
        pieces = [own.id_to_piece(i) for i in range(own.vocab_size())]
        plain = [i for i in range(len(pieces)) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if own.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError(f"{path} has no pieces for bytes")
        self.ids = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: own.get_score(i) for i in plain}
        self.pieces, self.width = pieces, [len(p) for p in pieces]
        self.by_words = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw |= {i: b"" if own.is_control(i) else " ⁇ ".encode() for i in range(len(pieces)) if own.is_control(i) or own.is_unknown(i)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.joined(p) == [p]:  # others never come out of the joins
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.shown = [str(i) for i in range(len(pieces))]
        self.words: dict[str, tuple[int, str, bytes]] = {}

    def joined(self, text: str) -> list[str]:
        """The definition, join by join: quadratic, for texts of a piece or two."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, a: int, b: int) -> bool:
        """Whether piece ``b`` can stand after piece ``a``."""
        if self.n_pairs >= MEMO:
            self.pairs, self.n_pairs = {}, 0
        self.n_pairs += 1
        pair = [self.pieces[a], self.pieces[b]]
        found = self.pairs.setdefault(a, {})[b] = self.joined(pair[0] + pair[1]) == pair
        return found

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix; ``UNKNOWN`` where a character is in no piece."""
        last, none = [UNKNOWN] * len(text), {}
        for end, (piece, width) in self.automaton.iter(text):
            if last[end] < 0:
                before = last[end - width] if end >= width else UNKNOWN
                if before < 0:
                    last[end] = piece
                else:
                    known = self.pairs.get(before, none).get(piece)
                    if known or (known is None and self.fits(before, piece)):
                        last[end] = piece
        return last

    def _span(self, text: str) -> list[int]:
        last, width, ids = self.last_tokens(text), self.width, []
        at = len(text) - 1
        while at >= 0:
            if last[at] == UNKNOWN:
                ids += [self.bytes[b] for b in reversed(text[at].encode())]
                at -= 1
            else:
                ids.append(last[at])
                at -= width[last[at]]
        return ids[::-1]

    def _spans(self, text: str) -> list[str]:
        """Spans of the normalised text that no join leaves."""
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}]*", whole) if self.by_words else [whole]

    def encode(self, text: str) -> list[int]:
        return [i for span in self._spans(text) for i in self._span(span)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids that :meth:`encode` gave: bytes back to characters, blanks for ``SPACE``, without the blank in front."""
        return b"".join(map(self.raw.__getitem__, ids)).removeprefix(b" ").decode()

    def _word(self, span: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids joined by commas, and the decoded bytes of a span."""
        ids = self._span(span)
        entry = len(ids), ",".join([self.shown[i] for i in ids]), b"".join([self.raw[i] for i in ids])
        if len(span) <= MEMO_CHARS:
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[span] = entry
        return entry

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, and of the decoded text."""
        spans, known, n = self._spans(text), self.words, 0
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        for start in range(0, len(spans), RUN_WORDS):
            run = [known.get(s) or self._word(s) for s in spans[start : start + RUN_WORDS]]
            n += sum([w[0] for w in run])
            ids.update((("," if start else "") + ",".join([w[1] for w in run])).encode())
            raw = b"".join([w[2] for w in run])
            decoded.update(raw if start else raw.removeprefix(b" "))
        return n, ids.hexdigest(), decoded.hexdigest()


@functools.cache
def model(path: str) -> Model:
    """Loaded once per worker."""
    return Model(path)


def _mapped(docs: DataFrame, text: str, path: str, columns: list[tuple[str, str, pa.DataType]], row) -> DataFrame:
    """doc_id and ``columns`` (name, type, Arrow type), whose values ``row(model, text)`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            gc.disable()  # nothing here forms cycles, and looking through the memo for some takes a third of the time
            made = [row(own, t.as_py() or "") for t in batch.column(1)]
            gc.enable()
            values = zip(*made, strict=True) if made else [[]] * len(columns)
            arrays = [pa.array(v, kind) for v, (_, _, kind) in zip(values, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(c for c, _, _ in columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t, _ in columns))


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    return _mapped(docs, text, path, [("ids", "array<int>", pa.list_(pa.int32()))], lambda own, t: (own.encode(t),))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are none."""
    return _mapped(rows, "ids", path, [("text", "string", pa.string())], lambda own, ids: (own.decode(ids or []),))


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    columns = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _mapped(docs, text, path, columns, lambda own, t: own.digests(t))
