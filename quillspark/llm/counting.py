"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists the pieces that end at each character; dynamic
programming carries the best score and the number of pieces of the best segmentation.  Ties are the
tokenizers library's: of equal scores the segmentation found first stays, and candidates for an end
come by rising start; a character that no one-character piece covers costs the lowest score less 10
and counts as its UTF-8 bytes (byte fallback), with neighbouring ones fused, which changes no count.

Spaces become U+2581 and one is put before the text.  Where no piece has that mark after another
character, a text falls into independent parts before each run of marks; equal parts are counted
once a block.  Scores are whole numbers here (minus the rank), so their sums are exact.

Defined results: null or empty text counts 0; rows count each for itself; long texts are counted
whole; other columns are never read.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, with_columns

MARK = "▁"
UNKNOWN_COST = 10.0
REMEMBERED = 300_000
LONG_PART = 64


def vocabulary(name: str) -> list[tuple[str, float]]:
    """(piece, score) by id from a sentencepiece file; control, unknown and byte pieces take part as plain entries."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokens.resolve(name))
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    def __init__(self, vocab: list[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), float(score)))
        self.auto.make_automaton()
        self.single = {p for p, _ in vocab if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_COST
        self.bytes = {b for b in range(256) if f"<0x{b:02X}>" in {p for p, _ in vocab}}
        self.parts = not any(MARK in p.lstrip(MARK) for p, _ in vocab)
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Number of pieces of the best segmentation."""
        n = len(text)
        best = [None] * (n + 1)
        pieces = [0] * (n + 1)
        unknown = [False] * (n + 1)
        best[0] = 0.0
        at, single, cost = 0, self.single, self.unknown

        def close(end):  # candidates of an end come by rising start, a lone character's last
            if text[end - 1] not in single:
                x = best[end - 1] + cost
                if best[end] is None or x > best[end]:
                    best[end], pieces[end], unknown[end] = x, pieces[end - 1] + self._fallback(text, end, unknown[end - 1]), True

        for last, (length, score) in self.auto.iter(text):
            end = last + 1
            while at + 1 < end:
                at += 1
                close(at)
            x = best[end - length] + score
            if best[end] is None or x > best[end]:
                best[end], pieces[end], unknown[end] = x, pieces[end - length] + 1, False
        while at < n:
            at += 1
            close(at)
        return pieces[n]

    def _fallback(self, text: str, end: int, after_unknown: bool) -> int:
        raw = text[end - 1].encode("utf-8", "surrogatepass")
        if all(b in self.bytes for b in raw):
            return len(raw)
        return 0 if after_unknown else 1  # unknown characters in a row are one piece

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.parts:
            return self.viterbi(text)
        known, total = self.known, 0
        for part in _PARTS(text):
            n = known.get(part)
            if n is None:
                n = self.viterbi(part)
                if len(part) <= LONG_PART:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = n
            total += n
        return total


_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall


@functools.lru_cache(2)
def load(name: str) -> Counter:
    return Counter(vocabulary(name))


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pieces_name: str = tokens.PIECES) -> DataFrame:
    """doc_id, n_tokens: one row for each row of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        count = load(pieces_name).count
        for rows, _, _ in slices(batches, "text"):
            yield with_columns(rows, ["doc_id"], n_tokens=pa.array([count(t) if t else 0 for t in rows.column(1).to_pylist()], pa.int64()))

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long").withColumnRenamed("doc_id", doc_id)
