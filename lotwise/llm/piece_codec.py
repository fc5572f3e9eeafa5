"""SentencePiece encoding and decoding: one pass of an Aho-Corasick automaton over the pieces relaxes best scores.

Text form: one space is put before the text, spaces become the mark U+2581, nothing else is normalised. A mark
that stands in the text itself goes through byte pieces, so decoding gives back every text exactly. Characters
at which no piece ends become the byte pieces of their UTF-8 form.

The best split has the largest sum of piece scores less a very small cost for each piece; of equal sums the one whose
last piece is longest wins, and so on from the right.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.common import WordCache, id_and_text, share

MARK = "▁"
LEAST_SCORE = -50_000.0  # pieces that the file gives a placeholder score below this count as this
BYTE_SCORE = -100_000.0  # of one byte piece
PIECE_COST = 2.0**-16  # beside its score, so that of equal sums the one with fewer pieces wins


@dataclass
class Vocabulary:
    """Pieces with scores, and the 256 byte pieces."""

    pieces: dict[str, tuple[int, float]]
    bytes_first: int
    size: int

    @classmethod
    def load(cls, model_path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        first = model.piece_to_id("<0x00>")
        pieces = {
            model.id_to_piece(i): (i, model.get_score(i))
            for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        }
        return cls(pieces, first, n)

    def breaks_at_marks(self) -> bool:
        """No piece holds a mark after another character, so words before and after a mark never share a piece."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)


MAX_MOVES = 500_000  # moves over failure links that are remembered, some 50 MB


class Automaton:
    """Trie of the pieces with failure links; per state the pieces that end there, along the output links."""

    def __init__(self, vocabulary: Vocabulary):
        self.next: list[dict[str, int]] = [{}]
        self.piece: list[tuple[int, int, float] | None] = [None]  # (length, id, score) of the piece a state spells
        for text, (i, score) in vocabulary.pieces.items():
            state = 0
            for c in text:
                state = self.next[state].setdefault(c, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    self.piece.append(None)
            self.piece[state] = (len(text), i, max(score, LEAST_SCORE) - PIECE_COST)
        self.fail = [0] * len(self.next)
        self.output = [0] * len(self.next)  # nearest state on the failure path that spells a piece
        queue = list(self.next[0].values())
        for state in queue:
            for c, child in self.next[state].items():
                queue.append(child)
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                to = self.next[back].get(c, 0)
                self.fail[child] = to
                self.output[child] = to if self.piece[to] else self.output[to]
        self.ending: dict[int, list] = {0: []}  # filled as states are met
        self.moves: list[dict[str, int]] = [dict(d) for d in self.next]  # with moves over failure links as met
        self.met = 0

    def follow(self, state: int, c: str) -> int:
        back = state
        while back and c not in self.next[back]:
            back = self.fail[back]
        to = self.moves[state][c] = self.next[back].get(c, 0)
        self.met += 1
        return to

    def pieces_at(self, state: int) -> list[tuple[int, int, float]]:
        """Pieces that end in a state, longest first."""
        found, out = [], state if self.piece[state] else self.output[state]
        while out:
            found.append(self.piece[out])
            out = self.output[out]
        self.ending[state] = found
        return found

    def best(self, text: str, bytes_first: int) -> list[int]:
        """Piece ids of the best split of `text`, in which marks are already in place."""
        if self.met > MAX_MOVES:
            self.moves, self.met = [dict(d) for d in self.next], 0
        moves, ending = self.moves, self.ending
        score, came, state, end = [0.0], [None], 0, 0
        for c in text:
            end += 1
            try:
                state = moves[state][c]
            except KeyError:
                state = self.follow(state, c)
            found = ending.get(state)
            if found is None:
                found = self.pieces_at(state)
            top, by = -math.inf, None
            for piece in found:
                s = score[end - piece[0]] + piece[2]
                if s > top:
                    top, by = s, piece
            if by is None:  # no piece ends here
                top = score[-1] + (BYTE_SCORE - PIECE_COST) * len(c.encode("utf-8", "surrogatepass"))
            score.append(top)
            came.append(by)
        ids: list[int] = []
        while end:
            by = came[end]
            if by:
                ids.append(by[1])
                end -= by[0]
            else:
                end -= 1
                ids.extend(bytes_first + b for b in reversed(text[end].encode("utf-8", "surrogatepass")))
        return ids[::-1]


_WORDS = re.compile(r" *[^ ]+| +")


def encoder(vocabulary: Vocabulary):
    """`encode(text) -> bytes` of little-endian i32 ids. Words met before come from a cache.

    No piece holds a mark after another character (checked), nor two characters that never stand side by side in a
    piece, so a text falls apart at such places without changing its best split.
    """
    automaton, first = Automaton(vocabulary), vocabulary.bytes_first
    splits = vocabulary.breaks_at_marks()
    pairs = {p[k : k + 2] for p in vocabulary.pieces for k in range(len(p) - 1)}

    def best(text: str) -> bytes:
        ids = automaton.best(text.replace(" ", MARK), first)
        return struct.pack(f"<{len(ids)}i", *ids)

    stems = WordCache(lambda words: list(map(best, words)))  # words without the marks that end them

    def ids_of(word: str) -> bytes:
        if MARK in word:  # a mark of the text itself
            return struct.pack("<3i", *(first + b for b in MARK.encode())).join(map(best, word.split(MARK)))
        end = len(word)
        while end and not word[end - 1].isalnum():
            end -= 1
        if 0 < end < len(word) and word[end - 1 : end + 1] not in pairs:
            parts = [word[:end], word[end:]]
            return b"".join(map(stems.fetch(parts).__getitem__, parts))
        return stems.fetch([word])[word]

    words_kept = WordCache(lambda words: [ids_of(" " + w) for w in words])  # words with one space before them
    others = WordCache(lambda words: list(map(ids_of, words)))

    def encode(text: str) -> bytes:
        if not text:
            return b""
        if not splits:
            return ids_of(" " + text)
        if text[0] == " " or text[-1] == " " or "  " in text:
            words = _WORDS.findall(" " + text)
            return b"".join(map(others.fetch(words).__getitem__, words))
        words = text.split(" ")
        return b"".join(map(words_kept.fetch(words).__getitem__, words))

    return encode


def decoder(vocabulary: Vocabulary):
    """`decode(ids) -> text`, the inverse of `encode`."""
    table: list[bytes] = [b""] * vocabulary.size
    for text, (i, _) in vocabulary.pieces.items():
        table[i] = text.replace(MARK, " ").encode("utf-8", "surrogatepass")
    for b in range(256):
        table[vocabulary.bytes_first + b] = bytes([b])

    def decode(ids) -> str:
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    return decode


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int), n_pieces. Null and empty texts have no ids; rows keep their number."""
    spark = docs.sparkSession
    shared = share(spark, Vocabulary.load(model_path), encoder)  # a vocabulary file, 32,000 pieces

    def run(batches):
        encode = shared()
        for batch in batches:
            data = [encode(t.as_py() or "") for t in batch.column(1)]
            sizes = np.array([len(d) // 4 for d in data], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32())
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(ends, ids), pa.array(sizes, pa.int64())],
                names=["doc_id", "ids", "n_pieces"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id, text. Null ids decode to null, no ids to the empty text."""
    shared = share(encoded.sparkSession, Vocabulary.load(model_path), decoder)

    def run(batches):
        decode = shared()
        for batch in batches:
            texts = [None if not x.is_valid else decode(x.values.to_numpy(zero_copy_only=False).tolist())
                     for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(
        encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")
    ).mapInArrow(run, "doc_id long, text string")


def checked_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_pieces, ids, same (whether decoding gives back the text; null counts as empty)."""
    shared = share(docs.sparkSession, Vocabulary.load(model_path), lambda v: (encoder(v), decoder(v)))

    def run(batches):
        encode, decode = shared()
        for batch in batches:
            data, same = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                data.append(np.frombuffer(encode(text), "<i4"))
                same.append(decode(data[-1].tolist()) == text)
            sizes = [len(d) for d in data]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.array(np.concatenate(data) if data else np.zeros(0, np.int32), pa.int32())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, ids), pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "ids", "same"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_pieces long, ids array<int>, same boolean"
    )
