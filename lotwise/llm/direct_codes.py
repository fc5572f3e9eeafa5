"""Directly addressable codes: token ids in chunk levels, any of them readable without decoding a block.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the lowest chunk of every id; level k holds the
k-th chunk of the ids that have one. A bitmap beside each level says which of its entries go on in the next
level, and a rank directory (set bits before every 512th entry) tells where they go on. Reading one id takes
one chunk, one bit and one rank per level.

A segment is one binary row:

    "DAC1" | tokens u32 | documents u32 | levels u32 | document ids i64 (0 where null) | null flags u8
    | document ends u32 | per level: entries u32, chunks u8, bitmap u8 (lowest bit first), directory u32

Segments are written as Parquet rows (part, seq, start, n_tokens, codes) by Spark's own committer, so any store
that Spark writes to holds them and a lost executor costs only its running tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lotwise.llm.coded_words import chunks
from lotwise.llm.common import id_and_text, share
from lotwise.session import shared_folder

MAGIC = b"DAC1"
RANK_STEP = 512
SEGMENT_TOKENS = 1 << 18  # a segment closes at the first document end beyond this many tokens


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap bytes, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        rest = rest >> 8
        more = rest > 0
        ranks = np.zeros(len(more) // RANK_STEP + 1, np.uint32)
        if len(more) >= RANK_STEP:
            full = more[: len(more) // RANK_STEP * RANK_STEP].reshape(-1, RANK_STEP).sum(axis=1)
            ranks[1:] = np.cumsum(full)
        levels.append((chunks, np.packbits(more, bitorder="little"), ranks))
        rest = rest[more]
        if not len(rest):
            return levels


def pack(doc_ids: list, ends: list[int], ids: np.ndarray) -> bytes:
    levels = encode_levels(ids)
    out = [
        MAGIC, struct.pack("<III", len(ids), len(doc_ids), len(levels)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(), np.array(ends, "<u4").tobytes(),
    ]
    for chunks, bitmap, ranks in levels:
        out += [struct.pack("<I", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """A written segment: documents, and single ids or ranges of ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.n_tokens, n_docs, n_levels = struct.unpack_from("<III", data, 4)
        at = 16
        ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        null = np.frombuffer(data, np.uint8, n_docs, at)
        at += n_docs
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null)]
        self.ends = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, -(-n // 8)), ("<u4", n // RANK_STEP + 1)):
                parts.append(np.frombuffer(data, kind, count, at))
                at += parts[-1].nbytes
            self.levels.append(tuple(parts))

    def get(self, i: int) -> int:
        """The i-th id of the segment, by rank alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for shift, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_STEP * RANK_STEP
            between = np.unpackbits(bitmap[block >> 3 : (i >> 3) + 1], bitorder="little")[: i - block]
            i = int(ranks[block // RANK_STEP]) + int(between.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        values, where = np.zeros(self.n_tokens, np.uint32), np.arange(self.n_tokens)
        for shift, (chunks, bitmap, _) in enumerate(self.levels):
            values[where] |= chunks.astype(np.uint32) << np.uint32(8 * shift)
            where = where[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)]
        return values


SENTENCE = 512  # runs that go to the library as one text
AT_ONCE = 5_000_000  # bytes of text that are numbered together
MAX_RUNS, LONGEST = 500_000, 64  # runs remembered, and the bytes of one at most: 70 MB, some 25 with usual words
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_UNEVEN = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "](?: |\\z)"
_CUT = re.compile(r"(?<=\S)(?= )")
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())  # ASCII punctuation
_SOLID = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]\\z"  # letters and digits in every version of Unicode


def _picked(flat: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The entries of stretches that begin at `places`, one stretch after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(places - ends + sizes, sizes)]


class BulkEncoder:
    """Ids of many texts, as the library gives them by default.

    The tokenizer's pattern never looks behind, and no word of it holds a space but as its first character; so a text falls
    apart before every space that follows a non-space, without changing its ids. The pieces of a chunk of texts are
    numbered in bulk, each different one is encoded once but for its ending punctuation, and the texts' ids are gathered by
    number. Runs of one word are remembered within bounds, compactly. A text that spells an added token goes to the library whole, unless `ordinary` texts are wanted.
    """

    def __init__(self, tokenizer_json: str, ordinary: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_str(tokenizer_json)
        self.plain.encode_special_tokens = True
        self.vocabulary_text = tokenizer_json
        self.added = [] if ordinary else [t.content for t in self.plain.get_added_tokens_decoder().values()]
        vocabulary = self.plain.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with the space's byte
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.known, self.known_ids = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.places, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @cached_property
    def library(self):
        """The library as it is, for texts that spell an added token; few do, and it takes 40 MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.vocabulary_text)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of each text's ids)."""
        found = [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each run's begin, how many they are) of different runs with one space before them, none within
        and no blank at their end. Punctuation that ends a run after a letter or digit is a word of its own, so a run is
        its stem and one of few endings."""
        stems = pc.utf8_rtrim(runs, characters=MARKS)
        over = pc.subtract(pc.binary_length(runs), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
        cut = (over > 0) & pc.match_substring_regex(stems, _SOLID).to_numpy(zero_copy_only=False)
        stems = pc.if_else(pa.array(cut), stems, runs).dictionary_encode()
        flat, places, sizes = self._stems(stems.dictionary)
        which = stems.indices.to_numpy(zero_copy_only=False)
        places, sizes = places[which], sizes[which]
        if not cut.any():
            return flat, places, sizes
        number: dict[str, int] = {}
        ending = [number.setdefault(w[-n:], len(number)) for w, n in zip(runs.filter(pa.array(cut)).to_pylist(), over[cut].tolist())]
        marks, few = self._ids(list(number))
        begin, few = (np.cumsum(few) - few)[ending], few[ending]
        whole = sizes[cut] + few
        first = np.cumsum(whole) - whole
        joined = np.empty(whole.sum(), np.uint32)
        every = np.arange(len(joined))
        joined[_picked(every, first, sizes[cut])] = _picked(flat, places[cut], sizes[cut])
        joined[_picked(every, first + sizes[cut], few)] = _picked(marks, begin, few)
        places[cut], sizes[cut] = len(flat) + first, whole
        return np.concatenate([flat, joined]), places, sizes

    def _stems(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for runs as they are. Those not met before go to the library many at a time; one id of each begins
        with the space, its first."""
        found = pc.index_in(runs, value_set=self.known)
        hit = pc.is_valid(found).to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False)
        fresh = runs.filter(pa.array(~hit))
        words = [w or "." for w in fresh.to_pylist()]  # only first pieces are empty, and their codes are replaced
        ids, _ = self._ids([" " + " ".join(words[k : k + SENTENCE]) for k in range(0, len(words), SENTENCE)])
        firsts = np.flatnonzero(self.spaced[ids])
        flat = np.concatenate([self.known_ids, ids])
        places, sizes = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
        places[~hit], sizes[~hit] = len(self.known_ids) + firsts, np.diff(np.append(firsts, len(ids)))
        places[hit], sizes[hit] = self.places[at[hit]], self.sizes[at[hit]]
        self.met[at[hit]] = True
        short = ~hit & (pc.binary_length(runs).to_numpy(zero_copy_only=False) <= LONGEST)
        self._keep(flat, pa.concat_arrays([self.known, runs.filter(pa.array(short))]), np.append(self.places, places[short]),
                   np.append(self.sizes, sizes[short]), np.append(self.met, np.ones(short.sum(), bool)))
        return flat, places, sizes

    def _keep(self, flat: np.ndarray, known: pa.Array, places: np.ndarray, sizes: np.ndarray, met: np.ndarray) -> None:
        """Remember these runs; beyond MAX_RUNS those not met since the last time go, then the oldest."""
        if len(known) > MAX_RUNS:
            stay = met.copy()
            stay[: np.searchsorted(np.cumsum(stay), stay.sum() - MAX_RUNS // 2)] = False
            known, places, sizes = known.filter(pa.array(stay)), places[stay], sizes[stay]
            met = np.zeros(len(places), bool)
        self.known_ids = _picked(flat, places, sizes)
        self.known, self.places, self.sizes, self.met = known, np.cumsum(sizes) - sizes, sizes, met

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        uneven = pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNEVEN).to_numpy(zero_copy_only=False)
        even, odd = [], []  # texts whose spaces all follow a non-space and that end in one, and others
        for k, text in enumerate(texts):
            if any(token in text for token in self.added):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                (odd if uneven[k] else even).append(k)
        split = pc.split_pattern(pa.array([texts[k] for k in even], pa.large_string()), " ")
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64)
        flat, places, sizes = self._runs(words.dictionary)
        codes[offsets[:-1]] = len(places) + np.arange(len(even))  # no space stands before a text's first piece
        heads = [texts[k].split(" ", 1)[0] for k in even]
        cuts, number = [_CUT.split(texts[k]) for k in odd], {}
        later = [len(places) + len(heads) + number.setdefault(p, len(number)) for c in cuts for p in c]
        codes = np.concatenate([codes, np.array(later, np.int64)])
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(c) for c in cuts], dtype=np.int64)])
        rest, few = self._ids(heads + list(number))
        places = np.concatenate([places, len(flat) + np.cumsum(few) - few])
        flat, sizes = np.concatenate([flat, rest]), np.concatenate([sizes, few])
        taken = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(taken)])
        at = np.repeat((places[codes] - ends[:-1]).astype(np.int32), taken)  # a chunk's ids and the remembered ones
        at += np.arange(ends[-1], dtype=np.int32)
        ids = flat[at]
        for k, a, b in zip(even + odd, ends[offsets[:-1]].tolist(), ends[offsets[1:]].tolist()):
            out[k] = ids[a:b]
        return out


def release() -> None:
    """Give back what Arrow keeps of freed memory; a worker that waits for its next task would hold some 100 MB of it."""
    pa.default_memory_pool().release_unused()


def text_encoder(tokenizer_json: str):
    """`encode(text) -> bytes` of little-endian u32 ids of one text, ordinary also where it spells an added token."""
    encoder = BulkEncoder(tokenizer_json, ordinary=True)
    return lambda text: encoder.encode([text])[0].astype("<u4").tobytes()


def write_codes(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text (null counts as empty), append `end_id`, write segments in ascending id order.

    Rows are dealt by ranges of (id, text hash), so one id that repeats does not meet in one task. Null ids come
    first; rows with the same id are ordered by their text. An empty table writes no segment.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file, a few MB
        vocabulary = share(spark, f.read(), BulkEncoder)

    def run(batches):
        encoder, part = vocabulary(), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        seq, start, size = 0, 0, 0
        doc_ids, ends, pieces = [], [], []

        def close():
            nonlocal seq, start, size, doc_ids, ends, pieces
            codes = pack(doc_ids, ends, np.concatenate(pieces))
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([start], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([codes], pa.binary())],
                names=["part", "seq", "start", "n_tokens", "codes"],
            )
            seq, start, size, doc_ids, ends, pieces = seq + 1, start + size, 0, [], [], []
            return row

        for chunk in (c for batch in batches for c in chunks(batch, at_once=AT_ONCE)):
            texts = [t or "" for t in chunk.column(1).to_pylist()]
            for doc_id, ids in zip(chunk.column(0).to_pylist(), encoder.encode(texts)):
                pieces += [ids, end]
                size += len(ids) + 1
                doc_ids.append(doc_id)
                ends.append(size)
                if size >= SEGMENT_TOKENS:
                    yield close()
        if doc_ids:
            yield close()
        release()

    ordered = (
        id_and_text(docs, id_col, text_col)
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    ordered.mapInArrow(run, "part int, seq long, start long, n_tokens long, codes binary").write.parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, read from the segments."""
    schema = "part int, seq long, start long, n_tokens long, codes binary"
    table = spark.read.schema(schema).parquet(path)
    # one row per written partition, at most as many as the range partitioning has
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, offset = {}, 0
    for row in totals:
        before[row["part"]] = offset
        offset += row["n"]

    def run(batches):
        for batch in batches:
            for part, start, codes in zip(*(batch.column(k).to_pylist() for k in range(3))):
                segment = Segment(codes)
                data, ends = memoryview(segment.all().astype("<u4").tobytes()), segment.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(segment.doc_ids, pa.int64()), pa.array(starts + before[part] + start, pa.int64()),
                     pa.array(ends - starts, pa.int64()),
                     pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
        release()

    return table.select("part", "start", "codes").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def direct_codes(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write `docs` as directly addressable codes below the shared folder and read the figures back."""
    path = shared_folder(docs.sparkSession, "codes")
    write_codes(docs, tokenizer_path, end_id, path, id_col, text_col)
    return read_codes(docs.sparkSession, path)
