"""Benchmark decontamination with a generalised suffix automaton over item words.

The automaton holds every word sequence of the items. A document's words are streamed through it; at each word the
state and the length of the longest match that ends there are known. Where that length reaches a window (13 words,
or a whole item that is shorter) the window's words are hit and the items that hold the window are read off the
state. Documents whose hits pass a coverage limit are contaminated.

Items beyond the bytes of one automaton are dealt into several. The documents are then written once and scanned once
for every part, the hits of all parts are united per row, and coverage is judged on the union.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotwise.llm.common import id_and_text, share
from lotwise.session import cut_lineage

WINDOW = 13
ROW, SPANS, ITEMS = "__row", "__spans", "__items"  # columns beside the caller's own
COVERAGE = 20  # contaminated from one hit word in this many
MAX_ITEM_BYTES = 16_000_000  # of item texts in one automaton, which takes some twenty times that in a task

# Bytes that end words become spaces, A-Z small letters; bytes of 0x80 and more belong to words.
_NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x20 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c
    for c in range(256)
)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # the same words in a text that keeps its capitals


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


@dataclass
class ItemAutomaton:
    """States over word ids, with the windows that end in each state."""

    vocabulary: dict[bytes, int]
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    window_state: list[int]  # nearest state on the link path whose shortest match is no longer than a window
    items: dict[int, set]  # window state -> items that hold the window of WINDOW words
    short: dict[int, list]  # state -> [(words, item)] of shorter items that end in it
    short_link: list[int]  # nearest state on the link path, itself included, that ends a shorter item
    pairs: np.ndarray  # sorted codes of neighbouring word ids in the items
    shortest: int

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]]) -> ItemAutomaton:
        vocabulary: dict[bytes, int] = {}
        nxt, link, length = [{}], [-1], [0]
        coded = [(item, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for item, words in items if words]
        pairs = set()
        for _, ids in coded:
            pairs.update(zip(ids, ids[1:]))
            last = 0
            for c in ids:
                last = cls._extend(nxt, link, length, last, c)
        self = cls(vocabulary, nxt, link, length, [], {}, {}, [], np.zeros(0, np.int64), WINDOW)
        n = len(vocabulary)
        self.pairs = np.sort(np.fromiter((a * n + b for a, b in pairs), np.int64, len(pairs)))
        by_length = sorted(range(len(nxt)), key=length.__getitem__)
        self.window_state = [0] * len(nxt)
        for s in by_length[1:]:
            self.window_state[s] = s if length[link[s]] < WINDOW else self.window_state[link[s]]
        for item, ids in coded:
            self.shortest = min(self.shortest, len(ids))
            state, size = 0, 0
            for c in ids:
                state, size = nxt[state][c], size + 1  # an item's own words always go on
                if size >= WINDOW:
                    self.items.setdefault(self.window_state[state], set()).add(item)
            if size < WINDOW:
                while length[link[state]] >= size:
                    state = link[state]
                self.short.setdefault(state, []).append((size, item))
        self.short_link = [0] * len(nxt)
        for s in by_length[1:]:
            self.short_link[s] = s if s in self.short else self.short_link[link[s]]
        return self

    @staticmethod
    def _extend(nxt: list, link: list, length: list, last: int, c: int) -> int:
        """One more word after `last`, which may already have it (another item with the same beginning)."""

        def clone(p: int, q: int) -> int:
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = copy
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            return copy

        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def hits(self, words: list[bytes], hit: np.ndarray, found: set) -> None:
        """Mark hit words and add the items whose windows occur.

        Only runs of words in which every neighbouring pair occurs in an item, and that are as long as the
        shortest window, can hold one; the others are skipped before the automaton is walked.
        """
        if len(words) < self.shortest:
            return
        ids = np.array([self.vocabulary.get(w, -1) for w in words], np.int64)
        known = ids >= 0
        goes_on = known[:-1] & known[1:]
        if len(self.pairs):
            codes = ids[:-1] * len(self.vocabulary) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
            goes_on &= self.pairs[at] == codes
        else:
            goes_on[:] = False
        first = np.flatnonzero(known & ~np.concatenate([[False], goes_on]))
        last = np.flatnonzero(known & ~np.concatenate([goes_on, [False]]))
        long = last - first + 1 >= self.shortest
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            self._walk(ids[a : b + 1].tolist(), a, hit, found)

    def _walk(self, ids: list[int], offset: int, hit: np.ndarray, found: set) -> None:
        nxt, link, length = self.next, self.link, self.length
        state, size = 0, 0
        for i, c in enumerate(ids, offset):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state, size = nxt[state][c], size + 1
            if size >= WINDOW:
                items = self.items.get(self.window_state[state])
                if items:
                    hit[i - WINDOW + 1 : i + 1] = True
                    found |= items
            s = self.short_link[state]
            while s:
                for n, item in self.short[s]:
                    if n <= size:
                        hit[i - n + 1 : i + 1] = True
                        found.add(item)
                s = self.short_link[link[s]]


def item_parts(items: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """(item, text) tables, each for one automaton. Null ids and texts are left out, repeated items count once."""
    rows = (
        items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text"))
        .dropna().distinct()
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= MAX_ITEM_BYTES:
        return [rows]
    largest = max(1, MAX_ITEM_BYTES // 32)

    def cut_long(batches):
        """Long items as pieces that share WINDOW - 1 words, so that every window is whole in one of them."""
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, step = words_of(text), 0
                if len(text.encode("utf-8", "surrogatepass")) > largest:
                    step = max(WINDOW, largest * len(words) // max(1, sum(map(len, words)) + len(words)))
                if step and len(words) > step + WINDOW - 1:
                    starts = range(0, len(words) - WINDOW + 1, step)
                    texts = [b" ".join(words[k : k + step + WINDOW - 1]).decode() for k in starts]
                else:
                    texts = [text]
                for text in texts:
                    yield pa.record_batch([pa.array([item]), pa.array([text])], names=["item", "text"])

    n = -(-2 * size // MAX_ITEM_BYTES)  # half full on average, as they are dealt by hash
    pieces = cut_lineage(
        rows.mapInArrow(cut_long, "item string, text string").withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n))),
        "items",
    )
    return [pieces.where(F.col("part") == k).select("item", "text") for k in range(n)]


def load_items(part: DataFrame):
    """Broadcast of the [(item, words)] of one part."""
    found = [(r["item"], words_of(r["text"])) for r in part.orderBy("item", "text").collect()]
    return share(part.sparkSession, found, scanner)


def spans_of(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def _part_hits(rows: DataFrame, part: DataFrame) -> DataFrame:
    """Row, hit spans and items of the rows (row, text) that hold a window of the part."""
    shared = load_items(part)

    def run(batches):
        scan = shared()
        for batch in batches:
            out = []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                hit, found = scan(words_of(value.as_py()))
                if found:
                    out.append((row, spans_of(hit), sorted(found)))
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[ROW, SPANS, ITEMS])

    schema = f"{ROW} long, {SPANS} array<struct<start: long, end: long>>, {ITEMS} array<string>"
    return cut_lineage(rows.mapInArrow(run, schema), "hits")


def with_hits(docs: DataFrame, text_col: str, parts: list[DataFrame]) -> tuple[DataFrame, Callable]:
    """The rows to scan, and a maker, for tasks, of `scan(batch, k, words) -> (hit flags, items)` of the k-th row."""
    if len(parts) == 1:
        shared = load_items(parts[0])

        def make():
            scan = shared()
            return lambda batch, k, words: scan(words)

        return docs, make
    kept = cut_lineage(docs.withColumn(ROW, F.monotonically_increasing_id()), "documents")
    rows = kept.select(ROW, F.col(text_col).cast("string"))
    found = None
    for part in parts:
        hits = _part_hits(rows, part)
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy(ROW).agg(
        F.flatten(F.collect_list(SPANS)).alias(SPANS), F.array_distinct(F.flatten(F.collect_list(ITEMS))).alias(ITEMS)
    )

    def read():
        def scan(batch, k, words):
            hit = np.zeros(len(words), bool)
            for span in batch.column(SPANS)[k].as_py() or []:
                hit[span["start"] : span["end"]] = True
            return hit, set(batch.column(ITEMS)[k].as_py() or [])

        return scan

    return kept.join(found, ROW, "left").drop(ROW), read


def scanner(items: list):
    """`scan(words) -> (hit flags, items)`."""
    automaton = ItemAutomaton.build(items)

    def scan(words: list[bytes]) -> tuple[np.ndarray, set]:
        hit, found = np.zeros(len(words), bool), set()
        automaton.hits(words, hit, found)
        return hit, found

    return scan


def is_contaminated(hit: np.ndarray) -> bool:
    n = int(hit.sum())
    return n > 0 and COVERAGE * n >= len(hit)


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit word ranges, end exclusive).

    Null and empty texts have no words; items without words or id take no part; repeated items count once.
    """
    rows, make = with_hits(id_and_text(docs, id_col, text_col), "text", item_parts(items, item_id, item_text))

    def run(batches):
        scan = make()
        for batch in batches:
            out = []
            for k, value in enumerate(batch.column(1)):
                words = words_of(value.as_py())
                hit, found = scan(batch, k, words)
                spans = spans_of(hit)
                digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
                out.append((len(words), int(hit.sum()), len(found), digest, is_contaminated(hit), spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(),
                     pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch(
                [batch.column(0), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start: long, end: long>>",
    )


def word_places(text: str) -> list[tuple[int, int]]:
    """Start and end of every word in the text's own characters."""
    return [m.span() for m in _WORD.finditer(text)]


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", cut_spans: bool = False,
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Rows and columns of `docs` without contaminated documents. With `cut_spans` every hit span, of documents
    below the coverage limit too, is cut out of the text and no document goes."""
    place, names = docs.columns.index(text_col), docs.columns
    plain = [f"c{k}" for k in range(len(names))]  # the caller may use any name
    rows, make = with_hits(docs.toDF(*plain), plain[place], item_parts(items, item_id, item_text))

    def run(batches):
        scan = make()
        for batch in batches:
            texts = [v.as_py() for v in batch.column(place)]
            hits = [scan(batch, k, words_of(t))[0] for k, t in enumerate(texts)]
            batch = batch.select(plain).rename_columns(names)
            if not cut_spans:
                yield batch.filter(pa.array([not is_contaminated(h) for h in hits], pa.bool_()))
                continue
            columns = list(batch.columns)
            columns[place] = pa.array([cut(t, h) if t else t for t, h in zip(texts, hits)], columns[place].type)
            yield pa.record_batch(columns, schema=batch.schema)

    return rows.mapInArrow(run, docs.schema)


def cut(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between them."""
    if not hit.any():
        return text
    places, out, at, k = word_places(text), [], 0, 0
    while k < len(hit):
        if hit[k]:
            first = k
            while k + 1 < len(hit) and hit[k + 1]:
                k += 1
            out.append(text[at : places[first][0]])
            at = places[k][1]
        k += 1
    return "".join(out) + text[at:]
