"""Periodic runs of words, found on a Re-Pair grammar.

Words become numbers, and frequent neighbours become nonterminals: each round replaces every pair that is more frequent
than the pairs it overlaps (ties by a seeded hash), which holds for all occurrences of the most frequent pair at least.
What no pair joins any more is parsed as a balanced tree, so every text has one parse tree, whose nodes share
nonterminals. A run lies whole in the lowest node that covers it and crosses that node's boundary; so the runs that cross
the boundary of each nonterminal are computed once, within its first expansion, and moved to all its positions. At an
upper node a run may show cut off; intervals of one period that overlap by a period or more are one run.

Runs here repeat at least four times and are six words or longer. Two periods or more then lie on one side of the
boundary, so a period is the length of half a square that begins or ends there. Every three neighbouring words of such a
run occur three times or more in the text: stretches without such triples hold no run and are left out of the grammar.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.coded_words import chunks, coded
from lotwise.llm.common import id_and_text

LEAST_WORDS, LEAST_REPEATS = 6, 4  # of a run; the triples rest on these
_NEVER = np.iinfo(np.int64).max


def repeated_stretches(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches whose word triples all occur three times or more in their text."""
    if len(codes) < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = codes.astype(np.uint64) + np.uint64(1)
        key = mixed[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ mixed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        key = (key ^ mixed[2:] * np.uint64(0x165667B19E3779F9)) + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
    cells = 1 << max(10, (4 * len(codes)).bit_length())
    cell = (key >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    hot = (np.bincount(cell, minlength=cells)[cell] >= 3) & (doc[:-2] == doc[2:])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hot.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2] + 2  # the last two words of a text begin no triple, so no stretch spans two
    long = ends - starts >= LEAST_WORDS
    return starts[long], ends[long]


def repair(codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar and parse of the concatenated stretches: per node of the parse trees its nonterminal and start, per
    nonterminal its length and the length of its left side. `part` numbers the stretch of each word."""
    sym, start, size = codes.astype(np.int64), np.arange(len(codes)), np.ones(len(codes), np.int64)
    part, cut = part.astype(np.int64), np.zeros(len(codes), bool)  # cut: the pair that begins here occurs once
    base = int(sym.max()) + 1 if len(sym) else 0
    nodes, begins, sizes, lefts, rules = [], [], [], [], 0
    done: list[tuple[np.ndarray, ...]] = []
    while len(sym) > 1:
        open_pair = (part[:-1] == part[1:]) & ~cut[:-1]
        at = np.flatnonzero(open_pair)
        if not len(at):
            break
        _, code, count = np.unique(sym[at] * (base + rules) + sym[at + 1], return_inverse=True, return_counts=True)
        with np.errstate(over="ignore"):
            order = np.lexsort(((np.arange(len(count)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), -count))
        place = np.empty(len(count), np.int64)
        place[order] = np.arange(len(count))
        place[count < 2] = _NEVER
        rank = np.full(len(sym) + 1, _NEVER)
        rank[at + 1] = place[code]  # rank[i + 1] is that of the pair at i
        cut[at[count[code] < 2]] = True
        # stretches of one rank: a lone pair, or a symbol that repeats
        edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        bounds = np.append(edge, len(rank))
        value = rank[edge]
        before = np.concatenate([[_NEVER], value[:-1]])
        after = np.concatenate([value[1:], [_NEVER]])
        best = (value != _NEVER) & (value < before) & (value < after)
        lengths = np.diff(bounds)[best]
        if not len(lengths):
            break
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        chosen = (np.repeat(edge[best], lengths) + offset - 1)[offset % 2 == 0]
        _, rule = np.unique(rank[chosen + 1], return_inverse=True)
        _, one = np.unique(rule, return_index=True)
        nodes.append(rule + rules)
        begins.append(start[chosen])
        sizes.append((size[chosen] + size[chosen + 1])[one])
        lefts.append(size[chosen][one])
        sym[chosen] = base + rules + rule
        size[chosen] += size[chosen + 1]
        cut[chosen] = cut[chosen + 1]
        rules += len(one)
        stay = np.ones(len(sym), bool)
        stay[chosen + 1] = False
        sym, start, size, part, cut = (x[stay] for x in (sym, start, size, part, cut))
        # symbols without an open pair at either side are ready
        right = np.append((part[:-1] == part[1:]) & ~cut[:-1], False)
        idle = ~(right | np.concatenate([[False], right[:-1]]))
        done.append((start[idle], size[idle], part[idle]))
        sym, start, size, part, cut = (x[~idle] for x in (sym, start, size, part, cut))
        cut[np.flatnonzero(np.diff(start) != size[:-1])] = True
    done.append((start, size, part))
    start, size, part = (np.concatenate([d[k] for d in done]) for k in range(3))
    order = np.argsort(start)
    start, size, part = start[order], size[order], part[order]
    while len(start) > 1:  # the balanced tree over what is left of each stretch
        number = np.arange(len(part)) - np.searchsorted(part, part)
        join = np.flatnonzero((part[:-1] == part[1:]) & (number[:-1] % 2 == 0))
        if not len(join):
            break
        nodes.append(rules + np.arange(len(join)))
        rules += len(join)
        begins.append(start[join])
        sizes.append(size[join] + size[join + 1])
        lefts.append(size[join])
        size[join] += size[join + 1]
        stay = np.ones(len(start), bool)
        stay[join + 1] = False
        start, size, part = start[stay], size[stay], part[stay]
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (nodes, begins, sizes, lefts))


class Words:
    """The concatenated words, compared in bulk."""

    def __init__(self, codes: np.ndarray):
        self.list = codes.tolist()
        self.reversed = self.list[::-1]
        self.raw = codes.astype("<i4").tobytes()

    def ahead(self, a: int, b: int, stop: int) -> int:
        """How many words from a on equal those from b on, a < b, up to `stop`."""
        raw, n, step = self.raw, 0, 4
        while b + n < stop:
            k = min(step, stop - b - n)
            if raw[4 * (a + n) : 4 * (a + n + k)] == raw[4 * (b + n) : 4 * (b + n + k)]:
                n, step = n + k, step * 2
            elif k == 1:
                break
            else:
                step = max(1, k // 4)
        return n

    def behind(self, a: int, b: int, stop: int) -> int:
        """How many words before a equal those before b, a < b, down to `stop`."""
        raw, n, step = self.raw, 0, 4
        while a - n > stop:
            k = min(step, a - n - stop)
            if raw[4 * (a - n - k) : 4 * (a - n)] == raw[4 * (b - n - k) : 4 * (b - n)]:
                n, step = n + k, step * 2
            elif k == 1:
                break
            else:
                step = max(1, k // 4)
        return n


def boundary_runs(words: Words, low: int, middle: int, high: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the runs within [low, high) that cross `middle`, as far as [low, high) shows them."""
    found, w, raw = set(), words.list, words.raw

    def keep(q: int) -> int:
        """Extent of period q around the boundary, kept if it is a run."""
        start = middle - words.behind(middle, middle + q, low) if middle + q <= high else 0
        end = middle + q + words.ahead(middle, middle + q, high)
        if start < middle < end and end - start >= max(LEAST_WORDS, LEAST_REPEATS * q):
            found.add((q, start, end))
        return end

    q, half, head = 1, (high - middle) // 2, w[middle]
    while q <= half:  # squares that begin at the boundary
        try:
            q = w.index(head, middle + q, middle + half + 1) - middle
        except ValueError:
            break
        if raw[4 * middle : 4 * (middle + q)] == raw[4 * (middle + q) : 4 * (middle + 2 * q)]:
            q = max(q, (keep(q) - middle) // 2)  # no other period that short fits the same stretch
        q += 1
    q, half, tail, last = 1, (middle - low) // 2, w[middle - 1], len(w) - middle
    while q <= half:  # squares that end there
        try:
            q = words.reversed.index(tail, last + q, last + half + 1) - last
        except ValueError:
            break
        if raw[4 * (middle - q) : 4 * middle] == raw[4 * (middle - 2 * q) : 4 * (middle - q)]:
            start = middle - q - words.behind(middle - q, middle, low)
            end = middle + words.ahead(middle - q, middle, high)
            if end > middle and end - start >= max(LEAST_WORDS, LEAST_REPEATS * q):
                found.add((q, start, end))
            q = max(q, (middle - start) // 2)
        q += 1
    return list(found)


def runs(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start and period; `doc` numbers the text of each word, ascending."""
    starts, ends = repeated_stretches(codes, doc)
    lengths = ends - starts
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    begin = np.cumsum(lengths) - lengths  # of each stretch, counted in kept words
    part = np.repeat(np.arange(len(starts)), lengths)
    kept = codes[np.arange(lengths.sum()) + (starts - begin)[part]]
    nodes, begins, sizes, lefts = repair(kept, part)
    words, order = Words(kept), np.argsort(nodes, kind="stable")
    nodes, begins = nodes[order], begins[order]
    first = np.searchsorted(nodes, np.arange(len(sizes)))
    last = np.append(first[1:], len(nodes))
    found = []
    able = np.flatnonzero(sizes >= LEAST_WORDS)
    for rule, low, left, size in zip(able.tolist(), begins[first[able]].tolist(), lefts[able].tolist(), sizes[able].tolist()):
        for q, start, end in boundary_runs(words, low, low + left, low + size):
            for at in begins[first[rule] : last[rule]].tolist():
                found.append((q, at + start - low, at + end - low))
    merged: list[list[int]] = []
    for q, start, end in sorted(found):
        if merged and merged[-1][2] == q and start <= merged[-1][1] - q and part[start] == part[merged[-1][0]]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, q])
    out = np.array(merged, np.int64).reshape(-1, 3)
    out[:, :2] += (starts - begin)[part[out[:, 0]]][:, None]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on repeat with period p, for one document in ten by its id's checksum."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)


def _judge(ids: list, codes: np.ndarray, offsets: np.ndarray, words: pa.Array, texts: list[bytes], change) -> list[tuple]:
    """One row of SCHEMA for each text of a chunk."""
    sizes = np.diff(offsets)
    source = np.arange(len(codes))
    changed = set()
    if change is not None:
        for k, (doc_id, n) in enumerate(zip(ids, sizes.tolist())):
            if (ap := change(doc_id, n)) is not None:
                a, p = ap
                at = offsets[k] + a
                source[at : offsets[k + 1]] = at + np.arange(n - a) % p
                changed.add(k)
        codes = codes[source]
    doc = np.repeat(np.arange(len(ids)), sizes)
    all_runs = runs(codes, doc)
    where = np.searchsorted(all_runs[:, 0], offsets)
    rows, known = [], {}
    for k, doc_id in enumerate(ids):
        here = all_runs[where[k] : where[k + 1]]
        here[:, :2] -= offsets[k]
        if len(here) or k in changed:
            drop = np.zeros(sizes[k] + 1, np.int64)
            np.add.at(drop, here[:, 0] + here[:, 2], 1)
            np.add.at(drop, here[:, 1], -1)
            stay = codes[offsets[k] : offsets[k + 1]][np.cumsum(drop[:-1]) == 0]
            for c in np.unique(stay).tolist():
                if c not in known:
                    known[c] = words[c].as_py().encode("utf-8", "surrogatepass")
            collapsed = b" ".join(map(known.__getitem__, stay.tolist()))
        else:
            collapsed = b" ".join(texts[k].split())
        top: tuple = (None, None, None, None)
        lines = []
        for start, end, q in here.tolist():
            length = end - start
            lines.append(f"{start},{length},{q}\n")
            if top[0] is None or length * top[2] > top[1] * q:  # ties: the earlier start, then the shorter period
                top = (start, length, q, 1000 * length // q)
        rows.append((
            doc_id, len(here), *top, hashlib.sha256("".join(lines).encode()).hexdigest(),
            hashlib.sha256(collapsed).hexdigest(),
        ))
    return rows


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=planted) -> DataFrame:
    """Per row: doc_id, n_runs, the run with the greatest length/period (start, length, period, exponent_milli), checksums
    of all runs and of the text without the repeats.

    `change(doc_id, n)` may name words to be repeated before the search (None: none are). Null and empty texts have no
    words, no run and the checksums of nothing. Repeated rows are judged one by one; a null id changes nothing. A text
    of any length is taken whole and is, beyond 4 MB, a chunk of its own.
    """

    def run(batches):
        names = [field.strip().split(" ")[0] for field in SCHEMA.split(",")]
        for batch in batches:
            for chunk in chunks(batch):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in chunk.column(1).to_pylist()]
                codes, offsets, words = coded(texts)
                rows = _judge(chunk.column(0).to_pylist(), codes, offsets, words, texts, change)
                kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
