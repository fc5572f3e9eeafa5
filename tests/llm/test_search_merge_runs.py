"""Lexical search, exact dedup and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import LONG, ROWS, documents, items
from pyspark.sql import functions as F

from lotwise.llm import digest_merge, grammar_runs, lexical_blocks
from lotwise.llm.queries import QUERIES, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_search(docs, asked, k):
    counts = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = {}
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, null, i) in enumerate(sorted(found)[:k], 1):
            out[item, rank] = (None if null else i, -score)
    return out


def asked_of(rows):
    asked = {}
    for item, text in rows:
        asked.setdefault(item, set()).update(TERM.findall(low(text)))
    return asked


def test_search_brute_force(spark, monkeypatch):
    """Many small blocks and shards, ties by repeated texts, a hot source of equal texts."""
    rng = random.Random(4)
    word = lambda: f"W{int(rng.paretovariate(0.6)) % 300}"
    rows = [(k, " ".join(word() for _ in range(rng.choice((0, 1, 5, 40))))) for k in range(700)]
    rows += [(1000 + k, rows[5][1] or "x") for k in range(300)] + [(None, "w1 w2 w3"), (3, "W1, w2-w3"), (3, "W1, w2-w3"), (4, None)]
    queries = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 30))))) for k in range(25)] + [(None, "w1"), (7, "w299"), (99, "!")]
    got = {
        (r["item_id"], r["rank"]): (r["doc_id"], r["score"])
        for r in lexical_blocks.lexical_search(
            documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3), items(spark, queries), k=20
        ).collect()
    }
    assert got == slow_search(rows, asked_of(queries), 20)
    parts = lexical_blocks.lexical_search(
        documents(spark, [(i, t, "en", "a") for i, t in rows]), items(spark, queries), k=20, item_bytes=300
    )
    assert {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in parts.collect()} == got


def test_blocks_are_skipped_and_nothing_is_lost():
    """Shards of two topics: a query on one scores few documents of the other, and finds what a full scan finds."""
    rng = np.random.default_rng(2)
    n, n_terms = 4000, 60
    lists = [np.unique(np.concatenate([[0, 1], rng.integers(2, 30, 6) + 28 * (d % 2)])) for d in range(n)]
    offsets = np.cumsum([0] + [len(x) for x in lists])
    terms = np.concatenate(lists)
    shares = rng.integers(1, 50, len(terms)) * np.where(terms < 2, 1, 20)
    shard = lexical_blocks.Shard(np.arange(n), np.zeros(n, bool), offsets, terms, shares, n_terms)
    for query in (np.array([0, 1, 5, 9, 11]), np.array([0, 40, 41, 45]), np.array([0, 1]), np.array([59])):
        best = lexical_blocks.Best(50)
        first = lexical_blocks.search_shard(shard, query, best)
        scores = np.array([shares[a:b][np.isin(terms[a:b], query)].sum() for a, b in zip(offsets, offsets[1:])])
        order = np.lexsort((np.arange(n), -scores))[:50]
        order = order[scores[order] > 0]
        assert best.ids.tolist() == order.tolist() and best.score.tolist() == scores[order].tolist()
        again = lexical_blocks.search_shard(shard, query, lexical_blocks.Best(50))
        assert first == again <= n
    best = lexical_blocks.Best(50)
    lexical_blocks.search_shard(shard, np.array([0, 1, 5, 9, 11]), best)
    scored = lexical_blocks.search_shard(shard, np.array([0, 1, 5, 9, 11]), best)
    assert scored < n // 2  # with the bound known, most blocks fail it
    docs, starts, keys, largest = shard.blocks(5)
    for b, at in enumerate(np.split(docs, starts[1:])):
        for t in (0, 5, 9):
            held = [int(shares[offsets[d] : offsets[d + 1]][terms[offsets[d] : offsets[d + 1]] == t].sum()) for d in at]
            place = np.searchsorted(keys, b * n_terms + t)
            stored = int(largest[place]) if place < len(keys) and keys[place] == b * n_terms + t else 0
            assert stored == max(held)


def slow_copies(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault(low(t), []).append((-1 if i is None else i, -at))
    out = []
    for at, (i, t) in enumerate(rows):
        same = groups[low(t)]
        keep = max(same)
        out.append((i, None if keep[0] < 0 else keep[0], len(same), (-1 if i is None else i) == keep[0], hashlib.sha256(low(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("partitions", [1, 7, 70])
def test_copies_brute_force(spark, partitions):
    rng = random.Random(partitions)
    rows = [(k, rng.choice(["Äb", "äb", "AB c", "ab C", "ab  c", None, "", "hot text", "Hot Text", "hot text"]) ) for k in range(400)]
    rows += [(1000 + k, f"text {k}") for k in range(200)] + [(None, "hot text"), (None, "alone"), (None, "ALONE"), (3, "x"), (3, "x")]
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(partitions)
    got = digest_merge.exact_copies(docs).collect()
    want = slow_copies(rows)
    view = lambda r: (r[0], r[1], r[2], r[4])
    assert Counter(map(view, got)) == Counter(map(view, want))
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({r[4]: 1 for r in want})  # one of each
    kept = digest_merge.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({low(t) for _, t in rows})
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_copies_plan_is_native(spark, sf):
    found = QUERIES["op12_digest_merge"](spark, sf)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = digest_merge.digests(table(spark, sf, "documents"), "doc_id", "text", F.monotonically_increasing_id())
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_digest_levels_meet(spark):
    """Copies in many runs: each level joins at most eight rows of a digest, the last holds one."""
    docs = documents(spark, [(k, "the same text", "en", "a") for k in range(300)]).repartition(100)
    levels = digest_merge.merged_levels(digest_merge.cut_lineage(digest_merge.digests(docs, "doc_id", "text", F.monotonically_increasing_id())))
    sizes = [level.count() for level in levels]
    assert len(sizes) == 4 and sizes[-1] == 1 and all(a <= 8 * b for a, b in zip(sizes, sizes[1:]))
    assert levels[-1].first()["n"] == 300


def slow_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(6, 4 * q):
                if not any(all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q)):
                    out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def slow_row(doc_id, text, change=True):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if change and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow_runs(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    top = (None,) * 4
    if found:
        s, length, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        top = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for k in range(400):
        size = rng.choice((1, 2, 4, 30))
        w = [f"w{rng.randrange(size)}" for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            piece = [f"w{rng.randrange(size)}" for _ in range(rng.randint(1, 8))] * rng.randint(1, 7)
            at = rng.randint(0, len(w))
            w[at:at] = piece + piece[: rng.randint(0, len(piece))]
        rows.append((k, "".join(x + rng.choice((" ", "\n", "\t \x0b", "\x0c")) for x in w)))
    rows += [(i, t) for i, t, _, _ in ROWS if t != LONG] + [(None, "a b " * 9), (5, "x " * 6), (5, "x " * 6), (6, "x " * 5), (7, "a b a b a b a")]
    got = grammar_runs.find_runs(documents(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert Counter(map(tuple, got)) == Counter(slow_row(i, t) for i, t in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 20
    plain = grammar_runs.find_runs(documents(spark, [(i, t, "en", "a") for i, t in rows]), change=None).collect()
    assert Counter(map(tuple, plain)) == Counter(slow_row(i, t, False) for i, t in rows)


def test_runs_of_given_documents(spark, sf):
    rows = table(spark, sf, "documents").where(F.length("text") < 4000).collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_grammar_runs"](spark, sf).collect()}
    for r in rows:
        assert got[r["doc_id"]] == slow_row(r["doc_id"], r["text"])


@pytest.mark.parametrize("words", [[1] * 50_000, list(range(7)) * 9_000 + [3], [0, 1] * 20_000 + list(range(2, 500)) * 20])
def test_long_runs(words):
    found = grammar_runs.runs(np.array(words), np.zeros(len(words), int)).tolist()
    assert found and all(words[s : e - q] == words[s + q : e] for s, e, q in found)
    assert max(e - s for s, e, q in found) >= 0.9 * max(40_000, len(words) - 10_000)


def test_grammar_tree():
    """Every node of the parse is its nonterminal's text, and the nodes of a stretch make one binary tree."""
    rng = random.Random(2)
    codes = np.array([rng.randrange(3) for _ in range(300)] + [5, 6, 7] * 40)
    part = np.repeat([0, 1, 2], [100, 200, 120])
    nodes, begins, sizes, _ = grammar_runs.repair(codes, part)
    texts = {}
    for node, at in zip(nodes.tolist(), begins.tolist()):
        text = tuple(codes[at : at + sizes[node]])
        assert texts.setdefault(node, text) == text
    assert len(nodes) == len(codes) - 3 and len(sizes) < len(nodes)
