"""Ranked lexical search over posting lists that are blocked by the likeness of their documents.

A first scan counts, for every document, the terms that the queries hold; it gives the corpus figures and a forward
table. The second scan takes that table in shards of a few thousand documents. In a shard every term has its posting list;
a list longer than a block is clustered around some of its own documents (largest inner product of their random
projections), and each block keeps the largest share in the score that any of its documents has of each term. The sum of
these over a query's terms is an exact upper bound: a block is skipped only if it is below the worst of the best
documents known so far. The same holds for lists: once the largest shares of a query's remaining lists add up to less, no
document outside the lists read can enter. All scores are 64-bit integers, so bounds and ties are exact.

A task carries its best documents on from shard to shard and gives them once, so a query's rows are at most k for a task.
Queries beyond some ITEM_BYTES of terms are dealt into parts, each of which scans the documents again.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.llm.coded_words import chunks, coded
from lotwise.llm.common import id_and_text, share
from lotwise.session import cut_lineage

ITEM_BYTES = 16_000_000  # of query terms that go to the driver and the tasks at once
SHARD = 4096  # documents of a shard
BLOCK = 64  # documents of a block on average
WIDTH = 16  # numbers of a document's random projection
SEED = 11

# A-Z in lower case; every other ASCII character but digits and a-z parts terms.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def plain_terms(texts: list[str | None]) -> list[bytes]:
    """Texts whose words are their terms; null has none."""
    return [(t or "").encode("utf-8", "surrogatepass").translate(_TABLE) for t in texts]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per item id its different terms; rows of one id, and those without one, are one item."""

    def run(batches):
        for batch in batches:
            terms = [sorted(set(t.decode("utf-8").split(" ")) - {""}) for t in plain_terms(batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["item", "terms"])

    rows = items.select(items[id_col].alias("item"), items[text_col].cast("string").alias("text"))
    schema = f"item {rows.schema['item'].dataType.simpleString()}, terms array<string>"
    found = rows.mapInArrow(run, schema)
    return found.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).where(F.size("terms") > 0)


def forward_table(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Per document with a term: doc_id, n (terms with repeats), and number and count of its terms in the vocabulary."""

    def run(batches):
        known = vocabulary()
        for batch in batches:
            for chunk in chunks(batch):
                codes, offsets, words = coded(plain_terms(chunk.column(1).to_pylist()))
                number = pc.fill_null(pc.index_in(words, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(offsets)
                term, doc = number[codes], np.repeat(np.arange(len(sizes)), sizes)
                held = term >= 0
                pairs, counts = np.unique(doc[held] * len(known) + term[held], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(known)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
                    for x in (pairs % max(1, len(known)), counts)
                ]
                out = pa.record_batch([chunk.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(sizes > 0))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


class Shard:
    """Documents (rows) with their terms and the terms' shares in the score, and the blocked posting lists."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, offsets: np.ndarray, terms: np.ndarray, shares: np.ndarray, n_terms: int):
        self.ids, self.null, self.offsets, self.terms, self.shares, self.n_terms = ids, null, offsets, terms, shares, n_terms
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.list_docs = row[order]
        self.list_ends = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)
        np.maximum.at(self.most, terms, shares)
        self._blocks: dict[int, tuple] = {}
        self._points = None

    def points(self) -> np.ndarray:
        """Random projections of the documents, of length one."""
        if self._points is None:
            signs = np.random.default_rng(SEED).standard_normal((self.n_terms, WIDTH), np.float32)
            sums = np.zeros((len(self.terms) + 1, WIDTH))
            np.cumsum(signs[self.terms] * (self.shares[:, None] / (1.0 + self.shares.max())), axis=0, out=sums[1:])
            total = sums[self.offsets[1:]] - sums[self.offsets[:-1]]
            self._points = total / np.maximum(np.linalg.norm(total, axis=1), 1e-12)[:, None]
        return self._points

    def rows_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of all terms of the documents, where each document's begin)."""
        sizes = self.offsets[docs + 1] - self.offsets[docs]
        begins = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.offsets[docs] - begins, sizes), begins

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Blocked list of a term: (documents by block, where blocks begin, keys block * n_terms + term, largest shares)."""
        if term not in self._blocks:
            docs = self.list_docs[self.list_ends[term] : self.list_ends[term + 1]]
            points = self.points()[docs]
            centres = points[:: max(1, len(docs) // -(-len(docs) // BLOCK))]
            nearest = np.argmax(points @ centres.T, axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            starts = np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))
            block = np.cumsum(np.concatenate([[0], nearest[1:] != nearest[:-1]]))
            places, _ = self.rows_of(docs)
            key = np.repeat(block, self.offsets[docs + 1] - self.offsets[docs]) * self.n_terms + self.terms[places]
            by = np.argsort(key)
            key = key[by]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self._blocks[term] = docs, starts, key[heads], np.maximum.reduceat(self.shares[places][by], heads)
        return self._blocks[term]

    def bounds(self, term: int, others: np.ndarray) -> np.ndarray:
        """Upper bound of every block of a term's list for a query of the terms `others`, by the blocks' summaries."""
        _, starts, keys, largest = self.blocks(term)
        wanted = np.arange(len(starts))[:, None] * self.n_terms + others[None, :]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, largest[at], 0).sum(axis=1)

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores; `wanted` marks the query's terms."""
        places, begins = self.rows_of(docs)
        return np.add.reduceat(np.where(wanted[self.terms[places]], self.shares[places], 0), begins)


class Best:
    """The k best documents of a query so far: score descending, doc_id ascending, no id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """Score below which no document can enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        able = score >= self.least()
        if able.any():
            score, ids, null = (np.concatenate([a, b[able]]) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
            order = np.lexsort((ids, null, -score))[: self.k]
            self.score, self.ids, self.null = score[order], ids[order], null[order]


def search_shard(shard: Shard, terms: np.ndarray, best: Best) -> int:
    """Update `best` with the documents of a shard; how many were scored."""
    here = terms[shard.most[terms] > 0]
    here = here[np.argsort(-shard.most[here], kind="stable")]
    rest = np.cumsum(shard.most[here][::-1])[::-1]  # no document without the terms before has a higher score
    wanted = np.zeros(shard.n_terms, bool)
    wanted[here] = True
    seen, scored = np.zeros(len(shard.ids), bool), 0
    for at, term in enumerate(here.tolist()):
        if rest[at] < best.least():
            break
        a, b = shard.list_ends[term], shard.list_ends[term + 1]
        docs = shard.list_docs[a:b]
        if len(docs) > BLOCK:
            docs, starts, _, _ = shard.blocks(term)
            # documents with an earlier term were scored or skipped there, so the terms from here on bound the others
            stays = shard.bounds(term, here[at:]) >= best.least()
            docs = docs[np.repeat(stays, np.diff(np.append(starts, len(docs))))]
        docs = docs[~seen[docs]]
        if len(docs):
            seen[docs] = True
            scored += len(docs)
            best.add(shard.scores(docs, wanted), shard.ids[docs], shard.null[docs])
    return scored


def _search_part(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    held = items.collect()  # some ITEM_BYTES at most
    terms = sorted({t for row in held for t in row["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    queries = [np.array(sorted(number[t] for t in row["terms"]), np.int64) for row in held]
    vocabulary = share(spark, terms, lambda value: pa.array(value, pa.large_string()))
    table = cut_lineage(forward_table(docs, vocabulary, id_col, text_col), "forward")
    n_docs, n_all = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(terms), np.int64)
    for row in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():
        weights[row["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * row["df"] + 1)))
    model = share(spark, (weights, queries))

    def run(batches):
        weights, queries = model()
        best, waiting, rows = [Best(k) for _ in queries], [], 0

        def flush():
            whole = pa.Table.from_batches(waiting).combine_chunks()
            ids = whole.column("doc_id").combine_chunks()
            n = whole.column("n").to_numpy().astype(np.int64)
            lists = whole.column("terms").combine_chunks()
            offsets = lists.offsets.to_numpy().astype(np.int64)
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = whole.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = 50 + 50 * n * n_docs // n_all
            shares = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, np.diff(offsets))))
            shard = Shard(
                pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False),
                offsets - offsets[0], term, shares, len(weights),
            )
            if len(term):
                for query, found in zip(queries, best):
                    search_shard(shard, query, found)

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                piece = batch.slice(at, SHARD)
                if rows and rows + piece.num_rows > SHARD:
                    flush()
                    waiting, rows = [], 0
                waiting.append(piece)
                rows += piece.num_rows
        if rows:
            flush()
        for i, found in enumerate(best):
            if len(found.score):
                yield pa.record_batch(
                    [pa.array(np.full(len(found.score), i), pa.int32()), pa.array(found.ids, mask=found.null), pa.array(found.score)],
                    names=["query", "doc_id", "score"],
                )

    found = table.mapInArrow(run, "query int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(held)], _named(items))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "query").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _named(items: DataFrame) -> str:
    return f"query int, item {items.schema['item'].dataType.simpleString()}"


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("item"), F.lit(parts))


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The k best documents for every item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. Scores above 0 count; equal scores
    go by ascending doc_id, rows without an id last. Null and empty texts have no term; an item without terms, and an empty
    table, give no row. Rows that repeat an id are documents of their own; rows that repeat an item id are one item.
    """
    terms = cut_lineage(item_terms(items, item_id, item_text), "items")
    size = terms.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8))).first()[0] or 0
    parts = max(1, -(-size // item_bytes))
    found = [
        _search_part(docs, terms.where(part_of(parts) == part) if parts > 1 else terms, k, id_col, text_col)
        for part in range(parts)
    ]
    return reduce(DataFrame.unionByName, found)
