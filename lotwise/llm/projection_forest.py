"""Approximate nearest neighbours by cosine with a forest of random-projection trees.

Every tree projects unit vectors on one seeded random direction per level and splits each node at the median of a
bounded sample. A query walks all trees through one priority queue, ordered by the smallest distance to a split that
its way has ignored so far, until it has seen enough leaves. Every vector is indexed. What is enough is measured on
the table itself: the exact neighbours of a bounded sample of queries tell how many leaves have to be seen, and leaves
grow until the stated number of them suffices. Queries and vectors meet by leaf in a shuffle, leaf candidates are scored exactly in double precision on the original vectors, and the best of
all leaves are ranked.

Equal vectors are indexed once, with their k + 1 smallest ids: more could not be among the k nearest. So no leaf
grows with the number of copies.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lotwise.llm.common import share
from lotwise.session import cut_lineage

TREES = 24
LEAF = 96  # vectors of a leaf, on average, as long as the sample can resolve it and VISITS leaves give RECALL
VISITS = 160  # leaves that a query sees; more where leaves of LARGEST_LEAF vectors do not give RECALL
LARGEST_LEAF = 8192  # vectors; bounds what a task holds of one leaf
RECALL = 0.95  # wanted share of the exact neighbours of the sampled queries
ASKED = 200  # queries whose exact neighbours are looked up for that, about
SAMPLE = 1 << 16  # vectors that place the splits; beyond SAMPLE / 4 leaves per tree, leaves grow with the table
SEED = 11


@dataclass
class Forest:
    directions: np.ndarray  # trees x levels x dimensions
    splits: np.ndarray  # trees x inner nodes, in heap order
    filled: np.ndarray  # trees x leaves: sample vectors in the leaf

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
        """`sample`: unit vectors, all of them if `total` is small."""
        wanted = np.log2(max(total, 1) / leaf)
        levels = int(max(0, min(np.ceil(wanted), np.log2(max(len(sample), 4) / 4))))
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((trees, levels, sample.shape[1]))
        splits = np.zeros((trees, 2**levels - 1))
        filled = np.zeros((trees, 2**levels), np.int64)
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for level in range(levels):
                value = sample @ directions[t, level]
                order = np.lexsort((value, node))
                ends = np.searchsorted(node[order], np.arange(2**level), "right")
                starts = np.concatenate([[0], ends[:-1]])
                full = ends > starts
                middle = np.zeros(2**level)
                middle[full] = value[order][(starts + (ends - starts - 1) // 2)[full]]
                splits[t, 2**level - 1 : 2 ** (level + 1) - 1] = middle
                node = 2 * node + (value > middle[node])
            filled[t] = np.bincount(node, minlength=2**levels)
        return cls(directions, splits, filled)

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def cut(self, levels: int) -> Forest:
        """The same trees, ended after `levels` levels."""
        filled = self.filled.reshape(len(self.filled), 2**levels, -1).sum(axis=2)
        return Forest(self.directions[:, :levels], self.splits[:, : 2**levels - 1], filled)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every unit vector in every tree."""
        out = np.zeros((len(vectors), len(self.directions)), np.int64)
        for t, directions in enumerate(self.directions):
            node = np.zeros(len(vectors), np.int64)
            for level in range(self.levels):
                node = 2 * node + (vectors @ directions[level] > self.splits[t, 2**level - 1 + node])
            out[:, t] = node
        return out

    def probes(self, vector: np.ndarray, visits: int, least: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves a unit vector sees: `visits` of them, and more until one tree's share of the
        sample in them is `least`, so that at least so many candidates are found if there are so many."""
        side = self.directions @ vector
        queue = [(-np.inf, t, 0, 0) for t in range(len(self.directions))]  # (-distance, tree, level, node)
        found, seen = [], [0] * len(self.directions)
        while queue and (len(found) < visits or max(seen) < least):
            ignored, t, level, node = heapq.heappop(queue)
            while level < self.levels:
                gap = side[t, level] - self.splits[t, 2**level - 1 + node]
                right = gap > 0
                heapq.heappush(queue, (max(ignored, abs(gap)), t, level + 1, 2 * node + (not right)))
                level, node = level + 1, 2 * node + right
            found.append((t, int(node)))
            seen[t] += int(self.filled[t, node])
        return found


    def ranks(self, vector: np.ndarray, others: np.ndarray) -> np.ndarray:
        """For each of the other vectors, how many leaves `vector` has to see until one of them holds it."""
        side, distances = self.directions @ vector, np.full((len(self.directions), 1), -np.inf)
        for level in range(self.levels):
            gap = side[:, level, None] - self.splits[:, 2**level - 1 : 2 ** (level + 1) - 1]
            far = np.maximum(distances, np.abs(gap))
            sides = (np.where(gap > 0, far, distances), np.where(gap > 0, distances, far))
            distances = np.stack(sides, axis=2).reshape(len(side), -1)
        first = distances[np.arange(len(side)), self.leaves(others)].min(axis=1)
        return np.array([np.count_nonzero(distances <= f) for f in first])

    def calibrate(self, known: list[tuple[np.ndarray, np.ndarray]], total: int, visits: int) -> tuple[Forest, int]:
        """The deepest of these trees, and the leaves to see, with which the `known` (vector, its neighbours) are found
        to the share RECALL: `visits` leaves, or more of the largest allowed ones."""
        forest = self
        while known:
            ranks = np.sort(np.concatenate([forest.ranks(v, others) for v, others in known]))
            needed = int(ranks[int(np.ceil(RECALL * len(ranks))) - 1])
            if needed <= visits:
                break
            if not forest.levels or total / 2 ** (forest.levels - 1) > LARGEST_LEAF:
                return forest, needed
            forest = forest.cut(forest.levels - 1)
        return forest, visits


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: an id, no null or non-finite component, not all zero, and of the
    length that most vectors have. Repeated rows count once."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vec")).where(
        F.col("id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vec", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (sizes["n"] if sizes else 0)).distinct()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def exact_neighbours(groups: DataFrame, queries: DataFrame, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(unit vector, its k nearest unit vectors) of about ASKED of the `queries`, from all `groups`."""
    drawn = F.pmod(F.xxhash64("gid"), F.lit(max(queries.count(), 1))) < ASKED
    asked = queries.where(drawn).orderBy("gid").toArrow().combine_chunks()
    if not asked.num_rows:
        return []
    own, points = asked.column("gid").to_numpy(), unit(matrix(asked.column("vec").combine_chunks()))
    shared = share(groups.sparkSession, points)

    def closest(batches):
        points, best = shared(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            gid, data = batch.column(0).to_numpy(), matrix(batch.column(1))
            score = unit(data) @ points.T
            if best is None:
                best = [(np.zeros(0), np.zeros(0, np.int64), data[:0])] * len(points)
            for q, (scores, ids, rows) in enumerate(best):
                scores, ids = np.concatenate([scores, score[:, q]]), np.concatenate([ids, gid])
                top = np.argpartition(-scores, k)[: k + 1] if len(scores) > k + 1 else np.arange(len(scores))
                held = [rows[i] if i < len(rows) else data[i - len(rows)] for i in top]
                best[q] = (scores[top], ids[top], np.array(held))
        for q, (scores, ids, rows) in enumerate(best or []):
            yield pa.record_batch(
                [pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores), pa.array(rows.tolist(), pa.list_(pa.float64()))],
                names=["q", "gid", "score", "vec"],
            )

    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "gid")
    found = (
        groups.select("gid", "vec").mapInArrow(closest, "q long, gid long, score double, vec array<double>")
        .withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
        .select("q", "gid", "vec").collect()  # at most (k + 1) rows for each of the sampled queries
    )
    near: dict[int, list] = {}
    for row in found:
        if row["gid"] != own[row["q"]]:
            near.setdefault(row["q"], []).append(row["vec"])
    return [(points[q], unit(np.array(vecs))) for q, vecs in sorted(near.items())]


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, visits: int = VISITS, leaf: int = LEAF,
) -> DataFrame:
    """Per query (rows where `is_query` holds, over column `id`) its k nearest found: query_id, rank, vec_id, score.

    `visits` and `leaf` are where the calibration starts; see VISITS, LEAF.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors, id_col, vector_col), "vectors")
    first = Window.partitionBy("vec").orderBy("id")
    groups = cut_lineage(
        rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("gid"), "ids", "vec"),
        "distinct",
    )
    total = groups.count()
    part = groups.where(F.pmod(F.xxhash64("vec"), F.lit(max(total, 1))) < SAMPLE).select("vec").orderBy("vec")
    sample = part.toArrow().column("vec").combine_chunks()  # about SAMPLE vectors at most
    sample = matrix(sample) if len(sample) else np.zeros((0, 1))
    forest = Forest.fit(unit(sample) if len(sample) else sample, total, trees, leaf)

    asked = rows.where(is_query)
    named = asked.join(groups.select("vec", "gid"), "vec").select("id", "gid")
    queries = cut_lineage(
        groups.join(named.select("gid").distinct(), "gid", "left_semi").select("gid", "vec"), "queries"
    )
    forest, visits = forest.calibrate(exact_neighbours(groups, queries, k) if forest.levels else [], total, visits)
    shared = share(spark, forest)  # at most trees x SAMPLE / 4 numbers

    def to_leaves(batches):
        model = shared()
        for batch in batches:
            if batch.num_rows:
                found = model.leaves(unit(matrix(batch.column(1))))
                bucket = found + np.arange(found.shape[1]) * (1 << model.levels)
                yield _rows(bucket.ravel(), False, np.repeat(np.arange(len(found)), found.shape[1]), batch)

    def to_probes(batches):
        model = shared()
        for batch in batches:
            if batch.num_rows:
                found = [model.probes(v, visits, 4 * (k + 1)) for v in unit(matrix(batch.column(1)))]
                bucket = np.array([(t << model.levels) + leaf for f in found for t, leaf in f])
                yield _rows(bucket, True, np.repeat(np.arange(len(found)), [len(f) for f in found]), batch)

    def _rows(bucket, asks, at, batch):
        taken = batch.take(pa.array(at))
        return pa.record_batch(
            [pa.array(bucket, pa.int64()), pa.array(np.full(len(at), asks)), taken.column(0), taken.column(1)],
            names=["bucket", "asks", "gid", "vec"],
        )

    shape = f"bucket long, asks boolean, gid long, vec {dict(groups.dtypes)['vec']}"
    met = (
        groups.select("gid", "vec").mapInArrow(to_leaves, shape)
        .unionByName(queries.mapInArrow(to_probes, shape))
        .repartition("bucket").sortWithinPartitions("bucket", "asks")
    )

    def score(batches):
        bucket, ids, held, lengths = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column(0).to_numpy(zero_copy_only=False)
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            gids = batch.column(2).to_numpy(zero_copy_only=False)
            data, out = matrix(batch.column(3)), ([], [], [])
            change = (np.diff(buckets) != 0) | (np.diff(asks.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(gids)]
            for a, b in zip(edges, edges[1:]):
                if buckets[a] != bucket:
                    bucket, ids, held, lengths = buckets[a], [], [], None
                if not asks[a]:
                    ids.append(gids[a:b])
                    held.append(data[a:b])
                    continue
                if not held:
                    continue  # an empty leaf
                if lengths is None:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    lengths = np.sqrt((held[0] * held[0]).sum(axis=1))
                for i in range(a, b):
                    q = data[i]
                    cosine = (held[0] * q).sum(axis=1) / (np.sqrt((q * q).sum()) * lengths)
                    best = np.lexsort((ids[0], -cosine))[: k + 1]
                    out[0].append(np.full(len(best), gids[i]))
                    out[1].append(ids[0][best])
                    out[2].append(cosine[best])
            if out[0]:
                yield pa.record_batch(
                    [pa.array(np.concatenate(o), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))],
                    names=["qid", "gid", "score"],
                )

    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")
    best = (
        met.mapInArrow(score, "qid long, gid long, score double")
        .groupBy("qid", "gid").agg(F.max("score").alias("score"))
        .withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    )
    ranked = (
        best.join(groups.select("gid", "ids"), "gid")
        .select("qid", F.explode("ids").alias("vec_id"), "score")
        .groupBy("qid").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")).alias("found"))
        .select(F.col("qid").alias("gid"), F.slice(F.sort_array("found"), 1, k + 1).alias("found"))
    )
    answers = named.join(ranked, "gid").select(
        F.col("id").alias("query_id"),
        F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)),
    )
    return answers.select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"),
        (-F.col("col.far")).alias("score"),
    )
