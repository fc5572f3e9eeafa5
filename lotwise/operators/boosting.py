"""Boosted regression trees with L1 and L2 leaf penalties, rows and columns sampled per tree.

Features are cut into bins once. A tree grows level by level: every task adds up the gradients of its rows by (node, bin),
leaving out each feature's most frequent bin, whose sums are what the others leave of the node's; the tasks' sums meet by
node, are added up in the order of the tasks and ranked there, and only the best split of every node reaches the driver.
Several settings grow side by side, each one level further with every pass over the rows, and share the bins. The
predictions so far are written every few trees; the trees since then travel to the tasks.

A pass costs some tenths of a second however few the rows, and a setting takes thousands. While the binned rows have at most
GATHER_BYTES, they are therefore broadcast, as the small side of a join would be, and each setting grows to its end in a task
of its own; the trees are the same but for the last digits of the sums.

With G the sum of the gradients of the squared loss and N the rows of a node, T(G) = sign(G) * max(|G| - alpha, 0), the
leaf value is -T(G) / (N + lambda), and a split gains T(Gl)^2 / (Nl + lambda) + T(Gr)^2 / (Nr + lambda) - T(G)^2 / (N + lambda).
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from lotwise.session import cut_lineage, spread, tasks_for

MAX_BINS = 256
LEAST_ROWS = 1  # of either side of a split
WRITE_TREES = 20  # trees of a setting after which the predictions are written
WRITE_WORK = 10_000_000  # rows times trees not written, one a setting at least, after which they are written sooner
GATHER_BYTES = 64 << 20  # of binned rows that are broadcast, and of a level's sums; beyond, settings grow by passes
CHUNK = 1 << 16  # rows of a broadcast table that are added up at a time
SAME_GAIN = 10  # digits to which gains, as shares of the node's best, are told apart; the first feature and bin win ties


def bin_edges(df: DataFrame, features: str, max_bins: int) -> list[list[float]]:
    """Per feature its ascending cuts, at most max_bins - 1; a value belongs left of a cut it does not exceed.

    A feature with no more than max_bins values has a cut between any two; others are cut at approximate quantiles.
    """
    cells = df.select(F.posexplode(vector_to_array(features)).alias("f", "x")).where(~F.isnan("x"))
    ranks = [k / max_bins for k in range(1, max_bins)]
    found = cells.groupBy("f").agg(
        F.approx_count_distinct("x", 0.02).alias("n"), F.percentile_approx("x", ranks, 20_000).alias("cuts")
    ).collect()
    width = max((r["f"] for r in found), default=-1) + 1
    edges: list[list[float]] = [[] for _ in range(width)]
    for r in found:
        edges[r["f"]] = sorted(set(r["cuts"]))
    few = [r["f"] for r in found if r["n"] <= 1.2 * max_bins]
    sets = cells.where(F.col("f").isin(few)).distinct().groupBy("f").agg(F.count("x").alias("n"), F.sort_array(F.collect_list("x")).alias("v"))
    for r in sets.where(F.col("n") <= max_bins).collect():
        edges[r["f"]] = [(a + b) / 2 for a, b in zip(r["v"], r["v"][1:])]
    return edges


def bin_bytes(flat: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A byte for each row and feature."""
    x = np.asarray(flat).reshape(-1, len(cuts))
    bins = np.empty(x.shape, np.uint8)
    for f, cut in enumerate(cuts):
        bins[:, f] = np.searchsorted(cut, x[:, f])  # not a number: the last bin
    return bins


def binned(df: DataFrame, label: str, features: str, edges: list[list[float]], settings: int, start: list[float]) -> DataFrame:
    """(row, y, bins, preds): a byte per feature, and the starting prediction of every setting."""
    cuts = [np.array(e) for e in edges]

    def run(batches):
        for batch in batches:
            bins = bin_bytes(batch.column(2).flatten(), cuts)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bins], pa.binary())], names=["row", "y", "bins"]
            )

    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x")
    ).where("y IS NOT NULL AND NOT isnan(y)")
    preds = F.array(*[F.lit(s) for s in start])
    return cut_lineage(rows.mapInArrow(run, "row long, y double, bins binary").withColumn("preds", preds), "bins")


def mixed(rows: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) of the rows, other ones for every salt."""
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 0xD1342543DE82EF95 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z ^ z >> np.uint64(31)) / 2.0**64


class Tree:
    """Nodes in heap order (children of i are 2i + 1 and 2i + 2): feature (-1: leaf), last bin of the left side, value."""

    def __init__(self, depth: int, value: float = 0.0):
        size = 2 ** (depth + 1) - 1
        self.feature, self.bin = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.value, self.rows = np.zeros(size), np.zeros(size)
        self.value[0] = value

    def route(self, levels: int) -> tuple[np.ndarray, ...]:
        """(feature, last left bin, value, open) by node for a walk of so many levels that never asks for leaves: rows of a
        leaf keep to the left and take its value with them; nodes below a leaf are not open."""
        feature, cut, value = np.maximum(self.feature, 0).astype(np.int64), np.where(self.feature < 0, 255, self.bin).astype(np.uint8), self.value.copy()
        is_open = np.ones(len(value), bool)
        for level in range(levels):
            nodes = np.arange(2**level - 1, 2 ** (level + 1) - 1)
            closed = nodes[self.feature[nodes] < 0]
            value[2 * closed + 1] = value[closed]
            is_open[2 * closed + 1] = is_open[2 * closed + 2] = False
            shut = nodes[~is_open[nodes]]
            is_open[2 * shut + 1] = is_open[2 * shut + 2] = False
        return feature, cut, value, is_open


def walk(flat: np.ndarray, lead: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of every row after so many levels; `flat` holds the bins row by row, `lead` where each row's begin."""
    at = np.zeros(len(lead), np.int64)
    for _ in range(levels):
        goes = flat.take(lead + feature.take(at)) > cut.take(at)
        at += at
        at += 1
        at += goes
    return at


class Growth:
    """One setting on its way: finished trees, the one that grows, its level."""

    def __init__(self, number: int, params: dict, width: int):
        self.number, self.params, self.width = number, params, width
        self.trees: list[Tree] = []
        self.written, self.done = 0, False
        self.next_tree()

    def next_tree(self) -> None:
        if len(self.trees) == self.params["n_estimators"] or not self.width:
            self.done = True
            return
        self.tree, self.level = Tree(self.params["max_depth"]), 0
        rng = np.random.default_rng([self.params["seed"], len(self.trees)])
        n = max(1, int(self.params["colsample_bytree"] * self.width + 1e-9))
        self.columns = np.sort(rng.permutation(self.width)[:n])

    def waiting(self) -> list[tuple]:
        """Routes through the trees whose predictions are not written. Broadcasts carry no class of this package."""
        return [t.route(len(t.value).bit_length() - 1) for t in self.trees[self.written :]]

    def task(self) -> tuple:
        """What the tasks need for the next pass."""
        p = self.params
        return (
            self.number, p["learning_rate"], p["subsample"], p["seed"] * 100_003 + len(self.trees),
            self.waiting(), self.tree.route(self.level), self.level, self.columns,
        )

    def take(self, splits: list) -> None:
        """One level further with the best splits (node, total G, N, feature, bin, left G, N)."""
        leaf = lambda g, n: -np.sign(g) * max(abs(g) - self.params["reg_alpha"], 0.0) / (n + self.params["reg_lambda"])
        grew = False
        for s in splits:
            node = s["node"]
            if node == 0:
                self.tree.value[0], self.tree.rows[0] = leaf(s["G"], s["N"]), s["N"]
            if s["feature"] is None:
                continue
            grew = True
            self.tree.feature[node], self.tree.bin[node] = s["feature"], s["bin"]
            for child, g, n in ((2 * node + 1, s["gl"], s["nl"]), (2 * node + 2, s["G"] - s["gl"], s["N"] - s["nl"])):
                self.tree.value[child], self.tree.rows[child] = leaf(g, n), n
        self.level += 1
        if not grew or self.level == self.params["max_depth"]:
            self.trees.append(self.tree)
            self.next_tree()


def predictions(flat: np.ndarray, lead: np.ndarray, start: np.ndarray, rate: float, routes: list[tuple]) -> np.ndarray:
    out = start.copy()
    for feature, cut, value, _ in routes:
        out += rate * value.take(walk(flat, lead, feature, cut, len(value).bit_length() - 1))
    return out


def _matrix(batch: pa.RecordBatch, width: int, settings: int) -> tuple[np.ndarray, ...]:
    """(row, y, bins row by row, where each row's bins begin, preds)."""
    rows, y = (np.asarray(batch.column(k)) for k in (0, 1))
    flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
    return rows, y, flat, np.arange(len(y)) * width, np.asarray(batch.column(3).flatten()).reshape(-1, settings)


def common_bins(rows: DataFrame, offsets: np.ndarray, settings: int) -> np.ndarray:
    """The most frequent bin of every feature, the first on ties."""
    width, slots = len(offsets) - 1, int(offsets[-1])

    def run(batches):
        count = np.zeros(slots, np.int64)
        for batch in batches:
            if batch.num_rows:
                flat = _matrix(batch, width, settings)[2]
                count += np.bincount((flat.reshape(-1, width) + offsets[:-1]).ravel(), minlength=slots)
        yield pa.record_batch([pa.array(np.arange(slots, dtype=np.int32)), pa.array(count)], names=["slot", "n"])

    found = np.zeros(slots, np.int64)
    for r in rows.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row for each cut
        found[r["slot"]] = r["n"]
    return np.array([found[a:b].argmax() for a, b in zip(offsets, offsets[1:])], np.uint8)


def gradient_sums(rows: DataFrame, tasks: list[tuple], offsets: np.ndarray, common: np.ndarray, settings: int) -> DataFrame:
    """(setting, node, part, G, N, slots, gs, ns): a row for each task and node with its totals and the sums of the slots that
    are met, but for the common bins. A slot is a bin of a feature, counted through."""
    width, slots = len(offsets) - 1, int(offsets[-1])
    shared = rows.sparkSession.sparkContext.broadcast(tasks)  # trees of WRITE_TREES rounds at most for each setting

    def run(batches):
        part, sums = TaskContext.get().partitionId(), {}
        for setting, *_, level, _ in shared.value:
            size = 2**level * slots
            sums[setting] = np.zeros(size), np.zeros(size), np.zeros(2**level), np.zeros(2**level)
        for batch in batches:
            if not batch.num_rows:
                continue
            number, y, flat, lead, preds = _matrix(batch, width, settings)
            bins = flat.reshape(-1, width)
            other = bins != common
            row, feature = np.nonzero(other)
            slot = offsets[feature] + bins[other]
            for setting, rate, subsample, salt, finished, (by, cut, _, is_open), level, _ in shared.value:
                nodes = 2**level
                at = walk(flat, lead, by, cut, level)
                use = is_open.take(at)  # rows in leaves of upper levels are done
                if subsample < 1:
                    use &= mixed(number, salt) < subsample
                g = predictions(flat, lead, preds[:, setting], rate, finished) - y
                at = np.where(use, at - (nodes - 1), nodes)  # rows out of use go to a node past the last
                total, count, every, n = sums[setting]
                place = at.take(row) * slots + slot
                total += np.bincount(place, g.take(row), (nodes + 1) * slots)[: nodes * slots]
                count += np.bincount(place, minlength=(nodes + 1) * slots)[: nodes * slots]
                every += np.bincount(at, g, nodes + 1)[:nodes]
                n += np.bincount(at, minlength=nodes + 1)[:nodes]
        for setting, (total, count, every, n) in sums.items():
            out = []
            for node in np.flatnonzero(n).tolist():
                own = slice(node * slots, (node + 1) * slots)
                met = np.flatnonzero(count[own])
                out.append((setting, node + len(n) - 1, part, every[node], n[node], met.astype(np.int32).tobytes(), total[own][met].tobytes(), count[own][met].tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), SUMS.values())], names=list(SUMS))

    return rows.mapInArrow(run, "setting int, node int, part int, G double, N double, slots binary, gs binary, ns binary")


SUMS = {
    "setting": pa.int32(), "node": pa.int32(), "part": pa.int32(), "G": pa.float64(), "N": pa.float64(), "slots": pa.binary(), "gs": pa.binary(),
    "ns": pa.binary(),
}
SPLITS = {
    "setting": pa.int32(), "node": pa.int32(), "G": pa.float64(), "N": pa.float64(), "feature": pa.int32(), "bin": pa.int32(), "gl": pa.float64(),
    "nl": pa.float64(),
}


def best_split(
    g: np.ndarray, n: np.ndarray, whole_g: float, whole_n: float, columns: np.ndarray, alpha: float, lam: float
) -> tuple[int, int, float, float] | None:
    """(feature, bin, left g, left n) of the largest gain, from the sums by feature and bin; None without any gain."""

    def score(g, n):
        kept = np.maximum(np.abs(g) - alpha, 0.0)
        return np.divide(kept * kept, n + lam, out=np.full(np.shape(g), np.nan), where=n + lam != 0)

    gl, nl = np.cumsum(g, axis=1), np.cumsum(n, axis=1)
    parts, whole = score(gl, nl) + score(whole_g - gl, whole_n - nl), score(whole_g, whole_n)
    able = (n > 0) & (nl >= LEAST_ROWS) & (whole_n - nl >= LEAST_ROWS)
    usable = np.zeros(len(g), bool)
    usable[columns] = True
    able &= usable[:, None]
    able &= parts > whole
    if not able.any():
        return None
    gain = np.where(able, parts - whole, -np.inf)
    f, b = np.unravel_index(np.argmax(np.round(gain / gain.max(), SAME_GAIN)), gain.shape)
    return int(f), int(b), float(gl[f, b]), float(nl[f, b])


def best_splits(sums: DataFrame, tasks: list[tuple], penalties: list[tuple[float, float]], offsets: np.ndarray, common: np.ndarray) -> DataFrame:
    """Per (setting, node) its totals G and N and its best split (nulls without one): feature, bin, left gl and nl."""
    width, longest = len(offsets) - 1, int(np.diff(offsets).max())
    feature = np.repeat(np.arange(width), np.diff(offsets))
    cell = feature * longest + np.arange(offsets[-1]) - offsets[feature]  # of a slot, in rows of features
    rest = np.arange(width) * longest + common
    columns = {t[0]: t[7] for t in tasks}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")  # sums do not depend on which task came first
        slot, g, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("slots", np.int32), ("gs", float), ("ns", float)))
        whole_g, whole_n = (float(table.column(c).to_numpy().sum()) for c in ("G", "N"))
        g, n = (np.bincount(cell[slot], x, width * longest) for x in (g, n))
        g[rest] = whole_g - g.reshape(width, longest).sum(axis=1)
        n[rest] = whole_n - n.reshape(width, longest).sum(axis=1)
        setting, node = (table.column(c)[0].as_py() for c in ("setting", "node"))
        found = best_split(g.reshape(width, longest), n.reshape(width, longest), whole_g, whole_n, columns[setting], *penalties[setting])
        row = (setting, node, whole_g, whole_n, *(found or (None,) * 4))
        return pa.table({name: pa.array([v], kind) for v, (name, kind) in zip(row, SPLITS.items())})

    return sums.groupBy("setting", "node").applyInArrow(
        run, "setting int, node int, G double, N double, feature int, bin int, gl double, nl double"
    )


class Gathered:
    """Binned rows in one task: the slots that are met, but for the common bins, in as many lists as a row has at most.

    Slots are counted through; a row with fewer of them than others has the slot past the last in the rest of its lists.
    """

    def __init__(self, row: np.ndarray, y: np.ndarray, bins: np.ndarray, offsets: np.ndarray):
        first = np.argsort(row, kind="stable")
        self.row, self.y, self.bins, self.offsets = row[first], y[first], bins[first], offsets
        self.width, self.slots = bins.shape[1], int(offsets[-1])
        self.common = np.array([np.bincount(self.bins[:, f]).argmax() for f in range(self.width)], np.uint8)
        spans = [slice(a, a + CHUNK) for a in range(0, len(self.row), CHUNK)]
        most = max(int((self.bins[s] != self.common).sum(axis=1).max()) for s in spans)
        kind = np.uint16 if self.slots < 1 << 16 else np.int32
        self.met = np.full((most, len(self.row)), self.slots, kind)
        for s in spans:
            row, feature = np.nonzero(self.bins[s] != self.common)
            begin = np.searchsorted(row, row)  # rows ascend
            self.met[np.arange(len(row)) - begin, row + s.start] = offsets[feature] + self.bins[s][row, feature]
        self.cut = np.setdiff1d(np.arange(self.slots), offsets[1:] - 1)  # a feature's last bin ends no left side
        self.of = np.repeat(np.arange(self.width), np.diff(offsets))

    def sums(self, part: slice, at: np.ndarray, g: np.ndarray, nodes: int) -> tuple[np.ndarray, ...]:
        """G and N of these rows by (node, slot) and by node; rows of the node past the last are out of use."""
        size = (nodes + 1) * (self.slots + 1)
        total, count, lead = np.zeros(size), np.zeros(size), at * (self.slots + 1)
        for met in self.met:
            place = lead + met[part]
            total += np.bincount(place, g, size)
            count += np.bincount(place, minlength=size)
        by = (x.reshape(nodes + 1, -1)[:nodes, :-1] for x in (total, count))
        return *by, np.bincount(at, g, nodes + 1)[:nodes], np.bincount(at, minlength=nodes + 1)[:nodes]

    def splits(self, sums: list[np.ndarray], columns: np.ndarray, alpha: float, lam: float) -> list[np.ndarray]:
        """What `best_split` finds for the nodes of a level: (nodes with a split, feature, bin, left g, left n)."""
        step = max(1, (1 << 20) // self.slots)
        some = [(a, self.some_splits(*[x[a : a + step] for x in sums], columns, alpha, lam)) for a in range(0, len(sums[2]), step)]
        return [np.concatenate(x) for x in zip(*[(a + nodes, *found) for a, (nodes, *found) in some])]

    def some_splits(self, g: np.ndarray, n: np.ndarray, whole_g: np.ndarray, whole_n: np.ndarray, columns: np.ndarray, alpha: float, lam: float):
        lead, rest = self.offsets[:-1], self.offsets[:-1] + self.common
        for x, whole in ((g, whole_g), (n, whole_n)):
            x[:, rest] = 0
            x[:, rest] = whole[:, None] - np.add.reduceat(x, lead, axis=1)
        met = n > 0
        for f in np.flatnonzero(np.diff(self.offsets) > 2):
            own = slice(self.offsets[f], self.offsets[f + 1])
            g[:, own], n[:, own] = np.cumsum(g[:, own], axis=1), np.cumsum(n[:, own], axis=1)
        cut = self.cut[np.isin(self.of[self.cut], columns)]
        gl, nl, whole_g, whole_n = g[:, cut], n[:, cut], whole_g[:, None], whole_n[:, None]

        def score(g, n):
            kept = np.maximum(np.abs(g) - alpha, 0.0)
            kept *= kept
            return np.divide(kept, n + lam, out=np.full(kept.shape, np.nan), where=n + lam != 0)

        parts, whole = score(gl, nl) + score(whole_g - gl, whole_n - nl), score(whole_g, whole_n)
        able = met[:, cut] & (nl >= LEAST_ROWS) & (whole_n - nl >= LEAST_ROWS) & (parts > whole)
        nodes = np.flatnonzero(able.any(axis=1))
        if not len(nodes):
            return (nodes,) * 5
        gain = np.where(able, parts - whole, -np.inf)[nodes]
        best = np.argmax(np.round(gain / gain.max(axis=1)[:, None], SAME_GAIN), axis=1)
        slot = cut[best]
        return nodes, self.of[slot], slot - self.offsets[self.of[slot]], gl[nodes, best], nl[nodes, best]

    def tree(self, params: dict, number: int, pred: np.ndarray) -> tuple[Tree, list[tuple], np.ndarray]:
        """The next tree, its levels (feature and last left bin by node) and the values of the nodes that they lead to, as
        `down` takes them. The predictions go on by it."""
        alpha, lam = float(params["reg_alpha"]), float(params["reg_lambda"])
        leaf = lambda g, n: -np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) / (n + lam)
        rng = np.random.default_rng([params["seed"], number])
        columns = np.sort(rng.permutation(self.width)[: max(1, int(params["colsample_bytree"] * self.width + 1e-9))])
        tree, levels, is_open, value = Tree(params["max_depth"]), [], np.ones(1, bool), np.zeros(1)
        at, grad, drawn = np.zeros(len(pred), np.int64), pred - self.y, np.ones(len(pred), bool)
        if params["subsample"] < 1:
            drawn = mixed(self.row, params["seed"] * 100_003 + number) < params["subsample"]
        for level in range(params["max_depth"]):
            nodes, sums = 2**level, None
            step = max(CHUNK, 2 * nodes * self.slots)  # the sums are no larger than what is added up to them
            for a in range(0, len(pred), step):
                part = slice(a, a + step)
                if levels:
                    at[part] = below(self.bins[part], at[part], *levels[-1])
                use = is_open.take(at[part]) & drawn[part]
                more = self.sums(part, np.where(use, at[part], nodes), grad[part], nodes)
                sums = more if sums is None else [x + y for x, y in zip(sums, more)]
            whole_g, whole_n = sums[2:]
            if not level and whole_n[0]:
                value = leaf(whole_g, whole_n)
                tree.value[0], tree.rows[0] = value[0], whole_n[0]
            split, feature, last, gl, nl = self.splits(sums, columns, alpha, lam)
            if not len(split):
                break
            by, cut, is_open = np.zeros(nodes, np.int64), np.full(nodes, 255, np.uint8), np.zeros(2 * nodes, bool)
            by[split], cut[split], is_open[2 * split], is_open[2 * split + 1] = feature, last, True, True
            heap, value = split + nodes - 1, np.repeat(value, 2)  # rows of a leaf keep to the left and take its value along
            tree.feature[heap], tree.bin[heap] = feature, last
            for side, gs, ns in ((0, gl, nl), (1, whole_g[split] - gl, whole_n[split] - nl)):
                value[2 * split + side] = tree.value[2 * heap + 1 + side] = leaf(gs, ns)
                tree.rows[2 * heap + 1 + side] = ns
            levels.append((by, cut))
        behind = levels[-1:] if len(levels) == params["max_depth"] else []
        for a in range(0, len(pred), CHUNK):
            part = slice(a, a + CHUNK)
            pred[part] += params["learning_rate"] * value.take(down(self.bins[part], at[part], behind))
        return tree, levels, value


def below(bins: np.ndarray, at: np.ndarray, by: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The nodes of rows one level further down, numbered within their level."""
    lead = np.arange(len(at)) * bins.shape[1]
    return 2 * at + (bins.ravel().take(lead + by.take(at)) > cut.take(at))


def down(bins: np.ndarray, at: np.ndarray, levels: list[tuple]) -> np.ndarray:
    for by, cut in levels:
        at = below(bins, at, by, cut)
    return at


def packed(df: DataFrame, label: str, features: str, edges: list[list[float]], held: bool) -> DataFrame:
    """(held, rows, ys, bins): a row for each batch, its numbers packed. Rows that are held may have no number for a label."""
    cuts = [np.array(e) for e in edges]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = (np.asarray(batch.column(0)), np.asarray(batch.column(1)), bin_bytes(batch.column(2).flatten(), cuts))
                yield pa.record_batch([pa.array([held]), *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names=["held", "rows", "ys", "bins"])

    rows = df.select(
        F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("y"), vector_to_array(features).alias("x")
    ).where("y IS NOT NULL" if held else "y IS NOT NULL AND NOT isnan(y)")
    return rows.mapInArrow(run, "held boolean, rows binary, ys binary, bins binary")


TREES = {"setting": pa.int32(), "tree": pa.int32(), "feature": pa.binary(), "bin": pa.binary(), "value": pa.binary(), "rows": pa.binary()}
SCORED = {"setting": pa.int32(), "y": pa.float64(), "prediction": pa.float64()}


def grow_alone(blocks: DataFrame, settings: list[dict], offsets: np.ndarray, mean: float, scored: bool) -> DataFrame:
    """A task for each setting, over all packed rows: its trees, or with `scored` its predictions for the rows that are held.
    Those with most to do come first."""
    order = sorted(range(len(settings)), key=lambda i: -settings[i]["n_estimators"] * settings[i]["max_depth"])
    names, width = SCORED if scored else TREES, len(offsets) - 1

    def joined(blocks):
        rows, ys, bins = (b"".join(b[k].as_py() for b in blocks) for k in ("rows", "ys", "bins"))
        return np.frombuffer(rows, np.int64), np.frombuffer(ys), np.frombuffer(bins, np.uint8).reshape(-1, width)

    def run(batches):
        blocks: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for place, held, *cells in zip(*batch.columns):
                blocks.setdefault(place.as_py(), ([], []))[held.as_py()].append(dict(zip(("rows", "ys", "bins"), cells)))
        for place, (fit, held) in blocks.items():
            params, data, (_, y, bins) = settings[order[place]], Gathered(*joined(fit), offsets), joined(held)
            pred, out = np.full(len(data.y), mean), np.full(len(y), mean)
            for number in range(params["n_estimators"]):
                tree, levels, value = data.tree(params, number, pred)
                if not scored:
                    cells = (a.tobytes() for a in (tree.feature, tree.bin, tree.value, tree.rows))
                    yield pa.record_batch([pa.array([v], kind) for v, kind in zip((order[place], number, *cells), names.values())], names=list(names))
                for a in range(0, len(out), CHUNK):
                    part = bins[a : a + CHUNK]
                    out[a : a + CHUNK] += params["learning_rate"] * value.take(down(part, np.zeros(len(part), np.int64), levels))
            for a in range(0, len(out), CHUNK):
                n = len(out[a : a + CHUNK])
                yield pa.record_batch([pa.array([order[place]] * n, pa.int32()), pa.array(y[a : a + CHUNK]), pa.array(out[a : a + CHUNK])], names=list(names))

    tasks = blocks.sparkSession.range(0, len(settings), 1, len(settings))
    kinds = {pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary"}
    schema = ", ".join(f"{name} {kinds[kind]}" for name, kind in names.items())
    return tasks.crossJoin(F.broadcast(blocks)).mapInArrow(run, schema)


def label_mean(df: DataFrame, label: str) -> tuple[float | None, int]:
    """Mean and number of the known labels, added up in the order of the tasks."""
    known = F.nanvl(F.col(label).cast("double"), F.lit(None))
    parts = df.groupBy(F.spark_partition_id()).agg(F.sum(known).alias("s"), F.count(known).alias("n")).where("n > 0").collect()
    n_rows = sum(p["n"] for p in parts)  # a row for each task
    return (math.fsum(p["s"] for p in parts) / n_rows if n_rows else None), n_rows


def grow(
    df: DataFrame, label: str, settings: list[dict], features: str = "features", max_bins: int = MAX_BINS
) -> list[BoostedTrees]:
    """One model for each setting (n_estimators, learning_rate, max_depth, subsample, colsample_bytree, reg_alpha,
    reg_lambda, seed), all grown over the same bins and passes. Without rows a model predicts null."""
    return _by_passes(*_measured(df, label, features, max_bins), label, settings, features)


def fit(
    df: DataFrame, label: str, settings: list[dict], features: str = "features", max_bins: int = MAX_BINS
) -> list[BoostedTrees]:
    """As `grow`, but each setting in a task of its own while the rows are few enough to be broadcast."""
    df, edges, mean, n_rows = _measured(df, label, features, max_bins)
    if not _can_gather(n_rows, edges, settings):
        return _by_passes(df, edges, mean, n_rows, label, settings, features)
    grown: list[list[Tree]] = [[] for _ in settings]
    kinds = {"feature": np.int32, "bin": np.int32, "value": float, "rows": float}
    found = grow_alone(packed(df, label, features, edges, False), settings, _offsets(edges), mean, False)
    for row in found.collect():  # what the models consist of
        tree = Tree(settings[row["setting"]]["max_depth"])
        for name, kind in kinds.items():
            setattr(tree, name, np.frombuffer(row[name], kind))
        grown[row["setting"]].append(tree)
    return [BoostedTrees(features, _plain(mean, s["learning_rate"], trees, edges)) for s, trees in zip(settings, grown)]


def fit_and_score(
    df: DataFrame, held: DataFrame, label: str, settings: list[dict], features: str = "features", max_bins: int = MAX_BINS
) -> DataFrame | None:
    """(setting, y, prediction): the held rows that have a label under a model of each setting; no model reaches the driver.
    None where there are no rows to fit or too many to be broadcast."""
    df, edges, mean, n_rows = _measured(df, label, features, max_bins)
    if not _can_gather(n_rows + held.count(), edges, settings) or not n_rows:
        return None
    blocks = packed(df, label, features, edges, False).union(packed(held, label, features, edges, True))
    return grow_alone(blocks, settings, _offsets(edges), mean, True)


def _can_gather(n_rows: int, edges: list[list[float]], settings: list[dict]) -> bool:
    """Whether the binned rows, and the sums of the deepest level, are few enough for one task."""
    cells = 2 ** max(s["max_depth"] for s in settings) * int(_offsets(edges)[-1])
    return n_rows > 0 and bool(edges) and max(n_rows * (len(edges) + 16), 8 * cells) <= GATHER_BYTES


def _offsets(edges: list[list[float]]) -> np.ndarray:
    """The first slot of every feature, and the number of slots."""
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])]).astype(np.int64)


def _measured(df: DataFrame, label: str, features: str, max_bins: int) -> tuple[DataFrame, list[list[float]], float | None, int]:
    """The rows spread over the cores, their edges, the mean of the labels and their number."""
    if not 2 <= max_bins <= 256:
        raise ValueError("a bin is one byte")
    df = spread(df)
    edges = bin_edges(df, features, max_bins)
    return df, edges, *label_mean(df, label)


def _by_passes(
    df: DataFrame, edges: list[list[float]], mean: float | None, n_rows: int, label: str, settings: list[dict], features: str
) -> list[BoostedTrees]:
    if not n_rows:
        return [BoostedTrees(features, json.dumps({"start": None, "rate": 1.0, "trees": []})) for _ in settings]
    tasks = tasks_for(df.sparkSession, n_rows)

    def in_order(rows: DataFrame) -> DataFrame:
        """Kept by row, so that sums add up in the same order in every fit."""
        return rows.repartition(tasks, "row").sortWithinPartitions("row").persist()

    held = in_order(binned(df, label, features, edges, len(settings), [mean] * len(settings)))
    offsets = _offsets(edges)
    penalties = [(float(s["reg_alpha"]), float(s["reg_lambda"])) for s in settings]
    growing = [Growth(i, s, len(edges)) for i, s in enumerate(settings)]
    try:
        common = common_bins(held, offsets, len(settings)) if edges else None
        while open_ones := [g for g in growing if not g.done]:
            waiting = [len(g.trees) - g.written for g in growing]
            if max(waiting) >= WRITE_TREES or sum(waiting) >= max(len(growing), WRITE_WORK / n_rows):
                new = in_order(cut_lineage(_advanced(held, growing, len(edges)), "boosting"))
                held.unpersist()
                held = new
                for g in growing:
                    g.written = len(g.trees)
            wanted = [g.task() for g in open_ones]
            sums = gradient_sums(held, wanted, offsets, common, len(settings))
            splits: dict[int, list] = {g.number: [] for g in open_ones}
            for row in best_splits(sums, wanted, penalties, offsets, common).collect():  # a row for each open node
                splits[row["setting"]].append(row)
            for g in open_ones:
                g.take(splits[g.number])
    finally:
        held.unpersist()
    return [BoostedTrees(features, _plain(mean, g.params["learning_rate"], g.trees, edges)) for g in growing]


def _advanced(rows: DataFrame, growing: list[Growth], width: int) -> DataFrame:
    """The rows with all finished trees in their predictions."""
    shared = rows.sparkSession.sparkContext.broadcast([(g.params["learning_rate"], g.waiting()) for g in growing])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, _, flat, lead, preds = _matrix(batch, width, len(shared.value))
                preds = np.stack([predictions(flat, lead, preds[:, i], rate, trees) for i, (rate, trees) in enumerate(shared.value)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, preds.size + 1, preds.shape[1], dtype=np.int32)), pa.array(preds.ravel()))
                yield pa.record_batch([*batch.columns[:3], lists], names=["row", "y", "bins", "preds"])

    return rows.mapInArrow(run, "row long, y double, bins binary, preds array<double>")


def _plain(mean: float, rate: float, grown: list[Tree], edges: list[list[float]]) -> str:
    """A model as text: per tree its nodes in heap order (feature, threshold, value, rows), leaves with feature -1."""
    trees = []
    for tree in grown:
        cut = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature.tolist(), tree.bin.tolist())]
        trees.append([tree.feature.tolist(), cut, tree.value.tolist(), tree.rows.tolist()])
    return json.dumps({"start": mean, "rate": rate, "trees": trees})


class _Features(Params):
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)


class BoostedTrees(Model, _Features, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds `prediction`. Saves and loads like any pipeline stage."""

    trees = Param(Params._dummy(), "trees", "start, rate and trees as text", TypeConverters.toString)

    def __init__(self, featuresCol: str = "features", trees: str = ""):
        super().__init__()
        self._set(featuresCol=featuresCol, trees=trees)

    def plain(self) -> dict:
        return json.loads(self.getOrDefault("trees"))

    def heaps(self) -> list[dict]:
        """Per tree its nodes in use, by heap number: (left, right, value, rows, feature, threshold)."""
        out = []
        for feature, cut, value, rows in self.plain()["trees"]:
            nodes, queue = {}, [0]
            for i in queue:
                inner = feature[i] >= 0
                nodes[i] = (2 * i + 1 if inner else -1, 2 * i + 2 if inner else -1, value[i], rows[i], feature[i], cut[i])
                queue += [2 * i + 1, 2 * i + 2] if inner else []
            out.append(nodes)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        model = self.plain()
        if model["start"] is None:
            return df.withColumn("prediction", F.lit(None).cast("double"))
        arrays = [tuple(np.array(a) for a in tree[:3]) for tree in model["trees"]]
        shared = df.sparkSession.sparkContext.broadcast((model["start"], model["rate"], arrays))

        @F.pandas_udf("double")
        def predict(vectors: pd.Series) -> pd.Series:
            start, rate, trees = shared.value
            out = np.full(len(vectors), start)
            if len(vectors):
                x = np.stack(vectors.to_numpy()).astype(float)
                every = np.arange(len(x))
                for feature, cut, value in trees:
                    at = np.zeros(len(x), np.int64)
                    for _ in range(len(feature).bit_length() - 1):
                        f = feature[at]
                        with np.errstate(invalid="ignore"):
                            goes = 2 * at + 2 - (x[every, np.maximum(f, 0)] <= cut[at])
                        at = np.where(f >= 0, goes, at)
                    out += rate * value[at]
            return pd.Series(out)

        return df.withColumn("prediction", predict(vector_to_array(self.getOrDefault("featuresCol"))))


class PenalisedBoosting(Estimator, _Features):
    """Boosted trees with leaf penalties; row and column shares are drawn per tree."""

    @keyword_only
    def __init__(
        self, *, labelCol: str, featuresCol: str = "features", n_estimators: int = 300, learning_rate: float = 0.05, max_depth: int = 6,
        subsample: float = 0.8, colsample_bytree: float = 0.8, reg_alpha: float = 0.0, reg_lambda: float = 1.0, seed: int = 42,
        max_bins: int = MAX_BINS,
    ):
        super().__init__()
        self._set(featuresCol=featuresCol)
        self.label, self.max_bins = labelCol, max_bins
        self.setting = {
            "n_estimators": n_estimators, "learning_rate": learning_rate, "max_depth": max_depth, "subsample": subsample,
            "colsample_bytree": colsample_bytree, "reg_alpha": reg_alpha, "reg_lambda": reg_lambda, "seed": seed,
        }

    def _fit(self, df: DataFrame) -> BoostedTrees:
        return fit(df, self.label, [self.setting], self.getOrDefault("featuresCol"), self.max_bins)[0]
