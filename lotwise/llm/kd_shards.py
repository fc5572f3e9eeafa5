"""Sharding with a k-d tree over document metadata: recursive cuts at distributed weighted medians.

A node stands for a number of shards. Its rows are cut along its widest dimension, where the bytes on the left are the
left shards' part, until every node is one shard. Rows are first added up to groups of equal texts. One level cuts
all its nodes at once: groups are dealt by ranges of (node, value), running sums come from the tasks plus one offset
per task and node, and only those offsets and the nodes' extents pass through the driver.

A group that a cut falls into goes to the nearer side as a whole if it is light; a heavy one is cut by document order,
so sizes stay near equal although one text may hold a third of all rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lotwise.session import cut_lineage

SHARDS = 40
OVERHEAD = 16  # bytes a document takes beside its text
LIGHT = 0.01  # groups up to this part of a shard's bytes are not cut


def numbered(df: DataFrame, keys: list[str], order: list[str], weight: str | None, name: str) -> DataFrame:
    """`df` with column `name`: the sum of `weight` (or the count) over earlier rows of the same keys.

    Rows are dealt by ranges of (keys, order) and sorted, so no task needs a whole group; rows equal in all of these
    take any order among themselves.
    """
    shape = T.StructType([*df.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__before", T.LongType())])
    places = [df.columns.index(k) for k in keys]
    at = df.columns.index(weight) if weight else None

    def run(batches):
        task, key, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            before = []
            weights = batch.column(at).to_pylist() if weight else [1] * batch.num_rows
            for now, w in zip(zip(*(batch.column(p).to_pylist() for p in places)), weights):
                if now != key:
                    key, total = now, 0
                before.append(total)
                total += w
            yield pa.record_batch(
                [*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(before, pa.int64())],
                names=[*batch.schema.names, "__task", "__before"],
            )

    columns = [F.col(c) for c in (*keys, *order)]
    written = cut_lineage(df.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, shape), "ordered")
    sums = written.groupBy("__task", *keys).agg(F.sum(weight).alias("w") if weight else F.count("*").alias("w"))
    offsets, running = [], {}
    for row in sorted(sums.collect(), key=lambda r: r["__task"]):  # at most tasks + distinct keys rows
        key = tuple(row[k] for k in keys)
        offsets.append((row["__task"], *key, running.get(key, 0)))
        running[key] = running.get(key, 0) + row["w"]
    fields = [T.StructField("__task", T.IntegerType()), *(df.schema[k] for k in keys), T.StructField("__offset", T.LongType())]
    table = df.sparkSession.createDataFrame(offsets, T.StructType(fields))
    return (
        written.join(F.broadcast(table), ["__task", *keys])
        .withColumn(name, F.col("__before") + F.col("__offset")).drop("__task", "__before", "__offset")
    )


def cut_nodes(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Pieces (all columns of `groups`, lo, n, shard): documents lo to lo + n of a group go to the shard."""
    widths = {0: shards}  # first shard of a node -> its number of shards
    state = groups.withColumns({"lo": F.lit(0).cast("long"), "node": F.lit(0)})
    first = state.agg(*(F.max(d).alias(f"max_{d}") for d in dims), *(F.min(d).alias(f"min_{d}") for d in dims),
                      F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    span = {d: max((first[f"max_{d}"] or 0) - (first[f"min_{d}"] or 0), 1) for d in dims}
    light = LIGHT * (first["bytes"] or 0) / shards
    while any(m > 1 for m in widths.values()):
        open_nodes = [node for node, m in widths.items() if m > 1]
        extents = state.where(F.col("node").isin(open_nodes)).groupBy("node").agg(
            *(F.max(d).alias(f"max_{d}") for d in dims), *(F.min(d).alias(f"min_{d}") for d in dims),
            F.sum(F.col("n") * F.col("size")).alias("bytes"),
        ).collect()  # at most one row per shard
        plan = []
        for row in extents:
            node = row["node"]
            widest = max(range(len(dims)), key=lambda k: ((row[f"max_{dims[k]}"] - row[f"min_{dims[k]}"]) / span[dims[k]], -k))
            left = widths[node] // 2
            plan.append((node, widest, left, row["bytes"] * left // widths[node]))
        for node in open_nodes:
            left = widths[node] // 2
            widths[node], widths[node + left] = left, widths[node] - left
        if not plan:
            continue
        table = groups.sparkSession.createDataFrame(plan, "node int, axis int, left int, target long")
        columns = state.columns
        going = (
            state.join(F.broadcast(table), "node")
            .withColumns({
                "value": F.element_at(F.array(*(F.col(d).cast("double") for d in dims)), F.col("axis") + 1),
                "weight": F.col("n") * F.col("size"),
            })
        )
        summed = numbered(going, ["node"], ["value", *[d for d in dims], "lo"], "weight", "before")
        ahead = F.col("target") - F.col("before")  # bytes that still fit on the left
        whole = (F.col("weight") <= light) | (F.col("n") == 1)
        n_left = (
            F.when(F.col("weight") <= ahead, F.col("n")).when(ahead <= 0, 0)
            .when(whole, F.when(2 * ahead >= F.col("weight"), F.col("n")).otherwise(0))
            .otherwise(F.round(ahead / F.col("size")))
        ).cast("long")
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("n_left").alias("n"), F.col("node").alias("node")),
            F.struct((F.col("lo") + F.col("n_left")).alias("lo"), (F.col("n") - F.col("n_left")).alias("n"),
                     (F.col("node") + F.col("left")).alias("node")),
        )
        cut = (
            summed.withColumn("n_left", n_left).withColumn("half", F.explode(halves))
            .select(*[F.col(f"half.{c}").alias(c) if c in ("lo", "n", "node") else F.col(c) for c in columns])
            .where("n > 0")
        )
        state = cut_lineage(state.where(~F.col("node").isin(open_nodes)).unionByName(cut), "nodes")
    return state.withColumnRenamed("node", "shard")


def kd_shards(
    docs: DataFrame, shards: int = SHARDS, dims: dict[str, Column] | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 per shard, by doc_id), grown_shard
    (null). Null texts are empty, null ids come first. `dims`: integer functions of the text, by name; by default the
    size, the share of characters beyond one byte, and the checksum."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    dims = dims or {
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "wide": F.floor((F.octet_length(text) - F.char_length(text)) * 1000 / F.greatest(F.char_length(text), F.lit(1))),
        "text_crc32": F.crc32(F.encode(text, "UTF-8")),
    }
    own = {"size": (F.octet_length(text) + OVERHEAD).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    extra = {k: v.cast("long") for k, v in dims.items() if k not in own}
    rows = cut_lineage(
        docs.select(docs[id_col].cast("long").alias("doc_id"), *(v.alias(k) for k, v in {**own, **extra}.items())), "sizes"
    )
    key = ["size", "text_crc32", *extra]
    groups = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("n")), "groups")
    pieces = cut_nodes(groups, list(dims), shards)
    # written first, so that a frequent text's rows can be split among tasks of the join
    homes = cut_lineage(
        pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("lo", "n", "shard"))).alias("homes")), "pieces"
    )
    placed = cut_lineage(rows.join(homes, key), "homes")
    whole = placed.where(F.size("homes") == 1).withColumn("shard", F.col("homes")[0]["shard"])
    cut = numbered(placed.where(F.size("homes") > 1), key, ["doc_id"], None, "rank")  # at most one group per cut
    cut = cut.withColumn(
        "shard", F.filter("homes", lambda h: (h["lo"] <= F.col("rank")) & (F.col("rank") < h["lo"] + h["n"]))[0]["shard"]
    )
    wanted = ["doc_id", "size", "text_crc32", "shard"]
    both = whole.select(*wanted).unionByName(cut.select(*wanted))
    return numbered(both, ["shard"], ["doc_id", "text_crc32"], None, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
