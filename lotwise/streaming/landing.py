"""Incremental landing of page files with each link kept once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lotwise.functions.text import collected_at
from lotwise.operators.dedup import keep_first
from lotwise.schemas import RAW_LISTINGS

ARRIVAL = "_chegada"
FOLDERS = 64  # hash folders of the landed keys
FAN = 16  # sets of keys of that many batches become one


def with_arrival(stream: DataFrame) -> DataFrame:
    """A file stream with the place each row was read from, straight after the read."""
    place = F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    return stream.withColumn(ARRIVAL, place)


def listing_stream(spark: SparkSession, folder: str, glob: str = "*_pagina*.csv", per_batch: int = 1000) -> DataFrame:
    """New page files as a stream of raw listings with a collection time."""
    pages = (
        spark.readStream.schema(RAW_LISTINGS)
        .option("header", True)
        .option("escape", '"')
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_batch)
        .csv(folder)
    )
    return with_arrival(pages).withColumn("coletado", collected_at(F.col("data_coleta")))


def canonical_sets(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(first batch, number of batches) of the sets that hold the batches before this one: the digits of its number."""
    size, out, start = 1, [], 0
    while size * fan <= batches:
        size *= fan
    while size:
        while start + size <= batches:
            out.append((start, size))
            start += size
        size //= fan
    return out


class LandedKeys:
    """Keys landed so far, in sets of batches; each set is laid out in folders by the keys' hash.

    A batch reads only the folders its own keys fall into. Sets are merged once their batches are done, so a batch opens
    at most some FAN sets for each digit of its number. A set that a stopped run left half-written is written again.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], folders: int = FOLDERS, fan: int = FAN):
        self.spark, self.path, self.keys, self.folders, self.fan = spark, path.rstrip("/"), keys, folders, fan

    def folder(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.folders)).cast("int")

    def place(self, start: int, size: int) -> str:
        return f"{self.path}/set={start}-{size}"

    def _write(self, keyed: DataFrame, start: int, size: int) -> None:
        rows = keyed.select(*self.keys, self.folder().alias("_folder"))
        rows.hint("rebalance", "_folder").write.mode("overwrite").partitionBy("_folder").parquet(self.place(start, size))

    def _done(self, start: int, size: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(self.place(start, size) + "/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _read(self, start: int, size: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.place(start, size))

    def _ensure(self, start: int, size: int) -> None:
        """Merge a set from its parts, unless it stands already. Parts are kept, as an earlier batch may be repeated."""
        if size > 1 and not self._done(start, size):
            parts = [(start + k * size // self.fan, size // self.fan) for k in range(self.fan)]
            for part in parts:
                self._ensure(*part)
            self._write(reduce(DataFrame.unionByName, [self._read(*p) for p in parts]), start, size)

    def add(self, rows: DataFrame, batch: int) -> None:
        self._write(rows, batch, 1)

    def unknown(self, rows: DataFrame, batch: int) -> DataFrame:
        """Rows whose keys no earlier batch has landed; `rows` are read twice and hold every key once."""
        if not batch:
            return rows
        self.schema = rows.select(*self.keys).schema.add("_folder", "integer")
        mine = [r[0] for r in rows.select(self.folder()).distinct().collect()]  # at most `folders` numbers
        sets = canonical_sets(batch, self.fan)
        for part in sets:
            self._ensure(*part)
        known = reduce(DataFrame.unionByName, [self._read(*p).where(F.col("_folder").isin(mine)) for p in sets])
        known = known.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)])
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(self.keys)])
        return rows.join(known, same, "left_anti")


def land_once(
    stream: DataFrame, keys: list[str], table: str, checkpoint: str, folders: int = FOLDERS, fan: int = FAN
) -> None:
    """Append the first row of every key that has not landed yet, then stop; late rows land like any other.

    What landed in an earlier micro-batch stays; within one, the first row by file name and place in the file counts, if
    the stream has `with_arrival`'s column, else the first one read. Nothing is forgotten: the landed keys lie beside the
    table, in `<table>-keys`. Each micro-batch writes its own folder `batch=<number>` and compares with earlier batches
    only, so a repeated batch replaces itself. Null keys count as one key. An empty batch lands no row.
    """
    landed = LandedKeys(stream.sparkSession, f"{table.rstrip('/')}-keys", keys, folders, fan)

    def land(rows: DataFrame, number: int) -> None:
        order = [c for c in (ARRIVAL,) if c in rows.columns]
        first = keep_first(rows.withColumn("_row", F.monotonically_increasing_id()), keys, [*order, "_row"])
        first = first.drop("_row", *order).persist()
        try:
            new = landed.unknown(first, number)
            new.write.mode("overwrite").parquet(f"{table}/batch={number}")
            schema = new.schema
            landed.add(rows.sparkSession.read.schema(schema).parquet(f"{table}/batch={number}"), number)
        finally:
            first.unpersist()

    query = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
