"""Listing page files: scans by name pattern, per-file report, partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from lotwise.functions.text import page_number
from lotwise.operators.dedup import keep_first
from lotwise.schemas import RAW_LISTINGS

BAD_RECORD = "_bad_record"


def scan_csv(spark: SparkSession, path: str, schema: StructType, glob: str | None = None) -> DataFrame:
    """CSV with header and declared schema; files whose header does not fit are skipped.

    Adds file_name and a row order (file block, position) usable for keep-first rules. An
    unreadable row keeps its text in _bad_record.
    """
    with_bad = StructType([*schema.fields]).add(BAD_RECORD, StringType())
    reader = (
        spark.read.schema(with_bad)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .option("enforceSchema", False)
        .option("ignoreCorruptFiles", True)
        .option("columnPruning", False)
        .option("escape", '"')
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # A row counts as unreadable by the columns that are parsed, so whoever asks for its text has all of them parsed.
    every = F.length(F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in schema.fields]))
    bad = F.coalesce(F.col(BAD_RECORD), F.when(every < 0, F.lit("")))
    return reader.csv(path).select(
        *[f"`{f.name}`" for f in schema.fields],
        bad.alias(BAD_RECORD),
        F.col("_metadata.file_name").alias("file_name"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("row_order"),
    )


def read_pages(spark: SparkSession, folder: str, city: str | None = None, state: str | None = None) -> DataFrame:
    """All page files of a folder, or those of one city, with their page number."""
    glob = f"{city}_{state}_pagina*.csv" if city else "*_pagina*.csv"
    return scan_csv(spark, folder, RAW_LISTINGS, glob).withColumn("pagina", page_number(F.col("file_name")))


def read_listings(spark: SparkSession, folder: str, city: str | None = None, state: str | None = None) -> DataFrame:
    """Page files united, each link once: the first by file name, then by row."""
    rows = read_pages(spark, folder, city, state)
    first = keep_first(rows, ["link"], ["file_name", "row_order"])
    return first.select(*RAW_LISTINGS.fieldNames())


def file_report(spark: SparkSession, folder: str, glob: str = "*_pagina*.csv") -> DataFrame:
    """Rows and unreadable rows per file; files that could not be read show 0 rows."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )
    rows = scan_csv(spark, folder, RAW_LISTINGS, glob).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count(BAD_RECORD).alias("bad_rows"), F.count("link").alias("links")
    )
    return listed.join(rows, "file_name", "left").fillna(0, ["rows", "bad_rows", "links"])


def quarantine(spark: SparkSession, folder: str, glob: str = "*_pagina*.csv*") -> DataFrame:
    """What could not be read, by file: (file_name, reason, row).

    Reasons: 'unreadable' (not one line came out of the file), 'cut short' (a compressed file that holds fewer bytes than its
    end states) and 'bad row' with the row's text. A file with a header alone is sound; one without a byte is not listed.
    """
    name = F.element_at(F.split("path", "/"), -1)
    tail = F.expr("reverse(substring(content, -4, 4))")  # a compressed file ends in its length, lowest byte first
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        .select(name.alias("file_name"), F.when(F.endswith(name, F.lit(".gz")), F.conv(F.hex(tail), 16, 10).cast("long")).alias("stated"))
    )
    lines = (
        spark.read.option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).option("lineSep", "\n").text(folder)
        .groupBy(F.col("_metadata.file_name").alias("file_name")).agg((F.sum(F.octet_length("value")) + F.count(F.lit(1))).alias("read"))
    )
    whole = listed.join(lines, "file_name", "left").withColumn(
        "reason",
        F.when(F.col("read").isNull() & (F.coalesce("stated", F.lit(1)) > 0), "unreadable").when(F.col("stated") > F.col("read"), "cut short"),
    )
    files_out = whole.where("reason IS NOT NULL").select("file_name", "reason", F.lit(None).cast("string").alias("row"))
    rows = scan_csv(spark, folder, RAW_LISTINGS, glob).where(F.col(BAD_RECORD).isNotNull())
    return files_out.unionByName(rows.select("file_name", F.lit("bad row").alias("reason"), F.col(BAD_RECORD).alias("row")))


def write_united(df: DataFrame, folder: str, city: str | None = None, state: str | None = None) -> str:
    """CSV table named after the city or 'todos'; an empty frame is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write: the frame is empty")
    name = f"imoveis_{city}_{state}_completo" if city and state else "imoveis_todos_completo"
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def write_pages(df: DataFrame, folder: str, page: str = "pagina", mode: str = "overwrite") -> None:
    """One folder per city and state, few files each, the page as a column; a large city is split over tasks."""
    (
        df.withColumnRenamed(page, "pagina")
        .hint("rebalance", "cidade", "estado")
        .write.mode(mode)
        .partitionBy("cidade", "estado")
        .option("header", True)
        .option("escape", '"')
        .csv(folder)
    )


def read_written_pages(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Read back what write_pages wrote; city and state come from the folders, `schema` names the rest in order."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(folder)


def land(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Typed listings as parquet, laid out by state and city for partition pruning."""
    df.hint("rebalance", "estado", "cidade").write.mode(mode).partitionBy("estado", "cidade").parquet(folder)
