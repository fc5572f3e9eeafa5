"""Exact dedup by a tree of merged digest runs.

Every partition's rows form one run of (digest, best row, count). In each round the runs whose numbers differ in one
base-8 digit exchange: each keeps the digests that carry its digit, so that one round joins three binomial rounds in
one eight-way merge. The merge is a sort and a sorted aggregate, which spill. What two runs hold of one digest
becomes one row before it travels on, so a text with a third of all rows sends one row per run, at most eight of
which meet in a task. After the last round a run holds all there is of its digests.

The answers go down the same tree: each level is joined to the one above by run and digest, eight rows to one at most,
and the rows of a partition to their own run, so no join gathers the copies of a frequent text either.

A digest alone decides nothing: rows are the same only if SHA-256, length in bytes and XXH64 of the text agree.
Everything is DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from lotwise.session import cut_lineage

DIGIT = 3  # bits of the run number that one round settles
KEY = ["digest", "size", "mix"]


def normalised(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    """Per row: doc_id, row (a number of its own), run (its partition), digest, size and mix of the text."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), row.alias("row"), normalised(docs[text_col]).alias("text"))
    return rows.select(
        "doc_id", "row", F.spark_partition_id().cast("long").alias("run"), F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("size"), F.xxhash64("text").alias("mix"),
    )


def exchanged(level: int, rounds: int) -> Column:
    """The run that takes a row in a round: the digits settled so far are the digest's, the others the run's own."""
    settled = (1 << DIGIT * (level + 1)) - 1
    own = F.col("mix").bitwiseAND((1 << DIGIT * rounds) - 1)
    return F.col("run").bitwiseAND(~settled).bitwiseOR(own.bitwiseAND(settled))


def merge(runs: DataFrame, run: Column) -> DataFrame:
    """Runs merged: per run and digest the best row, that is the largest doc_id, then the smallest row number."""
    return runs.groupBy(run.alias("run"), *KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def merged_levels(rows: DataFrame) -> list[DataFrame]:
    """Every level of the tree, each written: the partitions' own runs first, whole groups last."""
    last = rows.agg(F.max("run")).first()[0] or 0
    rounds = -(-last.bit_length() // DIGIT)
    best = F.struct("doc_id", (-F.col("row")).alias("row"))  # a null doc_id is the smallest
    levels = [cut_lineage(merge(rows.withColumn("best", best).withColumn("n", F.lit(1)), F.col("run")), "runs")]
    for level in range(rounds):
        levels.append(cut_lineage(merge(levels[-1], exchanged(level, rounds)), "runs"))
    return levels


def answers(levels: list[DataFrame]) -> DataFrame:
    """Per partition's run and digest: best row and size of the whole group, handed down level by level."""
    found, rounds = levels[-1], len(levels) - 1
    for level in reversed(range(rounds)):
        below = levels[level].select("run", *KEY, exchanged(level, rounds).alias("above"))
        found = below.join(found.withColumnRenamed("run", "above"), ["above", *KEY]).drop("above")
    return found


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays; of several rows with that id, the one read first. A null id is smaller than any other, so
    a group of such rows alone has a null keep_id and one kept row. An empty table gives no row.
    """
    return _judged(digests(docs, id_col, text_col, F.monotonically_increasing_id())).drop("row")


def _judged(rows: DataFrame) -> DataFrame:
    rows = cut_lineage(rows, "digests")
    found = rows.join(answers(merged_levels(rows)), ["run", *KEY])
    return found.select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == -F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows and columns of `docs`, one row of each group of equal texts; rules as in `exact_copies`.

    The table is written once with a number for each row, which names the rows that stay.
    """
    number = next(n for k in range(len(docs.columns) + 1) if (n := f"row_number_{k}") not in docs.columns)
    numbered = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    kept = _judged(digests(numbered, id_col, text_col, numbered[number])).where("kept")
    return numbered.join(kept.select(F.col("row").alias(number)), number, "left_semi").select(*docs.columns)
