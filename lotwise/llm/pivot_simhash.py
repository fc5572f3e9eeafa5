"""SimHash near-duplicates with a table of distances to reference fingerprints.

Fingerprints within two bits of each other have distances to any reference that differ by two at most. The references
are a seeded fingerprint, its 64 one-bit neighbours and some more seeded ones. The difference between the distances
to the first and to a neighbour depends on one bit alone, so the neighbours of one 16-bit block form a family whose
coordinates tell the block: two fingerprints within two bits agree in two whole families of the four. Equal
coordinates in two families are therefore the cells in which candidates meet (six cells for each fingerprint); in a
cell, pairs whose coordinates for the other references differ by more than two are discarded, and the rest verified.

A crowded cell is cut by a third of the coordinates that are still open, again and again: two fingerprints that
differ in two bits agree on one third of them. After two cuts a cell has at most 2^14 different fingerprints, so no
group is unbounded, nothing is dropped, and of each cell only the links that join its components leave the task.
Components of all links are found with alternating large-star and small-star rounds.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lotwise.llm.common import id_and_text
from lotwise.session import cut_lineage

SHINGLE = 3
MAX_BITS = 2  # differing bits of linked fingerprints; the cells rest on this number
SEED = 42
REFERENCES = 32  # screening references beside the families
CROWDED = 1024  # fingerprints of a cell beyond which it is cut
PAIRS_AT_ONCE = 1 << 20

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """Bit majority of the XXH64 of all 3-word shingles, as a signed 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[: max(1, len(words) - SHINGLE + 1)].tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    pieces = (joined[a:b] for a, b in zip(starts, stops))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        octets = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (long), text_hash. Null, empty and blank texts have fingerprint zero."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def references() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, 1 + REFERENCES, dtype=np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def family_cells() -> list[int]:
    """Masks of the cells: two blocks of 16 bits of four, the coordinates of two families."""
    blocks = [0xFFFF << 16 * k for k in range(4)]
    return [a | b for a, b in combinations(blocks, 2)]


def cuts_of(mask: int) -> list[int]:
    """The mask with each third of its open bits added."""
    open_bits = [k for k in range(64) if not mask >> k & 1]
    return [mask | sum(1 << int(k) for k in part) for part in np.array_split(open_bits, 3)]


def long_lit(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def cell_links(fps: np.ndarray, screen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint of its component) of one cell, for those that are not the least."""
    fps = np.unique(fps)
    n = len(fps)
    table = distance_table(fps.view(np.uint64), screen)
    first, second = [], []
    rows = max(1, PAIRS_AT_ONCE // n)
    for a in range(0, n, rows):
        i, j = np.nonzero(np.arange(n)[None, :] > np.arange(a, min(a + rows, n))[:, None])
        i += a
        for column in range(table.shape[1]):  # the first references discard most pairs
            near = np.abs(table[i, column] - table[j, column]) <= MAX_BITS
            i, j = i[near], j[near]
            if not len(i):
                break
        close = np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= MAX_BITS
        first.append(i[close])
        second.append(j[close])
    i, j = np.concatenate(first), np.concatenate(second)
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(n)
    return fps[moved], fps[label[moved]]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that join all components of the distinct fingerprints in column fp."""
    refs = references()[1:]
    cells = fps.select("fp", F.explode(F.array(*map(long_lit, family_cells()))).alias("mask"))
    found, masks = None, family_cells()
    for level in range(3):
        keyed = cells.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("cell"))
        sizes = keyed.groupBy("mask", "cell").agg(F.count("*").alias("n")).where("n > 1")
        held = cut_lineage(keyed.join(sizes, ["mask", "cell"]), "cells")
        last = level == 2  # at most 2^14 different fingerprints are left in a cell
        here = _links_in(held if last else held.where(F.col("n") <= CROWDED), refs)
        found = here if found is None else found.unionByName(here)
        if last:
            break
        crowded = held.where(F.col("n") > CROWDED)
        lookup = F.create_map(*[x for m in masks for x in (long_lit(m), F.array(*map(long_lit, cuts_of(m))))])
        cells = crowded.select("fp", F.explode(lookup[F.col("mask")]).alias("mask"))
        masks = [c for m in masks for c in cuts_of(m)]
    return found


def _links_in(cells: DataFrame, refs: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            parts = [cell_links(np.asarray(x.values.to_numpy(zero_copy_only=False)), refs) for x in batch.column(0)]
            if parts:
                a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    groups = cells.groupBy("mask", "cell").agg(F.collect_list("fp").alias("fps"))
    return groups.select("fps").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node each node of the edges (a, b) reaches, for nodes that are not it."""
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        edges = cut_lineage(small.where("a <> b").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (hex), component_id (least doc_id that links reach).

    Rows without an id take part in linking but never name a component; a component of only such rows has a null id.
    """
    return _labelled(docs, id_col, text_col).drop("text_hash")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = cut_lineage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows and columns of `docs`, one row per component: the one with the least id.

    Repeated rows of one id and fingerprint leave one row; rows that share an id but not a component are documents of
    their own. Rows without an id stay, as no component names them.
    """
    found = _labelled(docs, id_col, text_col).where("doc_id = component_id")
    mark = next(n for k in range(len(docs.columns) + 1) if (n := f"kept_hash_{k}") not in docs.columns)
    # one text of each fingerprint, then one row of each text
    keep = found.groupBy(F.col("doc_id").alias("_kept_id"), "fingerprint").agg(F.min("text_hash").alias("_kept_hash"))
    named = docs.where(docs[id_col].isNotNull()).withColumn(mark, F.xxhash64(docs[text_col].cast("string")))
    same = (named[id_col].cast("long") == F.col("_kept_id")) & (named[mark] == F.col("_kept_hash"))
    kept = named.join(keep.select("_kept_id", "_kept_hash").distinct(), same, "left_semi").dropDuplicates([id_col, mark])
    return kept.drop(mark).unionByName(docs.where(docs[id_col].isNull()))
