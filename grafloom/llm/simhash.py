"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of
their bit counts.  The Manhattan distance of two embeddings never exceeds the Hamming
distance of the fingerprints, so it is a lower bound to filter by.  In unary code
(0 -> 00, 1 -> 01, 2 -> 11) the embedding is again 64 bits and that distance is one
popcount of an exclusive or.

The 32 coordinates fall into blocks.  Within Manhattan distance 3, at most three blocks
differ, so two near fingerprints share a cell of at least one of the grids that all blocks
but three span: twenty grids for six blocks.  The more fingerprints there are, the more
blocks are taken, so that cells stay small: see ``block_count``.  Cells that hold several
fingerprints are compared inside; a cell of more than ``chunk`` is cut into chunks that
meet pair by pair, each pair in a task.  Of the links of a comparison only a spanning
forest is emitted.
"""

from __future__ import annotations

import math
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, materialize, mix64, row_key, short_batches, sorted_groups

LOW = np.uint64(0x5555555555555555)
SEGMENTS = 32
#: Bits that tell the counts of two random segments apart: 0, 1, 2 with odds 1, 2, 1.
SEGMENT_BITS = -math.log2((1 + 4 + 1) / 16)
#: A cell entry costs about as much as comparing so many pairs.
ENTRY_COST = 32


def block_count(n: int, distance: int) -> int:
    """Number of blocks with the least expected work for n fingerprints.

    A fingerprint has an entry in each grid, and meets by chance those that agree in all
    blocks of a grid.  Pairs a fingerprint so stay bounded while entries a fingerprint grow
    with the logarithm of n.
    """

    def work(blocks: int) -> float:
        grids = math.comb(blocks, distance)
        return grids * (ENTRY_COST + n * 2.0 ** (-SEGMENT_BITS * SEGMENTS * (blocks - distance) / blocks))

    return min(range(distance + 3, 17), key=work) if distance <= 8 else distance + 3


def grid_masks(distance: int, blocks: int) -> list[int]:
    """Masks of the block choices of which near embeddings share at least one."""
    if not 0 <= distance < blocks <= SEGMENTS:
        raise ValueError(f"distance must be 0 to {blocks - 1}")
    cuts = [SEGMENTS * b // blocks for b in range(blocks + 1)]
    masks = [sum(3 << (2 * s) for s in range(a, b)) for a, b in pairwise(cuts)]
    return [sum(x) for x in combinations(masks, blocks - distance)]


def embed(x: np.ndarray) -> np.ndarray:
    """Counts of the two-bit segments, in unary code."""
    high = x >> np.uint64(1)
    return ((x | high) & LOW) | ((x & high & LOW) << np.uint64(1))


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is set if it is in over half the XXH64 (seed 42) of the word shingles."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = 3, tag: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long.  ``tag`` adds the row key."""

    def run(batches):
        for batch in batches:
            values = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "tag"][: batch.num_columns])

    short_batches(docs.sparkSession)
    keys = [row_key("doc_id", F.col("text").cast("string")).alias("tag")] * tag
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *keys)
    return rows.mapInArrow(run, "doc_id long, fp long" + ", tag long" * tag)


def forest(x: np.ndarray, e: np.ndarray, distance: int, split: int = 0) -> list[tuple[int, int]]:
    """Spanning forest of the links in a cell; with ``split``, only between the first rows and the rest."""
    n = len(x)
    label = np.arange(n)
    out = []
    far = np.uint64(distance)
    step = max(1, (1 << 19) // max(n, 1))
    for top in range(0, split or n, step):
        rows = slice(top, min(top + step, split or n))
        left = split or top
        bound = np.bitwise_count(e[rows, None] ^ e[None, left:]) <= far
        i, j = np.nonzero(bound)
        i, j = i + top, j + left
        keep = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= far)
        i, j = i[keep], j[keep]
        for a in np.unique(i).tolist():
            mine = j[np.searchsorted(i, a) : np.searchsorted(i, a, side="right")]
            other = label[mine]
            names, first = np.unique(other, return_index=True)
            for name, k in zip(names.tolist(), first.tolist(), strict=True):
                if name != label[a]:
                    out.append((a, int(mine[k])))
                    label[label == name] = label[a]
    return out


def near_links(distinct: DataFrame, distance: int = 3, chunk: int = 512, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect just what fingerprints within ``distance`` bits connect.

    distinct: one column fp without repeats or nulls.  blocks: of the grids; by default
    what ``block_count`` says.  Either way no link is missed.
    """
    masks = grid_masks(distance, blocks or block_count(distinct.count(), distance))

    def cells(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            e = embed(x)
            keys = np.concatenate([mix64((e & np.uint64(m)) + np.uint64(k)) ^ np.uint64(m) for k, m in enumerate(masks)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(x, len(masks)).view(np.int64))], names=["cell", "fp"])

    grid = distinct.select("fp").mapInArrow(cells, "cell long, fp long")
    counts = grid.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = (
        grid.join(counts, "cell")
        .select("cell", "fp", parts.alias("parts"))
        .select("cell", "fp", "parts", mine.alias("mine"))
        .select("cell", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("cell", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "fp")
    )

    def compare(batches):
        for table, starts in sorted_groups(batches, 3):
            lo, hi, mine, fp = (table.column(k).to_numpy() for k in (1, 2, 3, 4))
            a, b = [], []
            for s, t in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if t - s == 2:
                    x, y = int(fp[s]), int(fp[s + 1])
                    if x != y and ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance:
                        a.append(x)
                        b.append(y)
                    continue
                x = fp[s:t].view(np.uint64)
                split = int((mine[s:t] == lo[s]).sum()) if lo[s] != hi[s] else 0
                if lo[s] != hi[s] and split in (0, t - s):
                    continue
                for i, j in forest(x, embed(x), distance, split):
                    a.append(int(fp[s + i]))
                    b.append(int(fp[s + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["cell", "lo", "hi"]
    return met.repartition(*keys).sortWithinPartitions(*keys, "mine").mapInArrow(compare, "a long, b long").distinct()


def fingerprint_classes(rows: DataFrame, distance: int = 3) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of (doc_id, fp) rows."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_links(classes, distance))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    Two rows are linked if their fingerprints differ in ``distance`` bits at most;
    component_id is the smallest doc_id that links reach.  A null or blank text has
    fingerprint zero and is linked like any other.  A null doc_id is never the smallest;
    a component of null ids only has a null component_id.  Repeated rows come back
    repeated; other columns are not read; an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, shingle))
    named = fingerprint_classes(rows, distance)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """One row of docs, with all its columns, for each near-duplicate group: that with the smallest doc_id.

    Of rows that repeat that id, the one with the least fingerprint and text hash stays; a
    group of null ids only keeps one row likewise, and of repeated rows one.  Null, empty and
    blank texts form one group, fingerprint zero.  Columns of any name pass unchanged; an
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, shingle, tag=True))
    named = fingerprint_classes(rows, distance)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "tag")
    first = rows.join(named, "fp").groupBy(F.coalesce("component_id", "fp").alias("g"), F.col("component_id").isNull()).agg(F.min(place).alias("p"))
    tag = fresh(docs.columns, "tag")
    tagged = docs.withColumn(tag, row_key("doc_id", F.col("text").cast("string")))
    joined = tagged.join(first.select(F.col("p.tag").alias(tag)), tag, "left_semi")
    # equal rows share a tag: one of them stays
    return joined.dropDuplicates([tag]).select(*docs.columns)
