"""Substring dedup over windows of words, behind a count-min sketch.

First pass: every task counts window keys into a sketch whose counters saturate at two
(two bit maps a row: seen, seen again), and the partition sketches are merged.  The key of
a window is its minimizer, the least hash of its 8-word grams, counted once a place: a
window that occurs twice has a key that occurs twice, so the sketch overestimates window
counts and loses none, at about a seventh of the entries that windows would make.

Second pass: only windows estimated repeated are shuffled, under 128-bit hashes, and
grouped exactly.  A task sends one row a window, its first place there; later places in the
same task are known to be later already, so a window that a third of all documents hold
reaches its group once a task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, WordHashes, merge_intervals, minimizers, mix64, row_key, runs, short_batches, slices, sorted_groups, window_hashes

GRAM = 8
ROWS = 2
BLOCK_CELLS = 1 << 20
PIECE = 1 << 18
_Q, _Q2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SALTS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_LAST = 1 << 62


def word_hashes(cache: WordHashes, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


class Sketch:
    """Count-min rows of counters 0, 1, 2-or-more, as two packed bit maps a row."""

    def __init__(self, cells: int):
        self.cells = cells
        self.once = np.zeros((ROWS, cells // 8), np.uint8)
        self.again = np.zeros((ROWS, cells // 8), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, cells: int, row: int) -> np.ndarray:
        return (mix64(keys ^ np.uint64(_SALTS[row])) & np.uint64(cells - 1)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        for r in range(ROWS):
            at, n = np.unique(self.places(keys, self.cells, r), return_counts=True)
            byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
            twice = bit * ((n > 1) | ((self.once[r][byte] & bit) > 0)).astype(np.uint8)
            if len(at):
                heads = np.concatenate([[0], np.flatnonzero(byte[1:] != byte[:-1]) + 1])
                self.again[r][byte[heads]] |= np.bitwise_or.reduceat(twice, heads)
                self.once[r][byte[heads]] |= np.bitwise_or.reduceat(bit, heads)

    def blocks(self):
        """(row * blocks + block, packed once, packed again) of the parts in use."""
        size = min(BLOCK_CELLS, self.cells) // 8
        per = self.cells // 8 // size
        for r in range(ROWS):
            for b in range(per):
                once = self.once[r][b * size : (b + 1) * size]
                if once.any():
                    yield r * per + b, zlib.compress(once.tobytes(), 1), zlib.compress(self.again[r][b * size : (b + 1) * size].tobytes(), 1)


def merge_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch block for each value of keys (block is the first of them)."""

    def run(table: pa.Table) -> pa.Table:
        once = again = None
        for a, b in zip(table.column("once").to_pylist(), table.column("again").to_pylist(), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, again = (a, b) if once is None else (once | a, again | b | (once & a))
        return pa.table({"block": table.column("block")[:1], "part": table.column("part")[:1], "once": [zlib.compress(once.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]}, schema=table.schema)

    return parts.groupBy(*keys).applyInArrow(run, "block int, part int, once binary, again binary")


def estimated_repeated(keyed: DataFrame, width: int, cells: int) -> list[bytes]:
    """Merged sketch rows, a bit a cell: whether its counter reached two."""

    def run(batches):
        sketch, cache, powers = Sketch(cells), WordHashes(xxhash.xxh3_64_intdigest), Powers(_Q)
        for big in batches:
            for batch in slices(big, "text"):
                found = []
                for x, _, _ in _pieces(batch.column(batch.schema.get_field_index("text")).to_pylist(), cache, width):
                    grams = window_hashes(x, GRAM, powers)
                    found.append(grams[_distinct(minimizers(grams, width - GRAM + 1))])
                if found:
                    sketch.add(np.concatenate(found))
        rows = list(sketch.blocks())
        part = xxhash.xxh32_intdigest(repr([len(x[1]) for x in rows])) % 16
        for block, once, again in rows:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([once]), pa.array([again])], names=["block", "part", "once", "again"])

    parts = keyed.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "block int, part int, once binary, again binary")
    merged = merge_sketches(merge_sketches(parts, ["block", "part"]), ["block"])
    size = min(BLOCK_CELLS, cells) // 8
    out = np.zeros((ROWS, cells // 8), np.uint8)
    flat = out.reshape(-1, size)
    for r in merged.select("block", "again").toLocalIterator():  # bounded by the sketch's size
        flat[r["block"]] = np.frombuffer(zlib.decompress(r["again"]), np.uint8)
    return [x.tobytes() for x in out]


def _distinct(at: np.ndarray) -> np.ndarray:
    return at[runs(at)[0]]


def _pieces(texts, cache: WordHashes, width: int):
    """(word hashes, row, first word) of overlapping pieces; each window is in one piece."""
    for row, text in enumerate(texts):
        words = text.split() if text else []
        if len(words) < width:
            continue
        x = word_hashes(cache, words)
        for base in range(0, len(x) - width + 1, PIECE):
            yield x[base : base + PIECE + width - 1], row, base


def later_windows(keyed: DataFrame, width: int, cells: int) -> DataFrame:
    """(uid, s, n): runs of n window starts whose words also start earlier."""
    sketch = keyed.sparkSession.sparkContext.broadcast(estimated_repeated(keyed, width, cells))
    schema = "w long, v long, doc long, uid long, s int, n int"

    def pick(batches):
        rows = [np.frombuffer(x, np.uint8) for x in sketch.value]
        cache, p1, p2 = WordHashes(xxhash.xxh3_64_intdigest), Powers(_Q), Powers(_Q2)
        for batch in batches:
            docs, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            w, v, d, u, s = [], [], [], [], []
            for x, row, base in _pieces(batch.column(2).to_pylist(), cache, width):
                grams = window_hashes(x, GRAM, p1)
                at = minimizers(grams, width - GRAM + 1)
                first, last = runs(at)
                keys = grams[at[first]]
                hit = np.ones(len(keys), bool)
                for r in range(ROWS):
                    place = Sketch.places(keys, cells, r)
                    hit &= (rows[r][place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                if not hit.any():
                    continue
                take = np.flatnonzero(np.repeat(hit, last - first + 1))
                w.append(window_hashes(x, width, p1)[take])
                v.append(window_hashes(x, width, p2)[take])
                s.append(take + base)
                d.append(np.full(len(take), docs[row], np.int64))
                u.append(np.full(len(take), uids[row], np.int64))
            if not w:
                continue
            w, v, d, u, s = (np.concatenate(c) for c in (w, v, d, u, s))
            order = np.lexsort((s, d, w))
            w, v, d, u, s = (c[order] for c in (w, v, d, u, s))
            lead = np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
            start = np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))
            later = (d != d[start]) | (s != s[start])
            keep = ~later
            yield _rows(w[keep], v[keep], d[keep], u[keep], s[keep], np.zeros(int(keep.sum()), np.int32))
            back = np.flatnonzero(later)
            back = back[np.lexsort((s[back], u[back]))]
            if len(back):
                a, b = _stretches(u[back], s[back])
                yield _rows(mix64(u[back][a].view(np.uint64)), np.zeros(len(a), np.uint64), d[back][a], u[back][a], s[back][a], b - a + 1)

    def _stretches(u, s):
        edge = np.flatnonzero((u[1:] != u[:-1]) | (s[1:] != s[:-1] + 1)) + 1
        return np.concatenate([[0], edge]), np.concatenate([edge, [len(u)]]) - 1

    def _rows(w, v, d, u, s, n):
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(v.view(np.int64)), pa.array(d), pa.array(u), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], names=["w", "v", "doc", "uid", "s", "n"])

    def judge(batches):
        for table, starts in sorted_groups(batches, 2):
            doc, uid, s, n = (table.column(k).to_numpy() for k in ("doc", "uid", "s", "n"))
            head = np.repeat(starts[:-1], np.diff(starts))
            later = (n > 0) | (doc != doc[head]) | (s != s[head])
            yield pa.RecordBatch.from_arrays([pa.array(uid[later]), pa.array(s[later]), pa.array(np.maximum(n[later], 1))], names=["uid", "s", "n"])

    order = ["w", "v", "doc", "s"]
    picked = keyed.select("doc", "uid", F.col("text").cast("binary").alias("text")).mapInArrow(pick, schema)
    return picked.repartition("w").sortWithinPartitions(*order).mapInArrow(judge, "uid long, s int, n int")


def sketch_cells(chars: int, most: int) -> int:
    """A power of two, about four cells a key, between 2**20 and most."""
    want = max(chars // 12, 1)
    return int(min(max(1 << want.bit_length(), 1 << 20), most))


def substring_dedup(docs: DataFrame, width: int = 20, most_cells: int = 1 << 28) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    Removed is each word covered by a window of ``width`` words that also starts earlier:
    in a smaller doc_id, or in the same one at an earlier word; judged on the input.
    Rows with equal ids are one document's: a window at the same word of both is not
    earlier.  Null ids come after all others.  A null text has no words.  Other columns
    are not read; an empty table gives an empty result.  most_cells bounds the sketch
    (a quarter byte a cell and row in a task, an eighth when broadcast); a full sketch
    only sends more windows to the exact pass.
    """
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} or more")
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), row_key("doc_id", text).alias("uid"), text.alias("text"))
    chars = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lists = later_windows(keyed, width, sketch_cells(chars, most_cells)).groupBy("uid").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    rows = keyed.join(lists, "uid", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                kept, at = [], 0
                for s, e in merge_intervals([x["s"] for x in spans], [x["s"] + x["n"] - 1 + width for x in spans]) if spans else []:
                    kept += words[at:s]
                    at = e
                kept += words[at:]
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
