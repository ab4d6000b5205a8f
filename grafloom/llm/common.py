"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL_FALLBACK: list[str] = []
#: Folders handed out so far, so that a run can sweep up after itself.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL_FALLBACK:
            _LOCAL_FALLBACK.append("file://" + tempfile.mkdtemp(prefix="grafloom-"))
        base = _LOCAL_FALLBACK[0]
    _made.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder and read back; survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.shared_path = path
    return held


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def discard(held: DataFrame) -> None:
    """Delete the files of a materialised table; nothing that still runs may read it."""
    _delete(held.sparkSession, held.shared_path)


def sweep(spark: SparkSession, since: int, keep: DataFrame) -> int:
    """Delete the folders handed out from number ``since`` on but that of ``keep``; returns the number of the next one."""
    for path in _made[since:]:
        if path != keep.shared_path:
            _delete(spark, path)
    return len(_made)


def folders_made() -> int:
    return len(_made)


def short_batches(spark: SparkSession) -> None:
    """Texts are long: hand Python 2,000 rows at once, unless the session has its own number."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, "2000")


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text: Column) -> Column:
    """64-bit key of a row's id and text: rows with both equal share it, and every result."""
    return F.xxhash64(F.col(id_col), text)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Zero-copy view of a string column: all bytes, and row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, budget: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about ``budget`` text bytes, one row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def distinct(raw: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """Which of the distinct strings each stretch of raw is, and those strings."""
    offsets = np.append(start, n).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    found = words.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def gathered(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The stretches of pool one after another."""
    out = np.empty(int(count.sum()), pool.dtype)
    at = 0
    for k in range(0, len(start), 1 << 18):
        s, c = start[k : k + (1 << 18)], count[k : k + (1 << 18)]
        upto = np.cumsum(c)
        n = int(upto[-1])
        out[at : at + n] = pool[np.repeat(s - (upto - c), c) + np.arange(n)]
        at += n
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, memoised up to a bound."""

    LIMIT = 300_000

    def __init__(self, hasher):
        super().__init__()
        self.hasher = hasher

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = self.hasher(word)
        return h


class Powers:
    """Powers of an odd multiplier and of its inverse mod 2**64, as long as asked for."""

    def __init__(self, q: int):
        self.q, self.inv = q, pow(q, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, q in (("up", self.q), ("down", self.inv)):
                steps = np.full(size, q, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def window_hashes(x: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Polynomial hash mod 2**64 of every ``width`` consecutive elements of x."""
    if len(x) < width:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(len(x))
    s = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up, out=s[1:], dtype=np.uint64)
    return mix64((s[width:] - s[:-width]) * down[: len(x) - width + 1])


POSITION_BITS = np.uint64(24)


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least of every ``width`` consecutive hashes.

    Equal windows have it at the same place, so the hash there is a key that all copies
    of a window share.  Two running-minimum sweeps; h must be shorter than 2**24.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64)
    if n >= 1 << int(POSITION_BITS):
        raise ValueError("cut longer inputs into overlapping pieces")
    pad = -n % width
    a = np.full(n + pad, np.iinfo(np.uint64).max, np.uint64)
    a[:n] = (h >> POSITION_BITS) << POSITION_BITS | np.arange(n, dtype=np.uint64)
    a = a.reshape(-1, width)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every stretch of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], edge]), np.concatenate([edge, [len(values)]]) - 1


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by their first ``keys`` integer columns.

    Yields tables with the start of each group in them, and the table's length last.
    """
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for k in range(keys):
            col = table.column(k).to_numpy()
            change |= col[1:] != col[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in range(keys)):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = cut(table)
        whole = int(starts[-2])
        if whole:
            yield table.slice(0, whole), starts[:-1]
        held = table.slice(whole).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, cut(table)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of an edge table (a, b).

    Returns (node, root) for the nodes that have an edge.  Labels spread to neighbours
    and then jump to their label's label, so rounds grow with the logarithm of a
    chain's length.  Every round is joins and partial aggregates only, and its labels
    are written to the shared folder; nothing but a count reaches the driver.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        # a node also offers what it heard to its root, so that whole trees hook together
        offers = F.array(F.struct("node", F.least("root", "near").alias("root")), F.struct(F.col("root").alias("node"), F.col("near").alias("root")))
        low = labels.join(seen, "node").select(F.inline(offers)).groupBy("node").agg(F.min("root").alias("root"))
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = materialize(low.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").where("root != was").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def merge_intervals(starts: Iterable[int], ends: Iterable[int]) -> list[tuple[int, int]]:
    """Union of half-open intervals; those that touch become one."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


