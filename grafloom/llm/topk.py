"""Exact top-k search by inner product, block at a time.

Vectors are scaled to integers.  Rows are laid out once: a bounded sample of rows serves as
pivots, rows are ordered by the two pivots they lean to most, and stretches of this order
are groups of at most ``group_rows`` rows, each the work of one task.  Inside a group,
neighbouring rows form blocks with a dense forward index and the largest and smallest value
of each dimension.  For a query, the sum over dimensions of the larger product bounds every
score in a block.  Blocks are taken by falling bound, and a query is done where the bounds
fall below its k-th score, so the result is exact.

Every query is a row, so the first pass searches each query's own group, which gives it a
k-th score to begin with.  Group by group, the same bound (over at most ``BOXES`` boxes of
neighbouring groups) then tells where a query has still to go.  Rows are not copied but for
groups that very many queries go to; queries go only where their bound reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix64

BLOCK = 64
BOXES = 1024
#: Queries that are searched together in a task.
AT_ONCE = 512
#: Blocks that a query takes in its own order before all blocks are gone through.
OWN_ORDER = 4
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id and the scaled components of rows whose every component is finite."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def pack(col: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix; shorter lists end in zeros."""
    lengths = np.diff(col.offsets.to_numpy())
    wide = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = col.flatten().to_numpy()
    return out


def unpack(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def widened(*parts: np.ndarray) -> list[np.ndarray]:
    wide = max(x.shape[1] for x in parts)
    return [np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in parts]


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products: floating point where no sum can leave its exact range."""
    q, d = widened(q, d)
    top = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64) if top < 2**53 else q @ d.T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries by boxes: no vector of the box has a larger inner product with the query."""
    return products(np.maximum(q, 0), high) + products(np.minimum(q, 0), low)


class Blocks:
    """Rows in blocks of neighbours, in the order given; ``scored`` counts the pairs scored so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.scored = ids, rows, 0
        cuts = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(rows, cuts, axis=0), np.minimum.reduceat(rows, cuts, axis=0)

    def best(self, qid: np.ndarray, q: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of each query's k best rows, its own id left out; NO_ID and NONE where there are fewer.

        Rows that score below ``least`` may be missing.
        """
        score, name = np.full((len(q), k), NONE), np.full((len(q), k), NO_ID)
        bound = bounds(q, self.high, self.low)
        taken = np.zeros(bound.shape, bool)
        kth = lambda: np.maximum(score[:, k - 1], least)
        for _ in range(min(OWN_ORDER, bound.shape[1])):
            own = np.where(taken, NONE, bound)
            block = own.argmax(axis=1)
            going = np.flatnonzero(own[np.arange(len(q)), block] >= kth())
            if not len(going):
                break
            for b in np.unique(block[going]).tolist():
                self._score(b, going[block[going] == b], qid, q, score, name, taken)
        for b in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            going = np.flatnonzero(~taken[:, b] & (bound[:, b] >= kth()))
            if len(going):
                self._score(b, going, qid, q, score, name, taken)
        return name, score

    def _score(self, b, at, qid, q, score, name, taken) -> None:
        ids = self.ids[b * BLOCK : (b + 1) * BLOCK]
        s = products(q[at], self.rows[b * BLOCK : (b + 1) * BLOCK])
        self.scored += s.size
        taken[at, b] = True
        s[ids[None, :] == qid[at][:, None]] = NONE
        better = np.flatnonzero(s.max(axis=1) >= np.maximum(score[at, -1], NONE + 1))
        at, s = at[better], s[better]
        if not len(at):
            return
        all_s = np.concatenate([score[at], s], axis=1)
        all_n = np.concatenate([name[at], np.where(s == NONE, NO_ID, ids[None, :])], axis=1)
        by_name = np.argsort(all_n, axis=1, kind="stable")
        by_score = np.argsort(-np.maximum(np.take_along_axis(all_s, by_name, 1), NONE + 1), axis=1, kind="stable")[:, : score.shape[1]]
        top = np.take_along_axis(by_name, by_score, 1)
        score[at], name[at] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_n, top, 1)


LAID = "grp int, lean int, vec_id long, v array<long>"
#: kind 0: of a query its k-th score; 1: a result; 2: a group's largest and smallest values.
FIRST = "kind int, grp int, vec_id long, other long, score long, v array<long>, w array<long>"
FOUND = "query_id long, vec_id long, score long"


def laid_out(rows: DataFrame, pivots: int, group_rows: int) -> tuple[DataFrame, int]:
    """Rows as LAID, held in the shared folder, and the number of groups."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").collect()
    wide = max((len(r[0]) for r in sample), default=0)
    pivot = np.array([r[0] + [0] * (wide - len(r[0])) for r in sample], np.float64).reshape(len(sample), wide)
    pivot /= np.maximum(np.linalg.norm(pivot, axis=1, keepdims=True), 1)

    def lean(batches):
        for batch in batches:
            v, p = widened(pack(batch.column(1)).astype(np.float64), pivot)
            near = v @ p.T
            first = near.argmax(axis=1)
            near[np.arange(len(v)), first] = -np.inf
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((first * len(p) + near.argmax(axis=1)).astype(np.int32))], names=["vec_id", "v", "lean"])

    leaning = materialize(rows.mapInArrow(lean, "vec_id long, v array<long>, lean int")) if sample else materialize(rows.withColumn("lean", F.lit(0)))
    # at most pivots * pivots rows; a place of more than group_rows rows is dealt out by hash
    start, parts, group, room = {}, {}, 0, group_rows
    for key, n in leaning.groupBy("lean").count().orderBy("lean").collect():
        if n > room and room < group_rows:
            group, room = group + 1, group_rows
        start[key], parts[key] = group, -(-n // group_rows)
        group, room = (group, room - n) if parts[key] == 1 else (group + parts[key], group_rows)
    size = max(start, default=0) + 1
    first, split = np.zeros(size, np.int64), np.ones(size, np.int64)
    first[list(start)], split[list(parts)] = list(start.values()), list(parts.values())

    def deal(batches):
        for batch in batches:
            ids, key = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            grp = first[key] + (mix64(ids.view(np.uint64)) % split[key].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int32)), batch.column(2), batch.column(0), batch.column(1)], names=["grp", "lean", "vec_id", "v"])

    return leaning.select("vec_id", "v", "lean").mapInArrow(deal, LAID), group + 1


def _stretches(batches, keys: list[str]):
    """(key values, part of a batch) of stretches of rows with equal integer keys."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            if b > a:
                yield tuple(int(c[a]) for c in cols), batch.slice(a, b - a)


def _index(parts: list[pa.RecordBatch]) -> Blocks:
    return Blocks(np.concatenate([p.column("vec_id").to_numpy() for p in parts]), np.concatenate(widened(*[pack(p.column("v")) for p in parts])))


def _results(qid, name, score) -> list[np.ndarray]:
    at, col = np.nonzero(name != NO_ID)
    return [qid[at], name[at, col], score[at, col]]


def top_k_search(table: DataFrame, k: int = 5, every: int = 50, pivots: int = 256, group_rows: int = 1 << 15, together: int = 1 << 17) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows
    with another vec_id.  Ties go to the smaller vec_id; fewer candidates give fewer rows.
    Rows with a null id, a null vector or a component that is null or not finite take no
    part; vectors of unequal length are compared as if the shorter ended in zeros; scaled
    components must fit 64-bit sums.  Repeated rows are candidates and queries once each
    (equal ids and vectors).  Extra columns are not read; an empty table gives an empty
    result.  pivots: rows of the sample that gives the layout; it does not touch results.
    group_rows: rows of a task.  together: queries of a group that one task searches.
    """
    laid, groups = laid_out(valid_vectors(table).distinct(), pivots, group_rows)
    span = -(-groups // BOXES)

    def own(batches):
        def search(key, parts):
            index = _index(parts)
            at = np.flatnonzero(index.ids % every == 0)
            out = []
            for i in range(0, len(at), AT_ONCE):
                mine = at[i : i + AT_ONCE]
                qid, q = index.ids[mine], index.rows[mine]
                name, score = index.best(qid, q, k, np.full(len(mine), NONE))
                none = pa.nulls(len(mine), pa.int64())
                lists = pa.nulls(len(mine), pa.list_(pa.int64()))
                out.append([np.zeros(len(mine), np.int32), np.full(len(mine), key, np.int32), qid, none, score[:, k - 1], unpack(q), lists])
                a, b, s = _results(qid, name, score)
                lists = pa.nulls(len(a), pa.list_(pa.int64()))
                out.append([np.ones(len(a), np.int32), np.full(len(a), key, np.int32), a, b, s, lists, lists])
            none = pa.nulls(1, pa.int64())
            out.append([[2], [key // span], none, none, none, unpack(index.high.max(axis=0)[None]), unpack(index.low.min(axis=0)[None])])
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            for cols in out:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FIRST.split(", ")])

        key, parts = None, []
        for (grp,), part in _stretches(batches, ["grp"]):
            if grp != key and parts:
                yield from search(key, parts)
                parts = []
            key = grp
            parts.append(part)
        if parts:
            yield from search(key, parts)

    first = materialize(laid.repartition("grp").sortWithinPartitions("grp", "lean", "vec_id").mapInArrow(own, FIRST))

    def merged(part: pa.Table) -> pa.Table:
        high, low = pack(part.column("v").combine_chunks()), pack(part.column("w").combine_chunks())
        return pa.table([part.column("grp")[:1], unpack(high.max(axis=0)[None]), unpack(low.min(axis=0)[None])], names=["grp", "v", "w"])

    boxes = first.where("kind = 2").select("grp", "v", "w").groupBy("grp").applyInArrow(merged, "grp int, v array<long>, w array<long>").orderBy("grp").collect()  # BOXES rows at most
    wide = max((len(r["v"]) for r in boxes), default=0)
    box = np.array([r["grp"] for r in boxes], np.int64)
    high, low = (np.array([r[c] + [0] * (wide - len(r[c])) for r in boxes], np.int64).reshape(len(boxes), wide) for c in ("v", "w"))
    extent = table.sparkSession.sparkContext.broadcast((box, high, low))

    def reached(batch):
        """Places in the batch and groups of the queries that have to go there."""
        box, high, low = extent.value
        least = np.maximum(batch.column("score").to_numpy(), NONE + 1)
        at, to = np.nonzero(bounds(pack(batch.column("v")), high, low) >= least[:, None])
        at, to = np.repeat(at, span), (box[to][:, None] * span + np.arange(span)).ravel()
        ok = (to < groups) & (to != batch.column("grp").to_numpy()[at])
        return at[ok], to[ok]

    def few(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                yield batch.slice(i, 64)

    def count(batches):
        for batch in few(batches):
            grp, n = np.unique(reached(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int32)), pa.array(n)], names=["grp", "n"])

    def send(batches):
        for batch in few(batches):
            at, to = reached(batch)
            for i in range(0, len(at), 4096):
                rows = batch.select(["vec_id", "score", "v"]).take(pa.array(at[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(to[i : i + 4096].astype(np.int32)), *rows.columns], names=["grp", "vec_id", "score", "v"])

    queries = first.where("kind = 0").select("grp", "vec_id", "score", "v")
    parts = F.ceil(F.sum("n") / together).cast("int")
    visits = materialize(queries.mapInArrow(count, "grp int, n long").groupBy("grp").agg(parts.alias("parts")))
    sent = queries.mapInArrow(send, "grp int, vec_id long, score long, v array<long>").join(visits, "grp").select("grp", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(0).alias("lean"), "vec_id", "score", "v")
    there = laid.join(visits, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "lean", "vec_id", F.lit(None).cast("long").alias("score"), "v")

    def search(batches):
        key, parts, index = None, [], None
        for (*at, kind), part in _stretches(batches, ["grp", "part", "kind"]):
            if at != key:
                key, parts, index = at, [], None
            if kind == 0:
                parts.append(part)
                continue
            index = index or _index(parts)
            for i in range(0, part.num_rows, AT_ONCE):
                some = part.slice(i, AT_ONCE)
                qid, q, rows = some.column("vec_id").to_numpy(), *widened(pack(some.column("v")), index.rows)
                if rows.shape != index.rows.shape:
                    index = Blocks(index.ids, rows)
                q = widened(q, index.rows)[0]
                found = _results(qid, *index.best(qid, q, k, some.column("score").to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[x.split()[0] for x in FOUND.split(", ")])

    other = there.unionByName(sent).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind", "lean", "vec_id").mapInArrow(search, FOUND)
    found = first.where("kind = 1").select(F.col("vec_id").alias("query_id"), F.col("other").alias("vec_id"), "score").unionByName(other)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
