"""Suffix-array dedup of repeated byte strings across all documents.

Every window of ``width`` bytes has a key that its copies share: the hash of its
minimizer, the least of its 32-byte grams.  Neighbouring windows with one minimizer form a
segment.  Only hashes are shuffled at first, one row for each distinct segment of a task:

* a segment that occurs twice as a whole (128-bit hash of its bytes) repeats throughout;
* a key under which different segments occur is contested: one copy of each such segment
  is cut from its text, and the segments of a key are brought together and suffix sorted.

The sort is in two stages.  Suffixes that are smaller than their successors are sorted
directly; all others are induced by scanning the buckets of their first bytes in order.
Common prefixes of neighbours in that order then tell which windows repeat.

A key under which more than ``hot`` different segments occur would be one large group.  Its
windows are dealt out by a longer key: windows at like distances from the minimizer are
taken in classes, and the class's key is the core that they all hold.  The same two rules
hold for the classes of a core, and the sort gets cores of at most ``hot`` different
classes; what is over is cut finer.  A class of one window is its own core, so this ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, fresh, materialize, merge_intervals, minimizers, row_key, runs, short_batches, slices, sorted_groups, utf8, window_hashes

GRAM = 32
PIECE = 1 << 19
BLOCK = 1 << 19
#: Segments that a task gathers before it sends one row for each distinct one.
GATHER = 50_000
_Q = 0x9E3779B97F4A7C15
#: Windows of a class, level by level; most near copies part within the wide ones, so that few
#: rows are made (a segment has at most windows / size + 2 classes) and few are cut finer.
CLASSES = (100, 25, 5, 1)
#: Place of a null doc_id among documents: the last.
_LAST = (1 << 63) - 1


def two_stage_order(text: np.ndarray, want: np.ndarray, depth: int) -> np.ndarray:
    """The wanted positions of text in the order of their suffixes, compared to ``depth`` bytes.

    text: bytes; want: boolean mask.  Suffixes that agree on ``depth`` bytes are neighbours.
    """
    n = len(text)
    if not n or not want.any():
        return np.zeros(0, np.int64)
    index = np.arange(n)
    # the first place from i on where a byte differs from the next decides i's type
    change = np.append(text[1:] != text[:-1], True)
    place = np.minimum.accumulate(np.where(change, index, n)[::-1])[::-1]
    follower = np.append(text, np.uint8(0))[place + 1]
    small = text[place] < follower  # smaller than the successor
    small[place == n - 1] = False
    need = want.copy()
    # an induced suffix needs its successors up to the next directly sorted one
    next_small = np.minimum.accumulate(np.where(small, index, n - 1)[::-1])[::-1]
    ends = np.zeros(n + 1, np.int64)
    grow = np.flatnonzero(want & ~small)
    np.add.at(ends, grow, 1)
    np.add.at(ends, next_small[grow] + 1, -1)
    need |= np.cumsum(ends[:n]) > 0

    raw = text.tobytes()
    direct = np.flatnonzero(need & small)
    keys = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    by_byte = np.searchsorted(text[direct], np.arange(257))
    induced = need & ~small
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if induced[n - 1]:  # the last suffix has no successor
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(text, minlength=256)).tolist():
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == c)]
        bucket.append(direct[by_byte[c] : by_byte[c + 1]])
        scan = np.concatenate(bucket)
        out.append(scan)
        before = scan[scan > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        heads = text[before]
        before = before[np.argsort(heads, kind="stable")]
        cuts = np.searchsorted(text[before], np.arange(257))
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            waiting[b].append(before[cuts[b] : cuts[b + 1]])
    order = np.concatenate(out)
    return order[want[order]]


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each position in order and the next, ``limit`` at most; the text must reach that far."""
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(text, limit)
    for k in range(0, len(out), 1 << 14):
        a, b = view[order[k : min(k + (1 << 14), len(out))]], view[order[k + 1 : min(k + (1 << 14), len(out)) + 1]]
        differ = a != b
        first = differ.argmax(axis=1)
        out[k : k + len(first)] = np.where(differ[np.arange(len(first)), first], first, limit)
    return out


def repeated_windows(segments: list[bytes], width: int, places: np.ndarray | None = None) -> list[np.ndarray]:
    """For each segment, the starts of its windows that occur elsewhere among the segments.

    With ``places`` (an integer for each byte of all segments, in their order) only those
    that occur at a smaller place.
    """
    text = np.frombuffer(b"".join(segments), np.uint8)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    first = np.cumsum(lengths) - lengths
    want = np.zeros(len(text), bool)
    for s, n in zip(first.tolist(), lengths.tolist(), strict=True):
        want[s : s + n - width + 1] = True
    order = two_stage_order(text, want, width)
    same = adjacent_prefixes(text, order, width) >= width
    hit = np.zeros(len(text), bool)
    if places is None:
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
    elif len(order):
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        own = places[order]
        least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(order))))
        hit[order[own != least]] = True
    return [np.flatnonzero(hit[s : s + n]) for s, n in zip(first.tolist(), lengths.tolist(), strict=True)]


ANCHOR = "h long, g long, k long, n int, p int, c long, doc long, uid long, s int, more array<struct<doc:long,uid:long,s:int>>"
PLACE = pa.struct([("doc", pa.int64()), ("uid", pa.int64()), ("s", pa.int32())])
PART = "a long, b long, g long, k long, doc long, uid long, s int, n int, p int, data binary"
_PART_KINDS = [*[pa.int64()] * 6, *[pa.int32()] * 3, pa.binary()]
SPAN = "uid long, s int, e int"


def _batch(rows: list[tuple], schema: str, kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _signed(digest: int) -> tuple[int, int]:
    return tuple(x - (1 << 64) if x >> 63 else x for x in (digest >> 64, digest & (1 << 64) - 1))


def anchors(keyed: DataFrame, width: int) -> DataFrame:
    """Segments of every text, one row for each distinct one of a stretch of a task.

    h: key; g, k: hash of the segment's bytes; n: windows; p: the minimizer's place; c: how
    often; doc, uid, s: its first place, and more: all others.
    """
    span = width - GRAM + 1

    def gathered(cols):
        h, g, k, d, u, s, n, p = map(np.concatenate, cols)
        order = np.lexsort((s, u, d, k, g))
        h, g, k, d, u, s, n, p = (x[order] for x in (h, g, k, d, u, s, n, p))
        lead = np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])])
        at = np.flatnonzero(lead)
        count = np.diff(np.append(at, len(h)))
        more = pa.StructArray.from_arrays([pa.array(x[~lead]) for x in (d, u, s)], fields=list(PLACE))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count - 1)]).astype(np.int32)), more)
        return pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (h, g, k, n, p)), pa.array(count), *(pa.array(x[at]) for x in (d, u, s)), lists], names=[x.split()[0] for x in ANCHOR.split(", ")])

    def run(batches):
        powers, digest = Powers(_Q), xxhash.xxh3_128_digest
        cols, held = [[] for _ in range(8)], 0
        for big in batches:
            for batch in slices(big, "text"):
                docs, uids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                raw, offsets = utf8(batch.column(2))
                for row, (doc, uid) in enumerate(zip(docs.tolist(), uids.tolist(), strict=True)):
                    for base in range(int(offsets[row]), int(offsets[row + 1]) - width + 1, PIECE):
                        piece = raw[base : min(base + PIECE + width - 1, int(offsets[row + 1]))]
                        grams = window_hashes(piece.astype(np.uint64) + np.uint64(1), GRAM, powers)
                        at = minimizers(grams, span)
                        first, last = runs(at)
                        view = piece.tobytes()
                        whole = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(first.tolist(), (last + width).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                        found = (grams[at[first]].view(np.int64), whole[:, 0], whole[:, 1], np.full(len(first), doc, np.int64), np.full(len(first), uid, np.int64), (first + base - int(offsets[row])).astype(np.int32), (last - first + 1).astype(np.int32), (at[first] - first).astype(np.int32))
                        for into, x in zip(cols, found, strict=True):
                            into.append(x)
                        held += len(first)
                if held >= GATHER:
                    yield gathered(cols)
                    cols, held = [[] for _ in range(8)], 0
        if held:
            yield gathered(cols)

    return keyed.select("doc", "uid", "text").mapInArrow(run, ANCHOR)


def _classes(parts: DataFrame, width: int, size: int) -> DataFrame:
    """Segments cut into classes of ``size`` windows, under the hash of the class's core.

    A class is the windows that start ``size * c`` to ``size * (c + 1) - 1`` bytes before
    the minimizer; its core is what they all hold.  Equal windows have equal cores.
    """

    def run(batches):
        for batch in (big.slice(i, 500) for big in batches for i in range(0, big.num_rows, 500)):
            rows = []
            for _, _, _, _, doc, uid, s, n, p, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c in range((p - n + 1) // size, p // size + 1):
                    a, b = max(0, p - size * c - size + 1), min(n - 1, p - size * c)
                    core = xxhash.xxh3_128_intdigest(c.to_bytes(4, "big") + data[p - size * c : p - size * c - size + 1 + width])
                    whole = xxhash.xxh3_128_intdigest((p - a).to_bytes(4, "big") + data[a : b + width])
                    rows.append((*_signed(core), *_signed(whole), doc, uid, s + a, b - a + 1, p - a, data[a : b + width]))
            yield _batch(rows, PART, _PART_KINDS)

    return parts.mapInArrow(run, PART)


def _sorted_spans(parts: DataFrame, width: int, first_stays: bool) -> DataFrame:
    """(uid, s, e) of windows that repeat among the different segments of a key, by their suffix order."""

    def emit(rows):
        out = []
        places = None
        if first_stays:
            rank = {x: r for r, x in enumerate(sorted({r[:2] for r in rows}))}
            places = np.concatenate([(rank[r[:2]] << 32) + r[2] + np.arange(len(r[3])) for r in rows])
        for (_, uid, base, _), hits in zip(rows, repeated_windows([r[3] for r in rows], width, places), strict=True):
            a, b = runs(hits - np.arange(len(hits)))
            out += [(uid, base + x, base + y + width) for x, y in zip(hits[a].tolist(), hits[b].tolist(), strict=True)]
        return _batch(out, SPAN, [pa.int64(), pa.int32(), pa.int32()])

    def run(batches):
        held, size = [], 0
        for table, starts in sorted_groups(batches, 2):
            doc, uid, at, data = (table.column(c).to_pylist() for c in ("doc", "uid", "s", "data"))
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if j - i > 1:
                    held += zip(doc[i:j], uid[i:j], at[i:j], data[i:j], strict=True)
                    size += sum(map(len, data[i:j]))
                if size >= BLOCK:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return parts.select("a", "b", "doc", "uid", "s", "data").repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(run, SPAN)


def _texts_of(keyed: DataFrame, contested: DataFrame, width: int) -> DataFrame:
    """PART and hot for (uid, struct of h, g, k, doc, s, n, p, hot): the segments with their bytes."""

    def run(batches):
        schema, kinds = PART + ", hot boolean", [*_PART_KINDS, pa.bool_()]
        for big in batches:
            for batch in slices(big, "text", 1_000_000):
                rows = []
                for uid, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows += [(x["h"], 0, x["g"], x["k"], x["doc"], uid, x["s"], x["n"], x["p"], text[x["s"] : x["s"] + x["n"] - 1 + width], x["hot"]) for x in parts]
                yield _batch(rows, schema, kinds)

    lists = contested.groupBy("uid").agg(F.collect_list("part").alias("parts"))
    text = keyed.select("uid", F.col("text").cast("binary").alias("text"))
    return text.join(lists, "uid").select("uid", "text", "parts").mapInArrow(run, PART + ", hot boolean")


def repeated_spans(keyed: DataFrame, width: int, hot: int, first_stays: bool = False) -> DataFrame:
    """(uid, s, e): byte ranges covered by windows that start twice or more; ranges may overlap.

    keyed: doc, uid, text.  With ``first_stays`` the first place of each window, by doc,
    uid and s, is left out.
    """
    short_batches(keyed.sparkSession)
    found = materialize(anchors(keyed, width))
    place = F.struct("doc", "uid", "s", "n", "p")
    kinds = materialize(found.groupBy("h", "g", "k").agg(F.sum("c").alias("c"), F.min(place).alias("first")))
    keys = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    places = F.concat(F.array(F.struct("doc", "uid", "s")), "more")
    twice = kinds.where("c > 1").select("h", "g", "k", F.struct("first.doc", "first.uid", "first.s").alias("first"))
    listed = found.join(twice, ["h", "g", "k"]).select("n", "first", F.explode(places).alias("x"))
    if first_stays:
        listed = listed.where("x != first")
    whole = listed.select("x.uid", "x.s", (F.col("x.s") + F.col("n") - 1 + width).alias("e"))

    part = F.struct("h", "g", "k", "first.doc", "first.s", "first.n", "first.p", (F.col("kinds") > hot).alias("hot"))
    parts = materialize(_texts_of(keyed, kinds.join(keys, "h").select("first.uid", part.alias("part")), width))
    spans = whole.unionByName(_sorted_spans(parts.where("not hot"), width, first_stays))
    warm = parts.where("hot")
    for size in dict.fromkeys(min(x, max(width // 4, 1)) for x in CLASSES):
        if warm.isEmpty():
            break
        twice, cold, warm = _split(warm, width, size, hot, first_stays)
        spans = spans.unionByName(twice).unionByName(_sorted_spans(cold, width, first_stays))
    return spans


def _split(parts: DataFrame, width: int, size: int, hot: int, first_stays: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of classes that occur twice as a whole; one copy of each class of a core with different ones: at most ``hot`` of them, and more."""
    core, whole = ["a", "b"], ["a", "b", "g", "k"]
    classes = _classes(parts.select(*[x.split()[0] for x in PART.split(", ")]), width, size)  # cheaper made twice than held
    wholes = classes.groupBy(*whole).agg(F.count("*").alias("c"), F.min(F.struct("doc", "uid", "s")).alias("first"))
    shared = wholes.groupBy(*core).agg(F.count("*").alias("kinds"), F.sum("c").alias("all")).where("all > 1")
    judged = wholes.join(shared, core).where("c > 1 or kinds > 1").select(*whole, "c", "kinds", "first")
    is_first = F.struct("doc", "uid", "s") == F.col("first")
    found = materialize(classes.join(judged, whole).withColumn("is_first", is_first).withColumn("data", F.when(is_first & (F.col("kinds") > 1), F.col("data"))))
    twice = found.where("c > 1 and not is_first" if first_stays else "c > 1").select("uid", "s", (F.col("s") + F.col("n") - 1 + width).alias("e"))
    still = found.where("data is not null")
    return twice, still.where(F.col("kinds") <= hot), still.where(F.col("kinds") > hot)


def _without(keyed: DataFrame, spans: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of keyed with their text as bytes and the list of their spans."""
    lists = spans.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return keyed.join(lists, "uid", "left").select(*columns, F.col("text").cast("binary").alias("text"), "spans")


def _keyed(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(doc.alias("doc"), row_key("doc_id", text).alias("uid"), *columns, text.alias("text"))


def _kept(text: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    cuts = merge_intervals([x["s"] for x in spans], [x["e"] for x in spans]) if spans else []
    out, at = [], 0
    for s, e in cuts:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out), cuts


def suffix_dedup(docs: DataFrame, width: int = 400, hot: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs.

    Removed is each byte covered by a string of ``width`` bytes that starts anywhere else
    in the table too, judged on the input; matches never cross rows.  A null text is
    empty; texts shorter than ``width`` keep all.  A repeated row (same id and text) is
    another place where its strings start.  A null doc_id is a row like any other.
    Other columns are not read; an empty table gives an empty result.
    """
    keyed = _keyed(docs, ["doc_id"], F.coalesce(F.col("text").cast("string"), F.lit("")))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept, cuts = _kept(text, spans)
                rows.append((doc_id, len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _without(keyed, repeated_spans(keyed, width, hot), [F.col("doc_id").cast("long").alias("doc_id")])
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, width: int = 400, hot: int = 512, first_stays: bool = False) -> DataFrame:
    """docs, with all its columns, with the repeated strings cut from text.

    Cut is each byte covered by a string of ``width`` bytes that starts anywhere else in
    the table too; with ``first_stays`` only where it also starts earlier (smaller doc_id,
    nulls last, then the row's hash, then the place in the text), so that one copy of every
    passage stays.  Judged on the input.  Characters that a cut splits go too.  A null text
    stays null, an empty one empty; a text may become empty, its row stays.  A repeated row
    (same id and text) is another place where its strings start, but is no earlier than its
    like: with ``first_stays`` both are cut alike.  Columns of any name pass unchanged; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = _keyed(docs, [], text)
    names = docs.columns
    uid, spans = fresh(names, "uid"), fresh(names, "spans")
    lists = repeated_spans(keyed, width, hot, first_stays).groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("s", "e")).alias(spans))
    joined = docs.withColumn(uid, row_key("doc_id", text)).join(lists, uid, "left").select(*names, spans)
    where = names.index("text")

    def run(batches):
        for batch in batches:
            texts, found = batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()
            out = [t if not x or t is None else _kept(t.encode(), x)[0].decode("utf-8", "ignore") for t, x in zip(texts, found, strict=True)]
            cols = [*batch.columns[:where], pa.array(out, pa.string()), *batch.columns[where + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)
