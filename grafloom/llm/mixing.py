"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source streams its documents in a hashed order, up to three times over.  A
document's virtual finish time is the source's cumulative words so far divided by the
source's weight (its target); one global order by finish time, cut where the total budget
is used up, is the mix.  Prefix sums are taken in two levels (hash buckets, then rows), and
the cut is found in two levels of a grid of finish times and then among the few documents
of one fine step, so no source and no range of finish times has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialize

#: Hash buckets of a source, and steps of the finish-time grid up to time 2.
BUCKETS = 4096
GRID = 8192
REPEATS = 3


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to (key, source, source_size): one row a source.

    The total of all sizes is shared by weight; no target exceeds REPEATS times its
    source, and what is over goes to the others by weight.  Sources in order of cap per
    weight reach their caps in that order, so the level at which sharing ends is found
    in one pass over running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = ranked.withColumn("budget", total).withColumn("level", (F.col("budget") - before).cast("double") / after)
    ends = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))
    level = F.min(ends).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("key", "source_size", "rank", "budget", "target")


def _finish(epoch: int) -> Column:
    """Finish time of a document in a round; null where its service starts after the source has its target."""
    upto = F.col("cum") + epoch * F.col("source_size")
    return F.when((F.col("size") > 0) & (upto - F.col("size") < F.col("target")), upto.cast("double") / F.col("target"))


def _steps(epoch: int) -> list[Column]:
    """Step of the grid, and step of the finer grid inside it; null with the finish time (least() alone would pass over the null)."""
    at = F.least(_finish(epoch), F.lit(2.0)) * GRID
    there = _finish(epoch).isNotNull()
    return [F.when(there, F.floor(at)), F.when(there, F.floor((at - F.floor(at)) * GRID))]


def _place(epoch: int) -> Column:
    """The global order: finish time, then fixed tie-breaks."""
    return F.struct(_finish(epoch).alias("finish"), F.col("rank").alias("rank"), F.lit(epoch).alias("epoch"), F.col("h").alias("h"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))


def _mixed(docs: DataFrame, extra: list[Column], names: list[str]) -> DataFrame:
    """doc_id, size, source_size, target, how many times the mix takes the row, and the extra columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), F.col("text").cast("string")), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), h.alias("h"), *extra).withColumn("key", key).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")))
    sums = rows.groupBy("key", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("key").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size")))
    lower = F.coalesce(F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("key", "bucket", lower.alias("offset")).join(targets, "key")
    running = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size", *names).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    timed = materialize(rows.withColumn("running", running).join(offsets, ["key", "bucket"]).select("doc_id", "size", "h", "source_size", "rank", "budget", "target", *names, (F.col("offset") + F.col("running")).alias("cum")))

    # the budget ends in one step of the grid, and in one step of a finer grid inside it
    inside, left, found = [F.lit(True)] * REPEATS, None, []
    for level in range(2):
        here = [F.when(x, _steps(e)[level]) for e, x in enumerate(inside)]
        # one row a step: at most 2 * GRID + 1
        steps = timed.select("size", "budget", F.explode(F.array(*here)).alias("step")).where("step is not null").groupBy("step").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
        upto = F.sum("words").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        room = F.col("budget") if left is None else F.lit(left)
        over = steps.withColumn("upto", upto).where(F.col("upto") > room).orderBy("step").select("step", (room - F.col("upto") + F.col("words")).alias("left")).first()
        if over is None:
            break
        left = over["left"]
        found.append(over["step"])
        inside = [x & (_steps(e)[level] == over["step"]) for e, x in enumerate(inside)]
    items = [F.lit(True)] * REPEATS
    if found:
        first, second = found  # what is over in a step is over in one of its own steps
        places = timed.select("size", F.explode(F.array(*[F.when(x, _place(e)) for e, x in enumerate(inside)])).alias("place")).where("place is not null")
        cut = places.withColumn("used", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("used") <= left).agg(F.max("place").alias("place")).first()["place"]
        items = [(_steps(e)[0] < first) | ((_steps(e)[0] == first) & (_steps(e)[1] < second)) for e in range(REPEATS)]
        if cut:
            last = F.struct(F.lit(cut["finish"]).cast("double").alias("finish"), F.lit(cut["rank"]).alias("rank"), F.lit(cut["epoch"]).alias("epoch"), F.lit(cut["h"]).alias("h"), F.lit(cut["doc_id"]).cast("long").alias("doc_id"), F.lit(cut["size"]).cast("long").alias("size"))
            items = [before | (x & (_place(e) <= last)) for e, (before, x) in enumerate(zip(items, inside, strict=True))]
    times = sum((F.when(F.coalesce(x, F.lit(False)) & (F.col("size") > 0), 1).otherwise(0) for x in items), F.lit(0))
    return timed.select("doc_id", "size", "source_size", "target", times.alias("times"), *names)


def mix_sources(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row of docs.

    A null text has size 0 and is never taken; null is a source of its own, the last one.
    A null doc_id is ordered by its text.  Repeated rows are separate documents.
    Documents are taken whole, at most three times; the total stays within the sum of all
    sizes.  Columns other than doc_id, text and source are not read; an empty table gives
    an empty result.
    """
    return _mixed(docs, [], []).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def take_mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each as many times as the mix takes it.

    Taking is decided on hashes alone; texts are moved once, to meet the decision of the
    row with their id, source and content.  Null, empty and blank texts have size 0 and are
    left out; null is a source of its own; a null doc_id is ordered by its text.  Repeated
    rows are separate documents: one of them stands for all, as often as all are taken.
    Columns of any name pass unchanged; an empty table gives an empty result.
    """
    mark, times = fresh(docs.columns, "tag"), fresh(docs.columns, "times")
    tag = F.xxhash64("doc_id", "source", "text")
    decided = _mixed(docs, [tag.alias("tag")], ["tag"]).where("times > 0").groupBy(F.col("tag").alias(mark)).agg(F.sum("times").cast("int").alias(times))
    rows = docs.withColumn(mark, tag).join(decided, mark).dropDuplicates([mark])
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
