"""Trails and reachability over an edge table (src, dst, type, eid).

Trails never repeat an edge but may revisit a node.  Plans carry ids only; properties are
joined by the caller at the end.  Up to UNROLLED steps make one lazy plan; deeper ones
hold every level in the shared folder, so that neither the plan nor a recomputation grows
with the square of the depth.  Join strategies are left to Catalyst and AQE, which
broadcast a side only by its measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import with_edge_ids
from ..storage import held

UNROLLED = 3
DIRECTIONS = ("outgoing", "incoming", "both")


def typed(edges: DataFrame, types: str | list[str] | None) -> DataFrame:
    """Edges of the named types (a list, or a comma list); all if none is named."""
    names = types.split(",") if isinstance(types, str) else types or []
    names = [t.strip() for t in names if t.strip()]
    return edges.where(F.col("type").isin(names)) if names else edges


def steps(edges: DataFrame, types: str | list[str] | None = None, direction: str = "outgoing") -> DataFrame:
    """(at, to, src, dst, type, eid): where an edge leads from; both ways share the edge's eid, a loop counts once."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    e = typed(edges, types)
    e = e if "eid" in e.columns else with_edge_ids(e)
    ahead = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst", "type", "eid")
    back = e.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "dst", "type", "eid")
    if direction == "both":
        return ahead.unionByName(back.where("src != dst"))
    return ahead if direction == "outgoing" else back


def trails(edges: DataFrame, starts: DataFrame, types=None, direction: str = "outgoing", depth: int = 1, least: int = 1, most_depth: int = 6) -> DataFrame:
    """All trails of ``least`` (0 or 1) to ``depth`` edges from the ids in starts.

    Returns start, end, depth, node_ids (from the start on) and edges (array of src, dst,
    type as stored).  The number of trails can grow exponentially with depth: more than
    ``most_depth`` must be asked for.  Null ids start nothing; repeated ids start once;
    without starts or edges the result is empty.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    if depth > most_depth:
        raise ValueError(f"depth {depth} is over most_depth {most_depth}")
    step = steps(edges, types, direction)
    link = F.struct("src", "dst", "type")
    seed = starts.select(F.col("id").alias("start")).where("start is not null").distinct()
    none = F.array().cast("array<struct<src:string,dst:string,type:string>>")
    level = seed.select("start", F.col("start").alias("end"), F.lit(0).alias("depth"), F.array("start").alias("node_ids"), none.alias("edges"), F.array().cast("array<bigint>").alias("eids"))
    levels = [level] if least == 0 else []
    for d in range(1, depth + 1):
        met = level.join(step, (level["end"] == step["at"]) & ~F.array_contains(level["eids"], step["eid"]))
        level = met.select("start", F.col("to").alias("end"), F.lit(d).alias("depth"), F.array_append("node_ids", F.col("to")).alias("node_ids"), F.array_append("edges", link).alias("edges"), F.array_append("eids", F.col("eid")).alias("eids"))
        if depth > UNROLLED:
            level = held(level)
        levels.append(level)
    if not levels:
        return level.where("false").drop("eids")
    return reduce(DataFrame.unionByName, levels).drop("eids")


def trails_recursive(spark: SparkSession, edges: DataFrame, starts: DataFrame, types=None, direction: str = "outgoing", depth: int = 1) -> DataFrame:
    """The trails of ``trails`` (1 to depth edges) by a recursive common table expression."""
    return spark.sql(
        """
        WITH RECURSIVE walk AS (
          SELECT DISTINCT id AS start, id AS `end`, 0 AS depth, array(id) AS node_ids, CAST(array() AS array<bigint>) AS eids FROM {starts} WHERE id IS NOT NULL
          UNION ALL
          SELECT start, s.to, depth + 1, array_append(node_ids, s.to), array_append(eids, s.eid)
          FROM walk JOIN {steps} s ON walk.`end` = s.at WHERE depth < :depth AND NOT array_contains(eids, s.eid)
        ) SELECT start, `end`, depth, node_ids FROM walk WHERE depth > 0
        """,
        args={"depth": depth},
        starts=starts,
        steps=steps(edges, types, direction),
    )


def reachable(edges: DataFrame, starts: DataFrame, types=None, direction: str = "incoming", depth: int = 1) -> DataFrame:
    """Distinct ids at the end of a directed trail of 1 to ``depth`` edges from the ids in starts.

    A start is among them only if it lies on a cycle of at most that length.  Depth 0 gives
    no rows.  Each step expands what the one before found; searches of more than UNROLLED
    steps hold every level, expand new ids only and stop when there are none.
    """
    if depth < 0:
        raise ValueError("depth must not be negative")
    if direction == "both":
        raise ValueError("an edge walked forth and back is no trail: take trails()")
    step = steps(edges, types, direction).select("at", "to")
    seed = starts.select("id").where("id is not null").distinct()
    if depth == 0:
        return seed.where("false")
    # every level makes only what it has found distinct, never the edges
    expand = lambda ids: ids.join(step, ids["id"] == step["at"]).select(F.col("to").alias("id")).distinct()
    levels = [expand(seed)]
    for _ in range(1, depth):
        if depth <= UNROLLED:
            levels.append(expand(levels[-1]))
            continue
        levels[-1] = held(levels[-1])
        if levels[-1].isEmpty():
            break
        levels.append(expand(levels[-1]).join(reduce(DataFrame.unionByName, levels), "id", "left_anti"))
    found = reduce(DataFrame.unionByName, levels)
    return found.distinct() if 1 < depth <= UNROLLED else found
