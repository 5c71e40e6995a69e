"""Connected components by contraction, in joins and aggregates.

Every vertex points to its least neighbour if that is less than itself, pointers are followed until they end, three at a time, the edges are moved to the ends and made distinct, and so on until none is left. Each turn at least halves the vertices that still have edges. A hub's neighbours meet in a partial minimum and in a join that Spark splits where it is skewed. How many edges or moved pointers there are is observed as they are written, and what a turn has read is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import release_files, settle


def counted(df: DataFrame, which: Column) -> tuple[DataFrame, int]:
    """df settled, and for how many rows the condition holds."""
    seen = Observation()
    out = settle(df.observe(seen, F.count_if(which).alias("n")))
    return out, seen.get["n"]


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (numbers, no nulls). Returns id and component_id, the least id that can be reached, for each id that has an edge to another."""
    edges, left = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), F.lit(True))
    of = None  # id, root
    while left:
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")))
        point, moved = settle(both.groupBy("id").agg(F.min("root").alias("root"))), 1
        while moved:
            hop = lambda a, b: point.select(F.col("id").alias(a), F.col("root").alias(b))  # noqa: B023, E731
            further = point.join(hop("root", "top"), "root").join(hop("top", "end"), "top").select("id", "root", "end")
            before, (jumped, moved) = point, counted(further, F.col("end") != F.col("root"))
            release_files(before)
            point = jumped.select("id", F.col("end").alias("root"))
            point.settled_at = jumped.settled_at
        to = lambda c: point.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        kept = edges.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root").select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct()
        before, (edges, left) = edges, counted(kept, F.lit(True))
        release_files(before)
        if of is None:
            of = point
        else:
            later = point.select(F.col("id").alias("root"), F.col("root").alias("top"))
            before, of = (of, point), settle(of.join(later, "root", "left").select("id", F.coalesce("top", "root").alias("root")))
            release_files(*before)
    if of is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    out = of.select("id", F.col("root").alias("component_id"))
    out.settled_at = of.settled_at
    return out
