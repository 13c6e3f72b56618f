"""Connected components of a graph given as a table of edges.

Each round every vertex takes its least neighbour (by a hash, so that the order
is random) as its parent, jumps once over that parent, and the edges are drawn
between the parents. At least every other vertex with an edge leaves in a round,
so the number of rounds is logarithmic; nothing but an emptiness test comes to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save


def _ranked(col):
    return F.struct(F.xxhash64(col).alias("h"), col.alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for each vertex with an edge; equal roots mean one component.

    ``edges`` has columns ``a`` and ``b`` of type long. Loops, repeated and
    reversed edges are allowed; rows with a null are left out; without edges
    there are no rows.
    """
    spark = edges.sparkSession
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    left = save(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a is not null and a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both.groupBy("u").agg(F.min(_ranked(F.col("v"))).alias("v"))
        parent = save(near.select("u", F.least(_ranked(F.col("u")), F.col("v"))["id"].alias("p")), "parents")
        jumped = parent.join(parent.select(F.col("u").alias("p"), F.col("p").alias("g")), "p").select("u", F.col("g").alias("p"))
        jumped = save(jumped, "parents")
        maps.append(jumped)
        one = jumped.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        two = jumped.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        drawn = left.join(one, "a").join(two, "b").where("pa <> pb")
        left = save(drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], "id long, root long")
    known = maps[-1].select(F.col("u").alias("id"), F.col("p").alias("root"))
    for m in reversed(maps[:-1]):
        up = known.select(F.col("id").alias("p"), "root")
        known = save(m.join(up, "p", "left").select(F.col("u").alias("id"), F.coalesce("root", "p").alias("root")), "roots")
    return known
