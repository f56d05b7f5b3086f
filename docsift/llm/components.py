"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from docsift.llm.shared import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) -> a written table (node, root): equal roots exactly for nodes that a path joins.

    Each round every node points at the neighbour (or itself) whose seeded hash is least;
    the pointed-at nodes form the next, smaller graph. A constant share of the nodes goes
    each round whatever the shape, so a chain takes as few rounds as a star. Minima
    combine before the shuffle, so a hub isn't gathered in one task, and each round is
    a written table. Nulls and self-loops are ignored; repeated edges count once; nodes
    without an edge aren't in the result. Type of a and b: any one atomic type.
    """
    edges = materialize(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "cc-edges"
    )
    maps, turn = [], 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        h = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        reps = materialize(
            both.groupBy("a").agg(F.min(h("b")).alias("m")).select(F.col("a").alias("node"), F.least(h("a"), "m")["v"].alias("root")),
            "cc-map",
        )
        left = edges.join(reps.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        left = left.join(reps.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        smaller = materialize(left.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges")
        drop_table(edges)
        maps.append(reps)
        edges, turn = smaller, turn + 1
    kind = edges.schema["a"].dataType
    drop_table(edges)
    if not maps:
        return edges.sparkSession.createDataFrame([], StructType([StructField("node", kind), StructField("root", kind)]))
    out = maps[-1]
    for reps in reversed(maps[:-1]):  # from the last contraction outwards
        step = reps.select("node", F.col("root").alias("via"))
        out = step.join(out.withColumnRenamed("node", "via"), "via", "left").select(
            "node", F.coalesce("root", "via").alias("root")
        )
    out = materialize(out, "components")
    for reps in maps:
        drop_table(reps)
    return out
