"""Connected components of a distributed link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(sides: DataFrame) -> DataFrame:
    """For each node u: the least of itself and its neighbours v. Written, so that a join with it exchanges both sides."""
    return staged(sides.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that is in a link; root is the least node of its component.

    Nothing leaves the executors. Every step reduces before it exchanges (a node with many neighbours is one row for each
    task), joins two exchanged sides, which AQE splits where a node is hot, and is written to the shared folder.
    """
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u hang on the least node around u
        large = staged(
            both.join(_least(both).hint("merge"), F.col("u") == F.col("x"))
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            "large-star",
        )
        # small star: u and its neighbours below hang on the least of them
        small = (
            large.join(_least(large).hint("merge"), F.col("u") == F.col("x"))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        small = staged(small, "small-star")
        # stars that no step changes are the components
        same = edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty()
        edges = small
        if same:
            break
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.unionByName(own.select(F.col("root").alias("node"), "root").distinct())
