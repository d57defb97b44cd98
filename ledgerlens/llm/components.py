"""Connected components by alternating large-star and small-star rounds.

Links stay in DataFrames.  Each round is written to the shared checkpoint
folder, so lost executors cost one round; the round before it is removed then.  Every step is an equi-join or a
grouped minimum with a partial aggregate, and adaptive execution may split the
join's hot keys: no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_path, materialize, scratch_path, shuffles_removed


def _both_ways(links: DataFrame) -> DataFrame:
    pair = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return links.select(F.explode(pair).alias("p")).select("p.u", "p.v")


def _large_star(links: DataFrame) -> DataFrame:
    around = _both_ways(links)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # every larger neighbour of u is linked to the least node of u's star
    return (
        around.where("v > u")
        .join(least, "u")
        .select(F.col("m").alias("a"), F.col("v").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    pairs = joined.select(
        F.explode(
            F.array(
                F.struct(F.col("m").alias("a"), F.col("v").alias("b")),
                F.struct(F.col("m").alias("a"), F.col("u").alias("b")),
            )
        ).alias("p")
    )
    return pairs.select("p.a", "p.b").where("a <> b").distinct()


def _digest(links: DataFrame) -> tuple:
    with shuffles_removed(links.sparkSession):
        row = links.select(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("a", "b")).alias("x"),
        ).first()
    return row.n, row.x


def components(links: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(id, label)`` for every node of ``links (a, b)``: the least node it reaches.

    Null ends and self links are ignored; repeated links do no harm.  A node
    in no link has no row.  Raises if ``max_rounds`` rounds do not converge.
    """
    spark = links.sparkSession
    clean = links.where("a is not null and b is not null and a <> b")
    folder = scratch_path(spark, f"{name}-round")
    current = materialize(
        clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name, folder
    )
    seen = _digest(current)
    if seen[0] == 0:
        return current.select(F.col("b").alias("id"), F.col("a").alias("label"))
    for _ in range(max_rounds):
        before, folder = folder, scratch_path(spark, f"{name}-round")
        current = materialize(_small_star(_large_star(current)), name, folder)
        delete_path(spark, before)
        now = _digest(current)
        if now == seen:
            # a star forest: each member is linked to its centre only
            members = current.select(F.col("b").alias("id"), F.col("a").alias("label"))
            centres = current.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
            return members.unionByName(centres)
        seen = now
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
