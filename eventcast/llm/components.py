"""Connected components of links between keys, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventcast.operators.attach import attach
from eventcast.session import stage


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, least) over both ends; combined before the shuffle, so a hub costs no more than others."""
    return pairs.groupBy("u").agg(F.min("v").alias("least"))


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(key, root) for every key in links (a, b) of one type; root is the least key reachable.

    Every round points the larger neighbours of each key, then the smaller ones, at its least neighbour,
    until nothing changes. Each round is written to the shared folder. Rows with a null are left out.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage(pairs)
    mark = _mark(pairs)
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(_least_neighbour(both).select("u", F.least("u", "least").alias("least")))
        large = attach(both.filter("v > u"), least, "u", staged=True).select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = stage(large.filter("u <> v").distinct())
        least = stage(_least_neighbour(large))
        small = attach(large, least, "u", staged=True)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", "least"))
        pairs = stage(small.filter("u <> v").distinct())
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("key"), F.col("v").alias("root")).union(roots)
