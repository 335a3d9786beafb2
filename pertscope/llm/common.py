"""Helpers shared by the text operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Fixed values of the contracts: ASCII white space separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def text_of(df: DataFrame) -> Column:
    """The text column, a null read as the empty text."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def words(col: Column) -> Column:
    """Array of the words of a text; empty for a text without any."""
    return F.filter(F.split(col, SPACE), lambda w: w != "")


def n_words(col: Column) -> Column:
    """Number of words, counted as word starts without building the array."""
    return F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs.

    Alternates large-star and small-star contractions, each a map-side
    combined minimum and an equi-join; every round is written to the shared
    folder, so a lost executor costs one round.  Returns ``(node, component)``
    with the smallest node of each component, for every node on an edge.
    Empty edges give an empty table; self edges are ignored.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .distinct(), f"{name}-edges")

    def state(df: DataFrame):
        r = df.agg(F.count("*").alias("n"),
                   F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen = state(cur)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        cur = materialize(small, f"{name}-round")
        now = state(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.groupBy("u").agg(F.min("v").alias("component"))
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.withColumnRenamed("u", "node").unionByName(roots)
