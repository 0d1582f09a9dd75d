"""Connected components and prefilters, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import forget, fresh, written

FILTER_BUCKETS = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): the smallest node that can be reached. Nodes stand in the order of a one-to-one hash;
    each goes up to the first of itself and its neighbours, and what is left of the links goes up with it, until none is left. So a round
    has only links whose ends have not met, of about half the nodes of the round before or fewer. Every round is a written table, and
    nodes with many links are split like any skewed join."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    place = lambda c: F.xxhash64(F.col(c).cast("long"))  # noqa: E731  of one long it is one-to-one
    ups = [written(both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), "m").alias("up")), "up")]
    edges = both.select(place("a").alias("a"), place("b").alias("b"))
    while True:
        up = ups[-1] if len(ups) > 1 else ups[0].select(place("node").alias("node"), "up")
        one, other = (up.select(F.col("node").alias(x), F.col("up").alias(f"{x}_up")) for x in "ab")
        # Each link stands there both ways.
        left = edges.join(one, "a").join(other, "b").where("a_up <> b_up").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct()
        left = written(left, "links")
        forget(both)
        both = edges = left
        if left.isEmpty():
            break
        ups.append(written(left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up"))
    forget(both)
    while len(ups) > 1:
        last = ups.pop()
        top = last.select(F.col("node").alias("up"), F.col("up").alias("top"))
        own = written(ups[-1].join(top, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "up")
        forget(last, ups[-1])
        ups[-1] = own
    roots = written(ups[0].join(ups[0].groupBy("up").agg(F.min("node").alias("root")), "up").select("node", "root"), "labels")
    forget(ups[0])
    return roots


def maybe_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among keys[key]: a hashed filter of FILTER_BUCKETS bits, broadcast as a table of so many rows at most."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS)).cast("int")
    own = fresh(df, "_bucket")
    there = keys.select(bucket(F.col(key)).alias(own)).distinct()
    return df.withColumn(own, bucket(F.col(key))).join(F.broadcast(there), own, "left_semi").drop(own)


def without(df: DataFrame, key: str, removed: DataFrame) -> DataFrame:
    """The rows whose key isn't among removed[key]; rows that the hashed filter clears are not shuffled."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BUCKETS)).cast("int")
    own = fresh(df, "_bucket")
    there = removed.select(bucket(F.col(key)).alias(own)).distinct()
    marked = df.withColumn(own, bucket(F.col(key)))
    clear = marked.join(F.broadcast(there), own, "left_anti").drop(own)
    rest = marked.join(F.broadcast(there), own, "left_semi").drop(own)
    return clear.unionByName(rest.join(removed.select(key).distinct(), key, "left_anti"))
