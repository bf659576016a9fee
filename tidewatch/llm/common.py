"""Shared pieces of the training-data operators: tables, durable cuts, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir, shared_path
from ..sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, label: str) -> str:
    return shared_path(spark, label)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty: Python workers get ``bytes`` and decode nothing."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of ``edges`` (columns ``a``, ``b``); returns (node, root).

    Each round hooks every node to its smallest neighbour, follows the pointers to the roots (each pass
    doubles their reach), and rewrites the edges between roots, until no edge is left. Both sides of every join are written copies, which lets
    adaptive execution split a node that holds many edges. Self links and nulls are ignored.
    """
    work = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    hooks: list[DataFrame] = []
    while not work.isEmpty():
        if len(hooks) >= rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = work.union(work.select(F.col("b"), F.col("a"))).toDF("u", "v")
        hook = cut(
            both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        )
        while True:
            up = hook.toDF("u2", "p2")
            further = cut(hook.join(up, hook.p == up.u2).select("u", F.col("p2").alias("p"), (F.col("p2") != F.col("p")).alias("moved")))
            hook = further.select("u", "p")
            if further.where("moved").isEmpty():
                break
        ra, rb = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        moved = work.join(ra, "a").select("b", "ra").join(rb, "b").where("ra <> rb")
        work = cut(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        hooks.append(hook)
    if not hooks:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("a").alias("node"), F.col("b").alias("root")).schema)
    found = hooks[0].toDF("node", "root")
    for hook in hooks[1:]:
        up = hook.toDF("root", "next")
        found = cut(found.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return found
