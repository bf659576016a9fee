"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are a class and are compared once. Unit vectors are turned onto the principal axes of the corpus, so the
leading coordinates hold most of every inner product. Tiles of a label are compared by accumulating
blocks of leading dimensions; what is left of a product is bounded by the norms of the rests, and a tile
pair stops as soon as no cosine can reach the threshold. Pairs that stay are decided in double precision
on the given vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, table
from .simhash import forest

THRESHOLD = 0.93
#: Different vectors of one label that are a side of a task's comparison.
CHUNK = 2048
#: Vectors of a tile inside a task.
TILE = 512
#: A class with this part of all rows is joined by broadcast: there are at most so many.
HOT = 200
#: Least number of leading dimensions of the first block; each block doubles what has been summed.
LEAD = 8


def usable(vec: str) -> Column:
    c = F.col(vec)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Principal axes (columns, strongest first) of the unit vectors: one dims x dims sum for each task comes together."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            x /= np.linalg.norm(x, axis=1)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims * dims), pa.int32()), pa.array(total.ravel())], names=["k", "x"])

    sums = vectors.select("v").mapInArrow(outer, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros(dims * dims)
    total[sums["k"].to_numpy()] = sums["x"].to_numpy()
    return np.linalg.eigh(total.reshape(dims, dims))[1][:, ::-1].copy()


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def close_pairs(a: np.ndarray, b: np.ndarray, turn: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b whose cosine is ``least`` or more, tile by tile (i < j if ``same``)."""
    la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ta, tb = (a / la[:, None]) @ turn, (b / lb[:, None]) @ turn
    dims = turn.shape[1]
    ends, at = [], min(LEAD, dims)
    while at < dims:
        ends.append(at)
        at *= 2
    ends.append(dims)
    rest = lambda t: [np.sqrt(np.maximum((t[:, e:] ** 2).sum(axis=1), 0)) for e in ends]  # noqa: E731  norms behind each end
    ra, rb = rest(ta), rest(tb)
    order_a, order_b = np.argsort(ta[:, 0]), np.argsort(tb[:, 0])
    slack = least - 1e-9  # sums in another order may differ by so much
    for x in range(0, len(a), TILE):
        ia = order_a[x : x + TILE]
        for y in range(x if same else 0, len(b), TILE):
            ib = order_b[y : y + TILE]
            begin, dots = 0, np.zeros((len(ia), len(ib)))
            for k, end in enumerate(ends):
                dots += ta[ia, begin:end] @ tb[ib, begin:end].T
                begin = end
                hope = dots + ra[k][ia][:, None] * rb[k][ib][None, :] >= slack
                if not hope.any():
                    break
                if hope.sum() <= 4 * TILE:  # few are left: decide them alone
                    break
            i, j = np.nonzero(hope)
            i, j = ia[i], ib[j]
            if same:
                i, j = i[i != j], j[i != j]
                if x == y:
                    i, j = i[i < j], j[i < j]
            if len(i):
                cos = (a[i] * b[j]).sum(axis=1) / (la[i] * lb[j])
                keep = cos >= least
                yield i[keep], j[keep]


def links(vectors: DataFrame, dims: int, least: float) -> DataFrame:
    """``vectors``: (num, label, v, n), different vectors with their numbers of rows. Returns (num, n_linked, root):
    for each class and pair of chunks the rows linked there, and the first class of its component there."""
    turn = axes(vectors, dims)
    sizes = vectors.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = vectors.join(F.broadcast(sizes), "label") if sizes.count() <= 100_000 else vectors.join(sizes, "label")
    mine = F.pmod(F.xxhash64("num"), F.col("chunks")).cast("int")
    # chunk c meets chunk d in cell (min, max): each vector goes to one cell for each chunk of its label
    dealt = dealt.withColumn("c", mine).select("num", "v", "n", "label", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("d"))
    dealt = dealt.withColumns({"lo": F.least("c", "d"), "hi": F.greatest("c", "d")}).withColumn("second", F.col("c") != F.col("lo"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        num, n = cell["num"].to_numpy(), cell["n"].to_numpy()
        second = cell["second"].to_numpy()
        left, right = np.flatnonzero(~second), np.flatnonzero(second)
        same = cell["lo"].iloc[0] == cell["hi"].iloc[0]
        if not same and (not len(left) or not len(right)):
            return pd.DataFrame({"num": num[:0], "n_linked": n[:0], "root": num[:0]})
        right = left if same else right
        v = np.stack(cell["v"].to_numpy()).astype(np.float64)
        linked = np.zeros(len(num), np.int64)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for i, j in close_pairs(v[left], v[right], turn, least, same):
                i, j = left[i], right[j]
                np.add.at(linked, i, n[j])
                np.add.at(linked, j, n[i])
                yield i, j

        root = forest(len(num), found())
        some = np.flatnonzero(linked)
        return pd.DataFrame({"num": num[some], "n_linked": linked[some], "root": num[root[some]]})

    return dealt.groupBy("label", "lo", "hi").applyInPandas(compare, "num long, n_linked long, root long")


def near_duplicates(vectors: DataFrame, least: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Rows link if their labels are equal and their cosine is ``least`` or more. Null labels, and vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Repeated rows link with each other; an id that repeats gives a row each; an empty
    table gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    rows = rows.withColumn("v", F.when(F.col("label").isNotNull() & usable("v"), F.transform("v", lambda x: x + F.lit(0).cast("float"))))  # -0 becomes 0
    # A class is all rows of one label and vector. Its name is their digest, of 256 bits; links know it by a number.
    digest = F.unhex(F.sha2(F.to_json(F.struct("label", "v")).cast("binary"), 256))
    rows = cut(rows.withColumn("cls", F.when(F.col("v").isNotNull(), digest)))
    grouped = rows.where("cls is not null").groupBy("cls").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least"))
    classes = cut(grouped.withColumn("num", F.monotonically_increasing_id()))
    found = vectors.sparkSession.createDataFrame([], "num long, n_linked long, root long")
    for r in classes.groupBy(F.size("v").alias("dims")).agg(F.count("*")).orderBy("dims").collect():  # one length in a table of one model
        found = found.unionByName(links(classes.where(F.size("v") == r.dims).select("num", "label", "v", "n"), r.dims, least))
    found = cut(found)

    roots = connected_components(found.select(F.col("num").alias("a"), F.col("root").alias("b"))).toDF("num", "root")
    linked = found.groupBy("num").agg(F.sum("n_linked").alias("n_linked"))
    # both sides of the join by root are written tables, so that a root of many classes can be split
    firsts = cut(classes.select("num", "cls", "n", "least").join(roots, "num", "left").withColumn("root", F.coalesce("root", "num")))
    smallest = cut(firsts.groupBy("root").agg(F.min("least").alias("component_id")))
    of = cut(
        firsts.join(smallest, "root").join(linked, "num", "left")
        .select("cls", "n", "component_id", (F.coalesce("n_linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    )
    # Rows of no class need no join; those of large classes, HOT at most, are not dealt by class.
    narrow, known = rows.select("id", "cls"), of.drop("n")
    large = F.broadcast(of.where(F.col("n") * HOT >= max(1, rows.count())).drop("n"))
    marked = narrow.where("cls is not null").join(large, "cls", "left")
    done = marked.where("n_links is not null")
    rest = marked.where("n_links is null").select("id", "cls").join(known, "cls")
    alone = narrow.where("cls is null").select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = done.select("id", "component_id", "n_links").unionByName(rest.select("id", "component_id", "n_links")).unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x <> 0)) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
n as (select *, sqrt(list_dot_product(e, e)) as norm from v),
link as (select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
         where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a),
component as (select a as vec_id, min(b) as component_id from reach group by a),
degree as (select a as vec_id, count(*) as n_links from link group by a)
select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from component c left join degree using (vec_id)
"""
