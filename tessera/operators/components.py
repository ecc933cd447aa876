"""Connected components, and the discovery of synonymous skills."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors as V
from tessera.session import scratch_dir


#: Rows of a stored file, at least: rounds are many and their tables small.
PER_FILE = 50_000


def connected_components(nodes: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """nodes (key) and links (src, dst) to (key, component): the least key that is reachable; links that lead to no node are passed over.

    Each round gives every label the least one linked with it and then that one's own, so a chain of n takes about log n rounds; links go on
    between labels, and those within one are spent. Every round ends in files: a checkpoint would keep its plan's estimated size, and as the
    estimate of a join is a product, the driver would hold numbers whose digits double with each round."""
    spark = nodes.sparkSession
    root, made = f"{scratch_dir(spark)}/components-{uuid.uuid4().hex}", []

    def store(df: DataFrame, rows: int | None = None) -> DataFrame:
        made.append(f"{root}/{len(made)}")
        (df if rows is None else df.coalesce(max(1, -(-rows // PER_FILE)))).write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    def between(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("src"), F.greatest(x, y).alias("dst")]

    ids = store(nodes.select(F.col(key).alias("id")).distinct())
    edges = links.where("src <> dst").select(*between("src", "dst")).distinct()
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    n = (edges := store(edges)).count()
    labels = ids.withColumn("label", F.col("id"))
    while n:
        least = edges.select("src", "dst").union(edges.select("dst", "src")).groupBy("src").agg(F.min("dst").alias("low"))
        least = least.select(F.col("src").alias("old"), F.least("src", "low").alias("new"))
        hop = least.select(F.col("old").alias("new"), F.col("new").alias("far"))
        moved = least.join(hop, "new", "left").select("old", F.coalesce("far", "new").alias("new")).where("old <> new")
        moved = store(moved, 2 * n)
        labels = labels.join(moved, labels["label"] == moved["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
        a, b = moved.select(F.col("old").alias("src"), F.col("new").alias("x")), moved.select(F.col("old").alias("dst"), F.col("new").alias("y"))
        again = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("x", "src").alias("x"), F.coalesce("y", "dst").alias("y"))
        n = (edges := store(again.where("x <> y").select(*between("x", "y")).distinct(), n)).count()
    out = store(labels.select(F.col("id").alias(key), F.col("label").alias("component")))
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, made[:-1]):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


#: Vectors of a block; two blocks, and the products of STRIP rows with one of them, are what a task holds. Fewer than FEW blocks of SMALL
#: vectors each would leave cores idle.
BLOCK, STRIP, FEW, SMALL = 8192, 256, 8, 1024


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the vectors that can be similar to any: none null, empty, zero or non-finite, none without a key. Floats stay floats, which halves what is sent."""
    v = F.col(vector) if df.schema[vector].dataType == T.ArrayType(T.FloatType()) else V.doubles(F.col(vector))
    size = V.norm(V.doubles(F.col(vector)))
    return df.where(V.valid(F.col(vector)) & F.col(key).isNotNull()).where((size > 0) & (size < float("inf"))).select(F.col(key).alias("id"), v.alias("v"))


def _close(a: np.ndarray, b: np.ndarray | None, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b, or of a and later ones of a, whose cosine distance is at most eps, a strip at a time. Products in single precision
    tell all but those next to the limit, which double precision tells."""
    a32, error = a.astype("f4"), (a.shape[1] + 8) * 2.0**-23
    b, b32 = (a, a32) if (own := b is None) else (b, b.astype("f4"))
    for at in range(0, len(a), STRIP):
        m = a32[at : at + STRIP] @ b32[at if own else 0 :].T
        r, c = np.divmod(np.flatnonzero(m >= 1 - eps - error), m.shape[1])
        near = m[r, c] < 1 - eps + error
        r, c = r + at, c + (at if own else 0)
        if own:
            r, c, near = (x[r < c] for x in (r, c, near))
        for k in range(0, len(doubt := np.flatnonzero(near)), 65536):
            d = doubt[k : k + 65536]
            near[d] = ~(1 - np.einsum("ij,ij->i", a[r[d]], b[c[d]]) <= eps)
        yield r[~near], c[~near]


def _join(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a with b in least, which has the least member of each one's set."""
    a, b = least[a], least[b]
    while (two := a != b).any():
        a, b = a[two], b[two]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while ((far := least[least]) != least).any():
            least[:] = far
        a, b = least[a], least[b]


def _products(v: DataFrame, eps: float, every: bool) -> DataFrame:
    """src and dst of _usable() vectors within eps, each block's with itself and with each other one in a task of its own: every pair, or as
    many as connect what these would, so no more than the task has vectors."""
    n = v.count()
    blocks = max(1, -(-n // BLOCK), min(FEW, -(-n // SMALL)))
    v = v.withColumn("own", F.pmod(F.hash("id"), F.lit(blocks)))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = v.select("id", "v", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def meet(t: pa.Table) -> pa.Table:
        ids, own, i, j = t["id"].combine_chunks(), t["own"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        if pc.count_distinct(pc.list_value_length(t["v"])).as_py() > 1:
            raise ValueError("vectors of different lengths")
        order = np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable")
        x = pc.list_flatten(t["v"]).to_numpy().astype("f8").reshape(len(t), -1)[order]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        a, b = (np.flatnonzero(own[order] == k) for k in (i, j))
        src, dst, least = [], [], np.arange(len(t))
        for r, c in _close(x[a], None if i == j else x[b], eps):
            r, c = a[r], b[c]
            if every:
                src.append(np.minimum(r, c))
                dst.append(np.maximum(r, c))
            else:
                _join(least, r, c)
        if not every:
            dst.append(np.flatnonzero(least != np.arange(len(t))))
            src.append(least[dst[0]])
        src, dst = (order[np.concatenate([np.zeros(0, dtype="i8"), *p])] for p in (src, dst))
        return pa.table({"src": ids.take(pa.array(src)), "dst": ids.take(pa.array(dst))})

    kind = v.schema["id"].dataType
    out = v.groupBy("i", "j").applyInArrow(meet, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)]))
    return out.where("src <> dst")


def similar_pairs(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """Pairs (src < dst) whose cosine distance is at most eps, exactly, by matrix products of blocks. For dictionaries, whose size does not
    follow that of the data: the products take time with the square of the number of vectors, each of which meets half of the blocks
    once. Every vector's length must be the same; null, zero and non-finite ones are in no pair."""
    return _products(_usable(df, key, vector), eps, every=True)


def similar_components(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """Each key with the least one that similar_pairs would lead to, without making the pairs: vectors that are equal meet others once, and of
    what meets in a task there are fewer links than vectors."""
    spark = df.sparkSession
    scratch_dir(spark)
    v = _usable(df, key, vector)
    classes = v.groupBy("v").agg(F.min("id").alias("src"), F.count("*").alias("n")).checkpoint()
    copies = v.join(classes.where("n > 1"), "v").select("src", F.col("id").alias("dst")).where("src <> dst")
    return connected_components(df.select(key), _products(classes.select(F.col("src").alias("id"), "v"), eps, every=False).union(copies), key)


def skill_synonyms(skills: DataFrame, eps: float = 0.3) -> DataFrame:
    """Density clusters with one member at least, so: components of the graph of skills (position, skills, embedding) within eps.
    Each gives its shortest name (the first of them on a tie) in lower case, the mean vector and the aliases in order."""
    parts = similar_components(skills, "position", "embedding", eps)
    all_ = skills.join(parts, "position")
    names = all_.groupBy("component").agg(
        F.lower(F.min(F.struct(F.length("skills"), "position", "skills"))["skills"]).alias("canonical"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", "skills"))), lambda s: s["skills"]).alias("aliases"),
    )
    means = all_.select("component", F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x")).groupBy("component", "pos").agg(F.avg("x").alias("x"))
    means = means.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))
    return names.join(means, "component", "left")


