"""Exact cosine neighbours of a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: queries multiplied at a time; larger query sets are worked off in several passes
BLOCK = 8_192


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): the k rows most alike to every query, itself left out, ties by id.

    A block of queries (at most ``BLOCK``) is sent to all tasks; every task multiplies it with its batches and keeps k
    candidates per query and batch, which are merged by query. Null vectors are left out, zero vectors have similarity 0.
    """
    spark = vectors.sparkSession
    own = queries.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(id_col, vector)
    n = own.count()
    passes = max(1, -(-n // BLOCK))
    numbered = own.withColumn("_pass", F.pmod(F.xxhash64(id_col), F.lit(passes)))
    out = None
    for i in range(passes):
        rows = numbered.where(F.col("_pass") == i).orderBy(id_col).collect()
        if not rows:
            continue
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        q = _unit(np.array([r[1] for r in rows], dtype=np.float64))
        shared = spark.sparkContext.broadcast((ids, q))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for pdf in batches:
                pdf = pdf[pdf["v"].notna()]
                if not len(pdf):
                    continue
                other = pdf["id"].to_numpy()
                s = np.round(q @ _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64)).T, 12)
                s[ids[:, None] == other[None, :]] = -np.inf
                take = min(k, s.shape[1])
                order = np.lexsort((np.broadcast_to(other, s.shape), -s), axis=1)[:, :take]
                best = np.take_along_axis(s, order, axis=1)
                found = pd.DataFrame({"query_id": np.repeat(ids, take), "neighbour_id": other[order].ravel(), "similarity": best.ravel()})
                yield found[np.isfinite(found["similarity"])]

        part = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(
            scan, "query_id bigint, neighbour_id bigint, similarity double"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id bigint, neighbour_id bigint, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "neighbour_id", "similarity")


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
