"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are kept as postings: for each component, the rows where it isn't zero and their weights. A block of queries
goes through its components one at a time; each scatters its weighted postings into the block's dense array of
scores. The best of each block of candidates are found by partition selection, and blocks are merged by rank. Tasks hold
one block of queries against one block of candidates, both of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pick

#: Queries and candidates of one task.
QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Queries whose scores are dense at once within a task.
AT_ONCE = 128


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null for vectors that are null or hold a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNull() | bad, None).otherwise(F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, a term at a time; 64-bit where 32 bits might not hold them."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    kind = np.int32 if bound < 1 << 31 else np.int64
    q, r = queries.astype(kind), rows.astype(kind)
    scores = np.zeros((len(q), len(r)), dtype=kind)
    for t in range(r.shape[1]):
        docs = np.flatnonzero(r[:, t])  # the term's postings
        weights = r[docs, t]
        full = len(docs) * 2 > len(r)  # then the whole column is as quick, and its zeros add nothing
        for i in np.flatnonzero(q[:, t]):
            if full:
                scores[i] += q[i, t] * r[:, t]
            else:
                scores[i, docs] += q[i, t] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties by smaller id: selection, then a sort of what is left."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(np.int64)))][:k]


def _search(k: int):
    def run(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        out: list[pd.DataFrame] = []
        for size, own in q.groupby(q["v"].map(len)):
            rows = r[r["v"].map(len) == size]
            if not size or rows.empty:
                continue
            matrix, ids = np.asfortranarray(np.stack(rows["v"].tolist())), rows["vec_id"].to_numpy()
            row_key = rows["row"].to_numpy()
            for a in range(0, len(own), AT_ONCE):
                part = own.iloc[a : a + AT_ONCE]
                scores = accumulate(np.stack(part["v"].tolist()), matrix)
                for i, (query, me) in enumerate(zip(part["vec_id"], part["row"])):
                    others = np.flatnonzero(row_key != me)
                    at = others[best(scores[i, others], ids[others], k)]
                    out.append(pd.DataFrame({"query_id": query, "query_row": me, "vec_id": ids[at], "score": scores[i, at].astype(np.int64)}))
        columns = ["query_id", "query_row", "vec_id", "score"]
        return pd.concat(out, ignore_index=True)[columns] if out else pd.DataFrame(columns=columns).astype("int64")

    return run


def top_k(vectors: DataFrame, *, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query (ids divisible by every), the k best of all other rows.

    Scores are inner products of floor(scale * x), ties go to the smaller id, ranks count from 1; fewer rows give fewer
    results. Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; vectors of
    other lengths than the query's, and empty ones, aren't its candidates. Of rows that repeat an id, each is a candidate, to each other
    too, and each query row has its own results. Other columns are left behind; an empty table gives an empty one.
    """
    v = pick(vectors, vec_id=id_col, x=vector_col).where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("x"), scale).alias("v")).where("v IS NOT NULL")
    v = cut(v.withColumn("row", F.monotonically_increasing_id()))
    total, asked = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    rb, qb = -(-max(1, total) // ROW_BLOCK), -(-max(1, asked) // QUERY_BLOCK)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", "row", F.lit(salt)), F.lit(n)).cast("int")
    q = v.where(F.col("vec_id") % every == 0).withColumn("qb", block(qb, 1)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    r = v.withColumn("rb", block(rb, 2)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(_search(k), "query_id long, query_row long, vec_id long, score long")
    w = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
