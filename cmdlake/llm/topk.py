"""Operator 3: exact top-k search by tiled matrix products.

Vectors become integers and are packed into shards (matrices of up to SHARD rows) and
the queries among them into blocks of up to QUERIES rows, both written once to the
shared folder. Each query block meets each shard of its dimension in one tile: a
matrix product, of which a partial selection keeps the k best of each query. A task
merges the lists of its tiles as it goes; the lists of tasks are merged as a tree,
FAN at a time, so no step holds more than FAN lists of a query.

Products are exact: as doubles while every sum stays below 2^53, else as 64-bit
integers, and as Python integers if those could overflow (scores must fit in 64 bits).

Defined cases: vectors that are null, empty, or hold a null or non-finite component
take no part; vectors of different length have no product and never meet; a null id is
no query, and as a candidate it comes last among ties; rows that repeat an id are
rows of their own: only the query's own row is left out; further columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, written

#: Fixed values of the contract.
K, SCALE, EVERY = 10, 1024.0, 100
#: Rows of a shard and of a query block; shards that a task takes one after another; lists merged at once.
SHARD, QUERIES, GROUP, FAN = 4096, 512, 16, 16


def integer_vectors(table: DataFrame) -> DataFrame:
    """_row, vec_id, dim, x (array<bigint>: floor(1024 * component)) of the rows that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.transform("embedding", lambda v: F.floor(SCALE * v.cast("double")))
    rows = table.select(F.monotonically_increasing_id().alias("_row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(ok)
    return rows.select("_row", "vec_id", F.size("embedding").alias("dim"), x.alias("x"))


def _pack(most: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def out(dim: int, rows: list) -> pd.DataFrame:
            ids = np.array([r[1] if r[1] is not None else 0 for r in rows], np.int64)
            none = np.array([r[1] is None for r in rows], np.uint8)
            return pd.DataFrame({"dim": [dim], "row": [np.array([r[0] for r in rows], np.int64).tobytes()], "vec": [ids.tobytes()], "none": [none.tobytes()], "x": [np.stack([r[2] for r in rows]).astype(np.int64).tobytes()]})

        for b in batches:
            for row, vec, dim, x in zip(b["_row"], b["vec_id"], b["dim"], b["x"]):
                rows = held.setdefault(int(dim), [])
                rows.append((row, None if pd.isna(vec) else int(vec), x))
                if len(rows) == most:
                    yield out(int(dim), held.pop(int(dim)))
        for dim, rows in held.items():
            yield out(dim, rows)

    return pack


PACKED = "dim int, row binary, vec binary, none binary, x binary"


def products(q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices, exact, as int64."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(s).max(initial=0)) * q.shape[1]
    if top < 1 << 53:
        return (q.astype(np.float64) @ s.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return q @ s.T
    return np.array([[sum(a * b for a, b in zip(x, y)) for y in s.tolist()] for x in q.tolist()], dtype=object).astype(np.int64)


def best(score: np.ndarray, vec: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, null ids last; in that order."""
    some = np.arange(len(score))
    if len(score) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
    return some[np.lexsort((vec[some], none[some], -score[some]))][:k]


def _tiles(k: int):
    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict[int, tuple] = {}

        def flush(all_of: dict) -> pd.DataFrame:
            rows = [(q, qv, *map(int, x)) for q, (qv, s, v, n) in all_of.items() for x in zip(s, v, n)]
            return pd.DataFrame(rows, columns=["query", "query_id", "score", "vec_id", "none"]).astype({"query": "int64"})

        for b in batches:
            for t in b.itertuples(index=False):
                q, s = (np.frombuffer(x, np.int64).reshape(-1, t.dim) for x in (t.qx, t.x))
                qrow, qvec, row, vec = (np.frombuffer(x, np.int64) for x in (t.qrow, t.qvec, t.row, t.vec))
                none = np.frombuffer(t.none, np.uint8)
                scores = products(q, s)
                for i, mine in enumerate(qrow.tolist()):
                    other = np.flatnonzero(row != mine) if (row == mine).any() else slice(None)
                    got = (scores[i][other], vec[other], none[other])
                    had = tops.get(mine)
                    if had:
                        got = tuple(np.concatenate(x) for x in zip(had[1:], got))
                    keep = best(*got, k)
                    tops[mine] = (int(qvec[i]), *(x[keep] for x in got))
                if len(tops) > 20_000:
                    yield flush(tops)
                    tops = {}
        if tops:
            yield flush(tops)

    return tiles


def top_k(table: DataFrame, *, k: int = K, every: int = EVERY, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products with other rows."""
    rows = written(integer_vectors(table), "topk-rows")  # once: the numbers of rows must be the same wherever they are read
    shards = written(rows.mapInPandas(_pack(shard), PACKED).withColumn("part", F.monotonically_increasing_id()), "topk-shards")
    asked = rows.filter(F.col("vec_id") % every == 0)
    asks = written(asked.repartition(max(1, -(-asked.count() // queries))).mapInPandas(_pack(queries), PACKED), "topk-queries")
    forget(rows)
    # Shards fall into groups; every query block is sent to every group of its dimension, never to single rows.
    n = shards.count()
    groups = max(1, -(-n // GROUP))
    shards = shards.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int"))
    asks = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.col("row").alias("qrow"), F.col("vec").alias("qvec"), F.col("x").alias("qx"))
    tiles = asks.join(shards, ["dim", "group"])
    lists = tiles.select("dim", "qrow", "qvec", "qx", "row", "vec", "none", "x").mapInPandas(_tiles(k), "query long, query_id long, score long, vec_id long, none int")
    item = F.struct((-F.col("score")).alias("s"), "none", "vec_id")
    best_of = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
    out = lists.groupBy("query", "query_id", F.spark_partition_id().alias("at")).agg(F.slice(F.array_sort(F.collect_list(item)), 1, k).alias("top"))
    parts = max(groups, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a list of a query comes from a task, numbered below this
    while parts > FAN:
        parts = -(-parts // FAN)
        out = out.groupBy("query", "query_id", F.floor(F.col("at") / FAN).cast("int").alias("at")).agg(best_of.alias("top"))
    out = out.groupBy("query", "query_id").agg(best_of.alias("top"))
    out = out.select("query_id", F.posexplode("top").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).alias("rank"), F.when(F.col("x.none") == 0, F.col("x.vec_id")).alias("vec_id"), (-F.col("x.s")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = f"""
WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.k, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.k <> c.k AND len(q.x) = len(c.x) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
