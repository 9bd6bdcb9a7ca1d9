"""Exact top-k inner products over an impact-ordered index, score at a time.

The index holds vectors of integers in blocks. In a block, posting segments gather the components of
one impact level, a power-of-two class of their magnitude. For a block of queries the segments are
processed from the highest level down. What is still open of a vector is bounded by the norm of its
unprocessed components times the norm of the query's, so a vector drops out only when its upper bound is
below the k-th best lower bound. Processing stops when few possible members are left, which are
rescored exactly, or when every segment has been processed and the scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventcast.llm.base import ramp
from eventcast.operators.attach import attach
from eventcast.operators.rank import global_rank
from eventcast.session import stage, stage_table

LEVELS = (16, 8, 4, 2, 0)  # least magnitude of each impact level
INDEX_BLOCK = 8192
QUERY_BLOCK = 512
RESCORED = 8  # possible members per wanted one at which exact rescoring is cheaper than a segment


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as a long; null where any component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


def segments(matrix: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Posting segments by descending impact level, and per level the norms of what is left after it."""
    size = np.abs(matrix)
    parts, left = [], []
    upper = np.inf
    for lower in LEVELS:
        parts.append(np.where((size >= lower) & (size < upper), matrix, 0))
        left.append(np.sqrt((np.where(size < lower, matrix, 0).astype(np.float64) ** 2).sum(1)))
        upper = lower
    return parts, np.array(left)


def block_top(queries: np.ndarray, query_rows: np.ndarray, matrix: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query position, vector position, score) of each query's best ``k`` in one block, exact.

    ``query_rows`` and ``rows`` are row numbers: a query does not meet its own row.
    """
    width = max(queries.shape[1], matrix.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    matrix = np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0)) * width
    kind = np.float32 if largest < 1 << 24 else np.float64  # sums of integers stay exact
    q = queries.astype(kind)
    parts, left = segments(matrix.astype(kind))
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    scores = np.zeros((len(q), len(matrix)), kind)
    own = query_rows[:, None] == rows[None, :] if len(np.intersect1d(query_rows, rows)) else None
    for level, part in enumerate(parts):
        scores += q @ part.T
        slack = (norms[:, None] * left[level][None, :] * (1 + 1e-6)).astype(kind)
        low = scores - slack
        if own is not None:
            low[own] = -np.inf
        if len(matrix) > k:
            kth = np.partition(low, len(matrix) - k, axis=1)[:, len(matrix) - k]
            possible = scores + slack >= kth[:, None]
        else:
            possible = np.ones(scores.shape, bool)
        if own is not None:
            possible &= ~own
        if possible.sum() <= RESCORED * k * len(q) or level == len(parts) - 1:
            break
    qi, vi = np.nonzero(possible)
    exact = np.empty(len(qi), np.int64)
    for at in range(0, len(qi), 65536):
        some = slice(at, at + 65536)
        exact[some] = np.einsum("ij,ij->i", queries[qi[some]], matrix[vi[some]])
    order = np.lexsort((ids[vi], -exact, qi))
    qi, vi, exact = qi[order], vi[order], exact[order]
    best = ramp(np.bincount(qi, minlength=len(q))) < k
    return qi[best], vi[best], exact[best]


def _packed(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row per block: numbers, ids and the component matrix (64-bit, padded with zeros) as binary."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vectors = [np.array(v, np.int64) for v in group.column("v").to_pylist()]
        width = max((len(v) for v in vectors), default=0)
        matrix = np.array([np.pad(v, (0, width - len(v))) for v in vectors], np.int64)
        number, ids = (np.array(group.column(c).to_pylist(), np.int64).tobytes() for c in ("number", "vec_id"))
        return pa.table({name: pa.array([group.column(name)[0].as_py()], pa.int64()),
                         f"{name}_numbers": pa.array([number], pa.binary()), f"{name}_ids": pa.array([ids], pa.binary()),
                         f"{name}_rows": pa.array([matrix.tobytes()], pa.binary())})

    schema = f"{name} long, {name}_numbers binary, {name}_ids binary, {name}_rows binary"
    return rows.withColumn(name, block.cast("long")).groupBy(name).applyInArrow(pack, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each query row, ties to the smaller id.

    Rows with a null id, a null vector or a component that is null or not finite take no part; shorter
    vectors count as padded with zeros. A query does not meet its own row, but other rows of its id. Repeated
    query rows each get a result. Ids may be of any type with an order.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"),
                          is_query.alias("asks")).filter("vec_id is not null and v is not null")
    kind = rows.schema["vec_id"].dataType
    if not isinstance(kind, T.IntegralType):
        # Other ids are replaced by their place among all ids, and back at the end.
        names = stage(global_rank(rows.select("vec_id").distinct(), ["vec_id"], out="_place"))
        rows = attach(rows, names, "vec_id", "inner", staged=True).withColumn("vec_id", F.col("_place")).drop("_place")
        found = _top_numbers(rows, k)
        for column in ("query_id", "vec_id"):
            back = names.select(F.col("_place").alias(column), F.col("vec_id").alias("_name"))
            found = attach(found, back, column, "inner", staged=True).withColumn(column, F.col("_name")).drop("_name")
        return found.select("query_id", "rank", "vec_id", "score")
    found = _top_numbers(rows.withColumn("vec_id", F.col("vec_id").cast("long")), k)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("query_id", "vec_id")})


def _top_numbers(rows: DataFrame, k: int) -> DataFrame:
    """``top_k`` of (vec_id long, v, asks)."""
    rows = stage_table(rows.withColumn("number", F.monotonically_increasing_id()))
    asked = rows.filter("asks")
    sizes = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    n_blocks, n_asks = max(1, -(-sizes[0] // INDEX_BLOCK)), max(1, -(-sizes[1] // QUERY_BLOCK))
    index = stage_table(_packed(rows, F.pmod(F.xxhash64("number"), F.lit(n_blocks)), "block"))
    blocks = index.withColumn("asking", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asks - 1).cast("long"))))
    asks = _packed(asked, F.pmod(F.xxhash64("number"), F.lit(n_asks)), "asking")
    asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                read = lambda c: np.frombuffer(get[c], np.int64)
                ids, query_ids, numbers = read("block_ids"), read("asking_ids"), read("asking_numbers")
                qi, vi, exact = block_top(read("asking_rows").reshape(len(query_ids), -1), numbers,
                                          read("block_rows").reshape(len(ids), -1), read("block_numbers"), ids, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[qi]), pa.array(query_ids[qi]), pa.array(ids[vi]), pa.array(exact)],
                    names=["number", "query_id", "vec_id", "score"])

    met = blocks.join(asks, ["block", "asking"]).select(
        "block_ids", "block_rows", "block_numbers", "asking_numbers", "asking_ids", "asking_rows")
    found = met.mapInArrow(score, "number long, query_id long, vec_id long, score long")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
