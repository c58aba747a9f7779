"""Exact top-k inner-product search by columnar branch and bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantise(vectors: pa.ListArray, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) in doubles, a row per vector, padded with zeros to dims."""
    ends = vectors.offsets.to_numpy()
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims) < np.diff(ends)[:, None]] = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    return np.floor(out * scale)


def as_bytes(values: np.ndarray) -> tuple[bytes, bool]:
    """Whole numbers as 16-bit integers where they fit, else as doubles (True)."""
    wide = bool(len(values)) and bool(np.abs(values).max(initial=0) >= 1 << 15)
    return values.astype("<f8" if wide else "<i2").tobytes(), wide


def as_numbers(data: bytes, wide: bool, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<f8" if wide else "<i2").reshape(-1, dims).astype(np.float64)


def rest_mass(columns: np.ndarray, block: int) -> np.ndarray:
    """Row b: the norm of each vector's dimensions after block b, rounded up a little."""
    squares = np.add.reduceat(columns**2, np.arange(0, len(columns), block), axis=0)
    return np.sqrt(np.maximum(squares.sum(axis=0) - np.cumsum(squares, axis=0), 0)) * (1 + 1e-9) + 1e-6


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query, positions and scores of its k best of these vectors, ties to smaller ids; at least all that reach floor and rank.

    vectors: dims x n, the vertical layout. Each query adds up one block of dimensions for the vectors
    that are left, bounds what the other dimensions can add by the product of the norms there, and
    compacts the vectors whose bound reaches the k-th best score so far.
    """
    dims, n = vectors.shape
    order = np.arange(0, dims, block)
    mass, query_mass = rest_mass(vectors, block), rest_mass(queries.T.copy(), block)
    out = []
    for at in range(0, len(queries), 64):
        head = queries[at : at + 64, :block] @ vectors[:block]
        for j in range(len(head)):
            q = at + j
            part, alive, low = head[j], None, floor[q]
            if n > 4 * k and dims > block:  # full scores of the best heads give a first k-th best
                probe = np.argpartition(-part, 2 * k)[: 2 * k + 1]
                probe = probe[ids[probe] != query_ids[q]]
                low = max(low, np.sort(queries[q] @ vectors[:, probe])[-k]) if len(probe) >= k else low
            for b, start in enumerate(order):
                if b:
                    rows = vectors[start : start + block]
                    part = part + queries[q, start : start + block] @ (rows if alive is None else rows[:, alive])
                bound = part + query_mass[b, q] * (mass[b] if alive is None else mass[b][alive])
                keep = np.flatnonzero(bound >= low)
                if len(keep) < 0.8 * len(part) or b == len(order) - 1:
                    part, alive = part[keep], keep if alive is None else alive[keep]
            real = ids[alive] != query_ids[q]
            part, alive = part[real], alive[real]
            if len(part) > k:
                keep = np.flatnonzero(part >= np.partition(part, len(part) - k)[len(part) - k])
                part, alive = part[keep], alive[keep]
            best = np.lexsort((ids[alive], -part))[:k]
            out.append((alive[best], part[best]))
    return out


def exact_topk(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, block: int = 16, max_query_values: int = 1 << 22, max_candidate_values: int = 1 << 24, chunk: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k largest integer inner products with every other row.

    Components become floor(scale * x) in doubles; products are exact below 2^53. Queries are dealt to
    blocks of about ``max_query_values`` components and candidates, packed ``chunk`` at a time, to parts
    of about ``max_candidate_values``; a pair of block and part is one group, which keeps each query's
    k-th best score from chunk to chunk and returns k rows per query, and a window over those ranks them.
    So nothing passes through the driver, and a task holds one block and one part whatever their number.

    Null vectors and vectors with null or non-finite components take no part, nor do null ids. Shorter
    vectors count as padded with zeros. Rows that repeat a query's id are that query's own and aren't its
    candidates; a repeated query id is answered once, for the largest of its vectors in array order.
    Repeated candidates rank as rows. An empty table, or one without queries, gives no rows; other
    columns are ignored.
    """
    spark, vector = df.sparkSession, F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("v"), is_query.alias("query")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    n, rows, dims = base.agg(F.count_if("query"), F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(dims, 1)
    blocks = -(-n * dims // max_query_values)
    parts = max(-(-rows * dims // max_candidate_values), spark.sparkContext.defaultParallelism)

    def pack(ids: pa.Array, vectors: pa.Array) -> dict[str, list]:
        data, wide = as_bytes(quantise(vectors, dims, scale))
        return {"ids": [ids.to_numpy().tobytes()], "vectors": [data], "wide": [wide]}

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece = batch.slice(at, chunk)
                yield pa.RecordBatch.from_pydict(pack(piece.column(0), piece.column(1)))

    def one_block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32())} | pack(table.column("id").combine_chunks(), table.column("v").combine_chunks()))

    def search_part(key: tuple, candidates: pa.Table, asked: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        (own,) = asked.select(["ids", "vectors", "wide"]).to_pylist()
        query_ids, queries = np.frombuffer(own["ids"], np.int64), as_numbers(own["vectors"], own["wide"], dims)
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in query_ids]
        floor = np.full(len(query_ids), -np.inf)
        for piece in candidates.select(["ids", "vectors", "wide"]).to_batches():
            for k_ in range(piece.num_rows):
                ids, data, wide = (piece.column(c)[k_].as_py() for c in range(3))
                ids, vectors = np.frombuffer(ids, np.int64), np.ascontiguousarray(as_numbers(data, wide, dims).T)
                for q, (at, scores) in enumerate(search(queries, query_ids, vectors, ids, k, block, floor)):
                    if len(at):
                        all_ids, all_scores = np.r_[best[q][0], ids[at]], np.r_[best[q][1], scores]
                        top = np.lexsort((all_ids, -all_scores))[:k]
                        best[q] = (all_ids[top], all_scores[top])
                        if len(top) == k:
                            floor[q] = best[q][1][-1]
        return pa.table({"query_id": np.repeat(query_ids, [len(b[0]) for b in best]), "vec_id": np.concatenate([b[0] for b in best]), "score": np.concatenate([b[1] for b in best]).astype(np.int64)})

    packed = "ids binary, vectors binary, wide boolean"
    asked = base.filter("query").groupBy("id").agg(F.max("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.groupBy("block").applyInArrow(one_block, f"block int, {packed}").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    candidates = base.select("id", "v").mapInArrow(chunks, packed).withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = candidates.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(search_part, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
