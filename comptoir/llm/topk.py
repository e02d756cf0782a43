"""Exact top-k search by inner product with an impact-ordered index.

Candidates are dealt into blocks. The index of a block holds postings (component, vector, impact) in segments of descending quantised impact
|x|. A block of queries works through the segments score at a time: the postings of a level are multiplied into the accumulators of all
queries still open. What the lower levels can add to a score lies within the sum over components of |q| times the largest impact left; so a
vector whose accumulator is further than that below the k-th best can't be a member. A query stops when few vectors are left that can; these
are rescored exactly. The k best of every block meet in one ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK, LEVELS = 8192, 512, 6


def quantise(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component as long; null if the vector is null or holds a null or non-finite component."""
    wide = vector.cast("array<double>")
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(wide, lambda x: F.floor(x * factor)))


def _matrix(values: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = values.combine_chunks()
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)
    out = np.zeros((len(lists), width), dtype=np.int64)
    size = np.diff(offsets)
    out[np.repeat(np.arange(len(lists)), size), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size)] = flat[offsets[0] : offsets[-1]]
    return out


def _indexed(table: pa.Table) -> pa.Table:
    """The postings of one block: by level from the highest impacts down, each with its vector, component and value."""
    width = int(max(np.diff(np.asarray(table.column("v").combine_chunks().offsets)), default=0))
    x = _matrix(table.column("v"), width)
    impact = np.abs(x)
    level = impact * LEVELS // (int(impact.max(initial=0)) + 1)
    vector, component = np.nonzero(x)
    order = np.argsort(-level[vector, component], kind="stable")
    vector, component = vector[order], component[order]
    counts = np.array([(level[vector, component] == n).sum() for n in range(LEVELS)][::-1], dtype=np.int64)
    largest = np.stack([np.where(level <= n, impact, 0).max(axis=0, initial=0) for n in range(LEVELS)][::-1])
    return pa.table({
        "block": table.column("block").combine_chunks()[:1], "width": pa.array([width], pa.int32()), "ids": [np.asarray(table.column("id")).astype(np.int64).tobytes()],
        "vectors": [vector.astype(np.int32).tobytes()], "components": [component.astype(np.int32).tobytes()], "values": [x[vector, component].tobytes()],
        "counts": [counts.tobytes()], "largest": [largest.astype(np.int64).tobytes()]})


def search_block(ids: np.ndarray, postings: tuple[np.ndarray, ...], counts: np.ndarray, largest: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query, vector, score) of the k best vectors of the block for every query, ties to the smaller id."""
    n, width = len(ids), largest.shape[1]
    vector, component, value = postings
    queries = queries[:, :width] if queries.shape[1] >= width else np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    bound = float((np.abs(queries).max(initial=0)).astype(float) * largest[0].sum())
    kind = np.float32 if bound < 2**23 else np.float64
    slack = 0 if bound < 2**52 else bound * 1e-12
    whole = np.zeros((n, width), dtype=np.int64)
    whole[vector, component] = value
    scores = np.zeros((len(queries), n), dtype=kind)
    own = ids[None, :] == query_ids[:, None]
    open_ = np.arange(len(queries))
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    at = 0
    for step in range(LEVELS):
        part = np.zeros((n, width), dtype=kind)
        rows = slice(at, at + counts[step])
        part[vector[rows], component[rows]] = value[rows]
        at += counts[step]
        scores[open_] += queries[open_].astype(kind) @ part.T
        left = np.abs(queries[open_]).astype(float) @ (largest[step + 1] if step + 1 < LEVELS else np.zeros(width)) + slack
        still = []
        for q, rest in zip(open_, left, strict=True):
            mine = np.where(own[q], -np.inf, scores[q])
            kth = np.partition(mine, n - k)[n - k] if n > k else -np.inf
            member = np.flatnonzero((mine >= kth - 2 * rest) & ~own[q])
            if step + 1 < LEVELS and len(member) > 8 * k:
                still.append(q)
                continue
            exact = whole[member] @ queries[q]
            best = np.lexsort((ids[member], -exact))[:k]
            out.append((q, ids[member][best], exact[best]))
        open_ = np.array(still, dtype=np.int64)
        if not len(open_):
            break
    return (np.repeat([query_ids[q] for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in out)]), np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in out)]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` greatest inner products of every query, ties to the smaller id.

    Both inputs have ``id`` (long) and ``v`` (array of long, as ``quantise`` gives); rows with a null in either take no part, components a
    vector lacks count as 0. A vector with the query's own id is no candidate; repeated query ids are one query (that of the smallest
    vector), repeated candidates each take a place.
    """
    rows = vectors.filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.filter("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-rows.count() // BLOCK))
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    index = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v").groupBy("block").applyInArrow(
        _indexed, "block int, width int, ids binary, vectors binary, components binary, values binary, counts binary, largest binary")

    def packed(table: pa.Table) -> pa.Table:
        width = int(max(np.diff(np.asarray(table.column("v").combine_chunks().offsets)), default=0))
        return pa.table({"part": table.column("part").combine_chunks()[:1], "query_width": pa.array([width], pa.int32()), "query_ids": [np.asarray(table.column("id")).astype(np.int64).tobytes()], "queries": [_matrix(table.column("v"), width).tobytes()]})

    parts = asked.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("part"), "id", "v").groupBy("part").applyInArrow(packed, "part int, query_width int, query_ids binary, queries binary")
    work = index.join(parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "block")

    def search(table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for row in table.to_pylist():
            get = lambda name, kind: np.frombuffer(row[name], dtype=kind)  # noqa: B023, E731
            largest = get("largest", np.int64).reshape(LEVELS, row["width"])
            query_ids = get("query_ids", np.int64)
            found.append(search_block(get("ids", np.int64), (get("vectors", np.int32), get("components", np.int32), get("values", np.int64)), get("counts", np.int64), largest, query_ids, get("queries", np.int64).reshape(len(query_ids), row["query_width"]), k))
        return pa.table({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("query_id", "vec_id", "score"))})

    best = work.groupBy("block", "part").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
