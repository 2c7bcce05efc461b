"""Exact k best inner products between integer vectors.

The stated queries are broadcast in batches and meet all rows block by block, where the rows lie.
A block keeps postings by term (component); every query row scatters its weighted postings into a
dense array of scores, a partition selection takes the k best, and a ranking over the tasks merges
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.session import settled

CHUNK = 64
LOWEST = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows (row, id, weights) with weights floor(scale * x); rows with unusable components are dropped.

    ``row`` tells rows apart that share an id or have none.
    """
    named = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    weights = F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return named.where(F.col("v").isNotNull() & usable).select(F.monotonically_increasing_id().alias("row"), "id", weights.alias("weights"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Weights as rows of a matrix; absent components of short vectors are 0."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    if len(sizes):
        flat = np.asarray(lists.flatten())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all candidates for each query, term by term over the postings."""
    scores = np.zeros((len(queries), len(candidates)), dtype=np.int64)
    for term in range(candidates.shape[1]):
        weights = candidates[:, term]
        posting = np.flatnonzero(weights)
        if not len(posting):
            continue
        full = len(posting) == len(weights)
        held = weights[posting]
        for row in np.flatnonzero(queries[:, term]):
            if full:
                scores[row] += queries[row, term] * held
            else:
                scores[row, posting] += queries[row, term] * held
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores; of equal ones the first. Lowest values take no part."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        chosen = np.concatenate([above, np.flatnonzero(scores == kth)[:k - len(above)]])
    else:
        chosen = np.arange(len(scores))
    return chosen[scores[chosen] != LOWEST]


def stretches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Tables of ``block`` rows; the last one may hold fewer."""
    held, n = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, block):
            held.append(batch.slice(low, block))
            n += held[-1].num_rows
            if n >= block:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


FOUND = "query long, query_id long, vec_id long, score long, row long"


def partial_results(rows: DataFrame, queries: pa.Table, width: int, k: int, block: int) -> DataFrame:
    """The k best of each task's rows for each query. Rows stay where they lie."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        asking, own = matrix(table["weights"], width), np.asarray(table["row"].combine_chunks())
        found = [tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) for _ in own]  # scores, ids, rows
        for part in stretches(batches, block):
            ids = np.asarray(part["id"].combine_chunks().fill_null(NO_ID))
            order = np.argsort(ids, kind="stable")
            held, ids, row = matrix(part["weights"], width)[order], ids[order], np.asarray(part["row"].combine_chunks())[order]
            for low in range(0, len(own), CHUNK):
                for q, scores in enumerate(accumulate(asking[low:low + CHUNK], held), low):
                    scores[row == own[q]] = LOWEST
                    chosen = best(scores, k)
                    score, of, place = (np.concatenate(x) for x in zip(found[q], (scores[chosen], ids[chosen], row[chosen])))
                    first = np.lexsort((place, of, -score))[:k]
                    found[q] = score[first], of[first], place[first]
        sizes = [len(f[0]) for f in found]
        if sum(sizes):
            score, ids, row = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, sizes), pa.int64()), pa.array(np.repeat(np.asarray(table["id"].combine_chunks()), sizes), pa.int64()),
                 pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(score, pa.int64()), pa.array(row, pa.int64())],
                ["query", "query_id", "vec_id", "score", "row"])

    return rows.mapInArrow(scan, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id",
          vector: str = "embedding", scale: int = 1024, block: int = 2048, batch_bytes: int = 1 << 24) -> DataFrame:
    """The k highest inner products of each query row with every other row.

    Rows: query_id, rank (from 1), vec_id, score; ties go to the smaller id, null ids last.
    ``is_query`` selects the query rows by the column ``id``. Queries are broadcast in batches of
    ``batch_bytes`` and meet the rows where these lie, ``block`` of them at a time; only each
    task's k best rows are shuffled.

    Null vectors and vectors with null, NaN or infinite components take no part; an empty vector
    is a row of zeros, and components that a shorter vector lacks are zeros. Rows that share an id,
    or are equal, are rows of their own: a query leaves out itself alone. A row without id is a
    candidate, and no query. An empty table, or no query, gives no rows; other columns are ignored.
    """
    rows = settled(integer_vectors(vectors, key, vector, scale), "vectors")
    size = rows.select("id", F.size("weights").alias("w")).agg(F.count_if(is_query).alias("q"), F.max("w").alias("w")).first()
    width = size.w or 0
    batches = max(1, -(-size.q * 8 * max(width, 1) // batch_bytes))
    queries = rows.where(is_query).withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))
    found = []
    for number in range(batches):
        batch = queries.where(F.col("batch") == number).toArrow()  # bounded by batch_bytes
        if batch.num_rows:
            found.append(partial_results(rows, batch, width, k, block))
    partial = settled(found, "found") if found else vectors.sparkSession.createDataFrame([], FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
