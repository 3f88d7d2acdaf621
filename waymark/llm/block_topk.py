"""Exact top-k by inner product: blocks of document ranges in order of their bounds, until bounds fall below the kth score."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import configure_text, materialize

#: Rows of a block, of a part (what a task holds at a time), and queries of a group.
BLOCK_ROWS, PART_ROWS, GROUP_ROWS = 256, 4096, 128
#: Whole numbers of 38 digits order the results.
EXACT, WIDEST = pa.decimal128(38, 0), 10 ** 38 - 1


def _packed(ids: np.ndarray, matrix: np.ndarray) -> bytes:
    return np.concatenate([[len(ids)], ids, matrix.reshape(-1)]).astype("<i8").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<i8")
    n = int(x[0])
    return x[1:n + 1], x[n + 1:].reshape(n, -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while every sum is below 2**53, else in Python's integers."""
    top = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if top < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a.astype(object) @ b.T.astype(object)


def best_of_part(ids: np.ndarray, matrix: np.ndarray, high: np.ndarray, low: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int, block: int):
    """(query index, id, score) of the k best of one part for every query, and how many blocks were scored. high, low:
    the greatest and least value of each term in each block; they bound every score in it. Each query takes its blocks by
    falling bound and stops where the bound is below its kth score; a bound equal to it may still hide a smaller id."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _product(plus, high) + _product(minus, low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n, blocks = bounds.shape
    least = -1 << (200 if bounds.dtype == object else 63)
    scores = [np.zeros(0, bounds.dtype)] * n
    found = [np.zeros(0, np.int64)] * n
    kth = np.full(n, least, bounds.dtype)
    open_, scored = np.arange(n), 0
    for turn in range(blocks):
        open_ = open_[bounds[open_, order[open_, turn]] >= kth[open_]]
        if not len(open_):
            break
        at = order[open_, turn]
        for b in np.unique(at):
            mine = open_[at == b]
            rows = slice(b * block, min((b + 1) * block, len(ids)))
            got, names = _product(queries[mine], matrix[rows]), ids[rows]
            scored += len(mine)
            for q, row in zip(mine, got, strict=True):
                good = (row >= kth[q]) & (names != qids[q])
                s, i = np.concatenate([scores[q], row[good]]), np.concatenate([found[q], names[good]])
                if len(s) > k:
                    best = np.lexsort((i, -s))[:k]
                    s, i = s[best], i[best]
                    kth[q] = s[-1]
                elif len(s) == k:
                    kth[q] = s.min()
                scores[q], found[q] = s, i
    sizes = [len(s) for s in scores]
    return np.repeat(np.arange(n), sizes), np.concatenate(found), np.concatenate(scores), scored


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK_ROWS, part: int = PART_ROWS, group: int = GROUP_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of vectors (vec_id long, terms array<long>) that is_query says, the k
    rows of another vec_id with the greatest inner product, ties to the smaller vec_id; all if there are fewer.

    Rows repeat only once (equal id and terms); one vec_id with several vectors is that many candidates, and as a query
    the best scores of all of them count. Vectors of another length are no candidates. NULL, empty or NULL-holding rows
    take no part, nor do rows without id. No queries or no candidates: no rows. A product beyond 64 bits is returned as the
    largest (or least) number of 64 bits, but ranked by its exact value, up to 38 digits.

    Every query meets every part of the rows (that is the stated search), but part and group rows are packed, a part is
    dealt once and then streams the groups that were dealt to it, so a task holds one part and one group at a time.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size("terms") > 0) & ~F.exists("terms", F.isnull)).select("vec_id", "terms").distinct()
    rows = materialize(rows.withColumn("dim", F.size("terms")))
    n = rows.count()
    parts = max(1, -(-n // part))

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, serial = TaskContext.get().partitionId(), [], 0

            def out(chunk):
                nonlocal serial
                ids = np.array([i for i, _ in chunk], np.int64)
                serial += 1
                return pa.record_batch([pa.array([len(chunk[0][1])], pa.int32()), pa.array([at * (1 << 32) + serial], pa.int64()),
                                        pa.array([_packed(ids, np.array([t for _, t in chunk], np.int64))], pa.binary())], ["dim", "name", "packed"])

            for b in batches:
                for i, t in zip(b.column("vec_id").to_pylist(), b.column("terms"), strict=True):
                    t = t.values.to_numpy()
                    if held and (len(held) == size or len(t) != len(held[0][1])):
                        yield out(held)
                        held = []
                    held.append((i, t))
            if held:
                yield out(held)
        return run

    packed = "dim int, name long, packed binary"
    ranges = rows.repartitionByRange(parts, "dim", "vec_id").sortWithinPartitions("dim", "vec_id").select("vec_id", "terms")
    stored = materialize(ranges.mapInArrow(pack(part), packed))
    asked = rows.filter(is_query).repartitionByRange(parts, "dim", "vec_id").sortWithinPartitions("dim", "vec_id").select("vec_id", "terms")
    groups = materialize(asked.mapInArrow(pack(group), packed))
    # each group goes to every part of its length
    names = stored.select("dim", F.col("name").alias("to"))
    dealt = groups.join(names, "dim").select("to", F.lit(1).alias("kind"), "packed")
    dealt = stored.select(F.col("name").alias("to"), F.lit(0).alias("kind"), "packed").unionByName(dealt)
    dealt = dealt.repartition("to").sortWithinPartitions("to", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, data in zip(b.column("kind").to_pylist(), b.column("packed"), strict=True):
                ids, matrix = _unpacked(data.as_py())
                if kind == 0:
                    held, cuts = (ids, matrix), np.arange(0, len(ids), block)
                    high, low = np.maximum.reduceat(matrix, cuts, axis=0), np.minimum.reduceat(matrix, cuts, axis=0)
                    continue
                q, i, s, _ = best_of_part(*held, high, low, ids, matrix, k, block)
                whole = pa.array([Decimal(max(-WIDEST, min(WIDEST, int(x)))) for x in s], EXACT) if s.dtype == object else pa.array(s).cast(EXACT)
                yield pa.record_batch([pa.array(ids[q], pa.int64()), pa.array(i, pa.int64()), whole], ["query_id", "vec_id", "exact"])

    best = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    found = dealt.mapInArrow(search, "query_id long, vec_id long, exact decimal(38,0)")
    found = found.withColumn("score", F.greatest(F.lit(-1 << 63), F.least(F.lit((1 << 63) - 1), F.col("exact"))).cast("long"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = configure_text(spark).read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    terms = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    return top_k(table.filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms")), F.col("vec_id") % 20 == 0)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
