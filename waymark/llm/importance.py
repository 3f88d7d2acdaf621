"""Target-distribution importance resampling: hashed n-gram gains of a target over the corpus, weights per document, and a
draw without replacement by the greatest weights after Gumbel noise."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, row_hash

#: What stands between words once A-Z are lower case: all of ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Copies of one row that one task writes out.
COPIES = 100_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of all rows as indices into a dictionary, the dictionary, and the row of each word. NULL has none."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=BETWEEN)
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(flat, "")
    coded = pc.dictionary_encode(flat.filter(real))
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist(),
            row.filter(real).to_numpy(zero_copy_only=False).astype(np.int64))


def features(texts: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to `order` words: the row and the bucket of every run. A run of k words is the pair of the run of k - 1 at its
    start and its last word, the dictionary indices shifted against each other; the CRC of a distinct pair goes on from
    that of the shorter run."""
    word, dictionary, row = words_of(texts)
    spaced = [b" " + w for w in dictionary]
    run, crc = word, np.array([crc32(w) for w in dictionary], np.int64)
    yield row, (crc % buckets)[run]
    for k in range(2, order + 1):
        if len(word) < k:
            return
        inside = row[k - 1:] == row[:len(row) - k + 1]
        pairs, again = np.unique(run[:len(inside)] * len(dictionary) + word[k - 1:], return_inverse=True)
        left, right = np.divmod(pairs, len(dictionary))
        crc = np.array([crc32(spaced[b], a) for a, b in zip(crc[left].tolist(), right.tolist())], np.int64)
        run = again
        yield row[:len(inside)][inside], (crc % buckets)[run[inside]]


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: one row a bucket and partition, summed; `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket in features(b.column(0), order, buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, object)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of a bucket's share, with one added to every count."""
    s_all, t_all, b = sum(corpus), sum(target), len(corpus)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(corpus, target)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, order: int) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight (floored mean gain of the features, 0 without any) of every row."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            n_words, n_features, total = None, np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, bucket in features(b.column("text"), order, buckets):
                count = np.bincount(row, minlength=n)
                n_words = count if n_words is None else n_words
                n_features += count
                if len(row):
                    at = np.flatnonzero(np.diff(row, prepend=-1))  # where each row's run of features begins
                    total[row[at]] += np.add.reduceat(gains.take(bucket), at)
            weight = np.where(n_features, total // np.maximum(n_features, 1), 0)
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), *map(pa.array, (n_words, n_features, weight))],
                                  ["doc_id", "text_hash", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_hash().alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {kind}, text_hash long, n_words long, n_features long, weight long")


def ranked_draw(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored with rank: of the N rows of `least_words` words and more, floor(percent * N / 100) of the highest scores get 1, 2,
    3...; ties go to the smaller doc_id (NULL last), then by the other columns. A score is a whole number within some 100,000
    of 0 whatever the input, so their counts are few; rows at and above the last drawn score are dealt out by ranges of the
    order and numbered there. Rows that repeat are numbered as one and written out again after that."""
    able = scored.filter(F.col("n_words") >= least_words)
    counted = sorted(able.groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["score"])
    wanted = sum(r["n"] for r in counted) * percent // 100
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if not wanted:
        return none
    least, before = None, 0
    for r in counted:
        least, before = r["score"], before + r["n"]
        if before >= wanted:
            break
    in_play = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "text_hash", "n_words"]
    dealt = scored.filter(in_play).groupBy(scored.columns).agg(F.count("*").alias("copies")).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            upto = total + np.cumsum(b.column("copies").to_numpy())
            if b.num_rows:
                total = int(upto[-1])
            yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(upto)], [*b.schema.names, "part", "upto"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    numbered = materialize(dealt.mapInArrow(number, f"{fields}, part long, upto long"))
    starts, total = [], 0
    for r in sorted(numbered.groupBy("part").agg(F.max("upto").alias("n")).collect()):  # one row a partition
        starts.append((r["part"], total))
        total += r["n"]
    starts = scored.sparkSession.createDataFrame(starts, "part long, start long")
    first = F.col("start") + F.col("upto") - F.col("copies") + 1
    placed = numbered.join(F.broadcast(starts), "part").withColumn("first", first)
    most = numbered.agg(F.max("copies")).first()[0]
    if most > COPIES:  # shares of a row of very many copies go to many tasks
        share = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))
        placed = placed.withColumn("share", share).withColumn("first", F.col("first") + F.col("share") * COPIES)
        placed = placed.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("share") * COPIES)).repartition("first")
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("at")
    drawn = placed.select(*scored.columns, each).select(*scored.columns, F.when(F.col("at") <= wanted, F.col("at")).alias("rank"))
    return drawn.unionByName(none.filter(~in_play))


def resample(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score, rank of every row of docs (doc_id, text), drawn towards the
    distribution of target (text).

    Features are all runs of 1 to `order` words; a document's weight is the floored mean of its features' gains, its score
    that plus Gumbel noise of sha256(seed:doc_id), in whole thousandths. Of rows of `least_words` words and more, `percent`
    of a hundred are drawn by score.

    NULL, empty texts and such without words: no features, weight 0, never drawn. A NULL doc_id counts as the empty string
    in the hash and stands last among ties. Very long texts are worked whole. Rows that repeat are documents of their own
    and may straddle the cut. Empty docs: no rows; empty target: all counts of it 0. Other columns are not read.
    """
    corpus, wanted = bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    return ranked_draw(materialize(weights(docs, gains_of(corpus, wanted), order).withColumn("score", F.col("weight") + noise)), least_words, percent)


def drawn_texts(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """rank, doc_id, text of the rows that `resample` drew from docs."""
    texts = docs.select(F.col("doc_id").alias("own"), row_hash().alias("hash"), "text").dropDuplicates(["own", "hash"])
    drawn = ranked.filter("rank IS NOT NULL")
    return drawn.join(texts, drawn["doc_id"].eqNullSafe(texts["own"]) & (drawn["text_hash"] == texts["hash"])).select("rank", "doc_id", "text")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the hexadecimal digits of the distinct features.
ORACLE = r"""
with recursive table_step as (
  select i as entry, i::ubigint as v, 0 as k from range(256) t(i)
  union all
  select entry, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, k + 1 from table_step where k < 8),
crc_table as (select list(v order by entry) as t from table_step where k = 8),
words as (
  select doc_id, 1 as kind, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
  union all
  select item_id, 2, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') from benchmark),
all_features as (
  select doc_id, kind, unnest(w) as f from words
  union all
  select doc_id, kind, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words where len(w) > 1),
counted as (select doc_id, kind, f, count(*) as n from all_features group by all),
hexed as (select f, hex(encode(f)) as h from (select distinct f from counted)),
crcs as (
  select f, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::ubigint)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint) % 10000 as bucket from hexed, crc_table),
hashed as (select doc_id, kind, bucket, sum(n)::bigint as n from counted join crcs using (f) group by all),
totals as (select bucket, sum(case when kind = 1 then n else 0 end) as s, sum(case when kind = 2 then n else 0 end) as t from hashed group by bucket),
whole as (select sum(s)::bigint as s_all, sum(t)::bigint as t_all from totals),
gains as (select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain from totals, whole),
weighed as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain) / sum(n))::bigint as weight from hashed join gains using (bucket) where kind = 1 group by doc_id),
scored as (
  select d.doc_id, len(d.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::ubigint + 0.5::double) / 4294967296)))::bigint as score
  from words d left join weighed using (doc_id) where d.kind = 1),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_words >= 20)
select s.doc_id, s.n_features, s.weight, s.score, case when r <= 25 * n // 100 then r end as rank
from scored s left join placed using (doc_id)
"""
