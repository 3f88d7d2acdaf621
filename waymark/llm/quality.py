"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WORD_OR_SIGN_CLASS, BytesHasher, columns_of, configure_text, documents, free_name, mix, pieces, plain_names, token_bounds

#: log2 of the number of weights; their size, not the corpus, is what reaches the driver (1 MB).
BITS = 18
#: Labelled rows that training takes at most, about: a sample by hash of doc_id.
TRAIN_ROWS = 12_000
#: How far back a repeated word is told from a fresh one.
LAGS = 8


def features(data: np.ndarray, offsets: np.ndarray, hasher: BytesHasher, bits: int = BITS):
    """Hashed unigrams and bigrams of each row: (slots, values, first of each row). Tokens are runs of letters and
    digits, or of signs, A-Z lower-cased. A token that stands 1..8 tokens earlier in its row counts as `repeat at that
    distance` instead of as itself, so that repetition looks alike whatever is repeated. Values are log-scaled counts of
    unit length per row, besides the bias in slot 0."""
    data = LOWER[data]
    starts, ends, first = token_bounds(data, offsets, WORD_OR_SIGN_CLASS)
    words = hasher.ranges(data, starts, ends)
    n, rows = len(words), len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    named = words.copy()
    for lag in range(LAGS, 0, -1):
        if n > lag:
            same = (words[lag:] == words[:-lag]) & (row[lag:] == row[:-lag])
            named[lag:][same] = np.uint64(lag)
    pairs = mix(named[:-1] * np.uint64(3) + mix(named[1:])) if n > 1 else np.zeros(0, np.uint64)
    joined = row[1:] == row[:-1] if n > 1 else np.zeros(0, bool)
    slot = np.concatenate([mix(named + np.uint64(1)), pairs[joined]]) % np.uint64((1 << bits) - 1) + np.uint64(1)
    key, count = np.unique((np.concatenate([row, row[1:][joined]]).astype(np.uint64) << np.uint64(bits)) | slot, return_counts=True)
    of = (key >> np.uint64(bits)).astype(np.int64)
    value = np.log1p(count)
    length = np.sqrt(np.bincount(of, value * value, minlength=rows))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), value / length[of] if len(of) else value, np.searchsorted(of, np.arange(rows + 1))


def ftrl(rows, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """Weights after FTRL-proximal updates over (slots, values, label)."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    for slots, values, label in rows:
        slots, values = np.append(slots, 0), np.append(values, 1.0)
        zs, ns = z[slots], n[slots]
        w = weights(zs, ns)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha
        z[slots] = zs + g - sigma * w
        n[slots] = ns + g * g
    return weights(z, n).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS, epochs: int = 6) -> np.ndarray:
    """Weights from labelled rows of `docs`. labels: doc_id, quality (0 or 1; other values and NULL are left out, the
    smallest of several counts). usable: on doc_id, which rows training may see. No usable label gives zero weights."""
    known = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
             .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")))
    n = known.count()
    share = min(1.0, train_rows / max(n, 1))
    # about train_rows rows of two numbers
    sample = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = BytesHasher()
        for b in batches:
            for at, data, offsets in pieces(b.column("text")):
                slots, values, first = features(data, offsets, hasher)
                k = len(first) - 1
                yield pa.record_batch([
                    b.column("doc_id").slice(at, k), b.column("label").slice(at, k),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(slots, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.float32()))],
                    ["doc_id", "label", "slots", "vals"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(s, v, y) for b in batches for s, v, y in zip(
            (x.values.to_numpy() for x in b.column("slots")), (x.values.to_numpy() for x in b.column("vals")), b.column("label").to_pylist(), strict=True)]
        yield pa.record_batch([pa.array([ftrl(seen * epochs).tobytes()], pa.binary())], ["weights"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ready = rows.mapInArrow(featured, f"doc_id {kind}, label int, slots array<int>, vals array<float>")
    found = (ready.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")  # the bounded sample only
             .mapInArrow(fitted, "weights binary").collect())
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, name: str = "quality_score") -> DataFrame:
    """docs with a column `name` (probability of label 1). NULL counts as the empty text, which gets the score of the
    bias alone. Every row is scored by itself, whole; other columns stay. An input column of that name is replaced."""
    docs = docs.drop(name)
    plain, at = plain_names(docs), docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = BytesHasher(), shared.value
        for b in batches:
            out = []
            for _, data, offsets in pieces(b.column(at)):
                slots, values, first = features(data, offsets, hasher)
                total = np.concatenate([[0.0], np.cumsum(w[slots] * values)])
                out.append(1.0 / (1.0 + np.exp(-(w[0] + total[first[1:]] - total[first[:-1]]))))
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())],
                                  schema=b.schema.append(pa.field(name, pa.float64())))

    return plain.mapInArrow(scored, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())])).toDF(*docs.columns, name)


def _trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> np.ndarray:
    """Weights that held-out rows have no part in."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return train(docs, labels, ~held_out())


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, _trained(spark, docs, sf_dir)).select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns, whatever the names of those beside doc_id
    and text. doc_id may be of any type that joins with that of labels; rows without id or label are scored too."""
    configure_text(spark)
    name = free_name(docs, "quality_score")
    return score(docs, _trained(spark, docs, sf_dir), name).filter(F.col(name) >= least).select(columns_of(docs))
