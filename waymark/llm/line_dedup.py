"""Line dedup: sharded minimal perfect hashes over distinct lines index fingerprint and count arrays, which documents
probe instead of joining lines."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, configure_text, documents, free_name, materialize, mix, plain_names, row_hash, same_row

#: Distinct lines in a shard, about.
SHARD_LINES = 200_000
#: Copies of each shard that probes are dealt over, so that a line of very many documents has no task of its own.
COPIES = 4
LEVELS = 40


class LineIndex:
    """Minimal perfect hash of distinct 64-bit keys, with a 16-bit fingerprint and a 16-bit count (saturating) per key.

    Level by level, keys that hash to a bit of their own get it and the rest go on to the next level of twice as many
    bits as keys; a key's number is the rank of its bit. Keys that no level separates (hardly ever any) are looked up.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, base = keys, 0
        while len(rest) and len(self.levels) < LEVELS:
            size = -(-2 * len(rest) // 64) * 64
            at = self._at(rest, len(self.levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, (base + np.cumsum(ones) - ones).astype(np.uint32)))
            base += int(ones.sum())
            rest = rest[~alone[at]]
        self.rest, self.base = np.sort(rest), base
        number = self.numbers(keys)
        self.fingerprints, self.counts = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.uint16)
        self.fingerprints[number] = self._print(keys)
        self.counts[number] = np.minimum(counts, 65535)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (mix(keys + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(48)).astype(np.uint16)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; of keys outside, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = self._at(keys[left], level, size)
            word, bit = words[at >> np.uint64(6)], at & np.uint64(63)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[there]] = ranks[(at >> np.uint64(6))[there]].astype(np.int64) + below[there]
            left = left[~there]
            if not len(left):
                break
        if len(left) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            there = self.rest[i] == keys[left]
            out[left[there]] = self.base + i[there]
        return out

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key; 0 where the fingerprint tells a stranger."""
        number = self.numbers(keys)
        known = number >= 0
        known[known] = self.fingerprints[number[known]] == self._print(keys[known])
        return np.where(known, self.counts[np.maximum(number, 0)] if len(self.counts) else 0, 0)


def line_keys(text: str | None) -> list[int | None]:
    """For each line a 64-bit hash (signed) of its key: stripped of ASCII white space, A-Z lower-cased. None: empty key."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()
        h = xxhash.xxh3_64_intdigest(key) if key else 0
        out.append((h - (1 << 64) if h >> 63 else h) if key else None)
    return out


def common_lines(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, __row, __lines: the hashes of those of a row's lines that at least `least` rows have."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [{k for k in line_keys(t.as_py()) if k is not None} for t in b.column("text")]
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.record_batch([b.column("doc_id").take(pa.array(at)), b.column("__row").take(pa.array(at)),
                                   pa.array([k for s in sets for k in s], pa.int64())], ["doc_id", "__row", "line"])

    lines = materialize(docs.select("doc_id", "__row", "text").mapInArrow(of_rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, __row long, line long"))
    counts = materialize(lines.groupBy("line").agg(F.count("*").alias("n")))
    shards = -(-counts.count() // SHARD_LINES) or 1
    shard = F.pmod(F.xxhash64("line"), F.lit(shards)).cast("int")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        index = LineIndex(pdf["line"].to_numpy().view(np.uint64), pdf["n"].to_numpy())
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "index": [pickle.dumps(index.__dict__, 5)]})

    index = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(build, "shard int, index binary")
    nothing = {c: F.lit(None).cast(lines.schema[c].dataType) for c in ("doc_id", "__row", "line")}
    deals = index.select("shard", F.explode(F.array(*[F.lit(i) for i in range(COPIES)])).alias("copy"), F.lit(0).alias("kind"), "index").withColumns(nothing)
    asks = lines.select("doc_id", "__row", "line", shard.alias("shard"), F.pmod(F.xxhash64("__row", "doc_id"), F.lit(COPIES)).cast("int").alias("copy"),
                        F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("index"))
    # in each partition the arrays of a shard come first, then its probes
    dealt = deals.unionByName(asks).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            heads = np.flatnonzero(b.column("kind").to_numpy(zero_copy_only=False) == 0)
            for start, end in zip([-1, *heads], [*heads, b.num_rows], strict=True):
                if start >= 0:
                    index = LineIndex.__new__(LineIndex)
                    index.__dict__ = pickle.loads(b.column("index")[int(start)].as_py())
                part = b.slice(start + 1, end - start - 1)
                if part.num_rows:
                    keys = part.column("line").to_numpy(zero_copy_only=False).view(np.uint64)
                    hit = pa.array(index.probe(keys) >= least)
                    yield part.select(["doc_id", "__row", "line"]).filter(hit)

    found = dealt.mapInArrow(probe, lines.schema)
    return found.groupBy("doc_id", "__row").agg(F.collect_set("line").alias("__lines"))


def dedup_lines(docs: DataFrame, least: int = 10, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text, or what `names` calls them: lines whose key at least `least` rows have go from every text, the
    first included; other lines stay as they are, joined by newline.

    A NULL or empty text is one empty line; empty keys always stay. Each row counts as a document of its own, repeated
    ones too. Other columns stay; input columns of the three names are replaced. An empty table gives no rows. Keys are
    told apart by 64-bit hashes.
    """
    if least > 65535:
        raise ValueError("counts saturate at 65535")
    docs = docs.drop(*names)
    row, held = free_name(docs, "__row"), free_name(docs, "__lines")
    keyed = docs.withColumn(row, row_hash())
    common = common_lines(docs.select("doc_id", row_hash().alias("__row"), "text"), least)
    joined = keyed.join(common, same_row(keyed, common, row), "left").select(*[keyed["`" + c + "`"] for c in docs.columns], common["__lines"].alias(held))
    plain, at = plain_names(joined), docs.columns.index("text")
    schema = T.StructType([*plain.schema.fields[:-1], *(T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.StringType()), strict=True))])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, gone, kept = [], [], []
            for text, lines in zip(b.column(at).to_pylist(), b.column(-1).to_pylist(), strict=True):
                text = text or ""
                drop = set(lines or ())
                total.append(text.count("\n") + 1)
                stay = [x for x, k in zip(text.split("\n"), line_keys(text), strict=True) if k not in drop] if drop else None
                gone.append(0 if stay is None else total[-1] - len(stay))
                kept.append(text if stay is None else "\n".join(stay))
            own = b.select(list(range(b.num_columns - 1)))
            added = tuple(zip(names, (total, gone, kept), (pa.int64(), pa.int64(), pa.string()), strict=True))
            full = own.schema
            for name, _, kind in added:
                full = full.append(pa.field(name, kind))
            yield pa.record_batch([*own.columns, *(pa.array(x, kind) for _, x, kind in added)], schema=full)

    return plain.mapInArrow(rebuild, schema).toDF(*docs.columns, *names)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from (select doc_id, text, row_number() over () as doc from documents)),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (select key from keyed where key <> '' group by key having count(distinct doc) >= 10)
select k.doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (c.key is null), '')) as kept_sha256
from keyed k left join common c on k.key = c.key
group by k.doc, k.doc_id
"""


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without its common lines; n_chars follows the text. A text that loses nothing stays as it is, NULL too. Columns
    beside doc_id, text and n_chars may have any name."""
    configure_text(spark)
    names = tuple(free_name(docs, n) for n in ("n_lines", "n_dropped", "kept_text"))
    text = F.when(F.col(names[1]) == 0, F.col("text")).otherwise(F.col(names[2]))
    done = dedup_lines(docs, names=names).withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(columns_of(docs))
