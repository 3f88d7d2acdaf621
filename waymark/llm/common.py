"""Settings, row keys and byte-level text helpers that the operators of this package share."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, materialize

__all__ = ["BytesHasher", "columns_of", "configure_text", "counted_broadcasts", "documents", "free_name", "materialize", "mix", "pieces", "plain_names", "row_hash", "same_row",
           "shingles", "token_bounds", "BLANK_CLASS", "WORD_OR_SIGN_CLASS", "LOWER"]

#: Rows and bytes that one Arrow batch hands to Python; with long texts the default of 10,000 rows is too much memory.
BATCH_ROWS, BATCH_BYTES = "1000", str(8 << 20)
#: Bytes of text that one numpy step works on.
PIECE_BYTES = 1 << 20
#: Bytes, as a shuffle counted them, up to which counted_broadcasts lets a side of a join be broadcast.
SENT_BYTES = 1 << 20


def configure_text(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def counted_broadcasts(fn: Callable) -> Callable:
    """fn, in which Spark broadcasts a side of a join only by bytes that a shuffle has counted, SENT_BYTES or what the session
    allows, if less. Elsewhere it goes by the size of compressed files, and what is read from 10 MB of them, or exploded after
    that, takes many times as much on the driver. Broadcasts that the code asks for stay. It holds for what fn runs itself,
    not for the plan of the DataFrame that it returns."""
    fixed, counted = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

    @functools.wraps(fn)
    def run(*args, **kwargs):
        conf = next(x for x in [*args, *kwargs.values()] if isinstance(x, DataFrame)).sparkSession.conf
        before = {k: conf.get(k, None) for k in (fixed, counted)}
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)i?b?", (before[counted] or conf.get(fixed)).strip().lower()).groups()
        conf.set(counted, str(min(SENT_BYTES, int(number) << 10 * " kmgtp".index(unit or " "))))
        conf.set(fixed, "-1")
        try:
            return fn(*args, **kwargs)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure_text(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def row_hash(text: Column = None) -> Column:
    """With doc_id, the identity of a row: rows that repeat both have the same result, so they may share it."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def same_row(a: DataFrame, b: DataFrame, own: str = "__row") -> Column:
    """Join condition on (doc_id, __row); a NULL doc_id is an id like any other. own: what a calls its hash."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a[own] == b["__row"])


def free_name(df: DataFrame, name: str) -> str:
    """name, or with as many underscores in front that no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plain_names(df: DataFrame) -> DataFrame:
    """df with its columns called c0, c1...: mapInArrow resolves columns by name and takes a dot for a field."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def columns_of(df: DataFrame) -> list[Column]:
    """All columns by name, such as hold dots too."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


# --- bytes -------------------------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: 0 is white space (the six of ASCII), 1 the rest.
BLANK_CLASS = np.ones(256, np.uint8)
BLANK_CLASS[[9, 10, 11, 12, 13, 32]] = 0

#: 0 white space, 1 letters, digits and all beyond ASCII, 2 other signs.
WORD_OR_SIGN_CLASS = np.full(256, 2, np.uint8)
WORD_OR_SIGN_CLASS[:33] = 0
WORD_OR_SIGN_CLASS[48:58] = WORD_OR_SIGN_CLASS[65:91] = WORD_OR_SIGN_CLASS[97:123] = WORD_OR_SIGN_CLASS[128:] = 1


def pieces(texts: pa.Array, limit: int = PIECE_BYTES):
    """Runs of rows of about `limit` bytes: (first row, bytes, offsets of rows and end). NULL is empty. A longer
    text is a run of its own."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kinds = texts.buffers()
    offsets = np.frombuffer(kinds[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(kinds[2], np.uint8) if kinds[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def token_bounds(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Start and end of every run of one class other than 0, never across rows, and for each row the number of its
    first token."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    real = kind[at[:-1]] > 0
    starts, ends = at[:-1][real], at[1:][real]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BytesHasher:
    """64-bit hashes of many byte ranges at once: differences of a prefix sum of powers."""

    BASE = 0xD1342543DE82EF95

    def __init__(self):
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _reach(self, n: int):
        if len(self.powers) <= n:
            n = max(2 * n, PIECE_BYTES) + 1
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 1 << 64))):
                    step = np.full(n, base, np.uint64)
                    step[0] = 1
                    setattr(self, name, np.cumprod(step))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, size: int):
    """Hashes of `size` consecutive words of each row, and for each row the number of its first one. A row of fewer
    words, but not none, has its whole sequence as one."""
    n = np.diff(first)
    total = len(words)
    out = np.zeros(max(total - size + 1, 0), np.uint64)
    for j in range(size):
        out += mix(words[j:total - size + 1 + j] + np.uint64(j + 1)) * np.uint64(2 * j + 3) if len(out) else 0
    out = mix(out)
    keep = np.ones(len(out), bool)
    for j in range(1, size):  # those that would run into the next row
        late = first[1:] - j
        late = late[(late >= 0) & (late < len(out))]
        keep[late] = False
    counts = np.maximum(n - size + 1, 0)
    short = np.flatnonzero((n > 0) & (n < size))
    full = out[keep]
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for i, r in enumerate(short):
            own = words[first[r]:first[r + 1]]
            whole[i] = mix(np.sum(mix(own + np.arange(1, len(own) + 1, dtype=np.uint64)), dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
        full = np.insert(full, np.concatenate([[0], np.cumsum(counts)])[short], whole)
        counts[short] = 1
    return full, np.concatenate([[0], np.cumsum(counts)])
