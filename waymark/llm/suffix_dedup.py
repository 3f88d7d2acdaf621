"""Removal of repeated passages: windows that share an anchor meet, two-stage suffix sorting orders them, and adjacent
common prefixes tell which are equal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, pieces
from .suffix_order import anchors, equal_to_previous, window_order

#: Bytes of contexts that are sorted together.
CHUNK_BYTES = 4 << 20
#: Contexts of one anchor above which its windows are compared by rows instead.
GROUP_CONTEXTS = 200_000
#: Most copies (12 bytes each) whose list is sent to every task; beyond that the texts are joined by shuffle.
SMALL = 200_000
#: Stands for a NULL doc_id: after all others.
LAST = (1 << 63) - 1


def anchors_of(base: DataFrame, length: int) -> DataFrame:
    """key, tag, place, gram: every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tags = b.column("key").to_numpy(), b.column("tag").to_numpy()
            for at, data, offsets in pieces(b.column("text")):
                place, _, _, gram = anchors(data, offsets, length)
                row = np.searchsorted(offsets, place, "right") - 1
                yield pa.record_batch([pa.array(keys[at + row]), pa.array(tags[at + row]), pa.array((place - offsets[row]).astype(np.int32)), pa.array(gram.view(np.int64))],
                                      ["key", "tag", "place", "gram"])

    return base.mapInArrow(run, "key long, tag int, place int, gram long")


def contexts_of(texts: DataFrame, length: int) -> DataFrame:
    """gram, key, tag, start, context of the repeated anchors of texts (key, tag, text, places): all windows of an anchor
    as one string of bytes. Equal contexts of one batch are sent once, for the first of them; the rest have rows without
    context, from start to `end`, as they repeat it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first: dict[bytes, tuple] = {}
            gone = []
            keys, tags, places = b.column("key").to_pylist(), b.column("tag").to_pylist(), b.column("places")
            for at, data, offsets in pieces(b.column("text")):
                place, low, high, gram = anchors(data, offsets, length)
                row = np.searchsorted(offsets, place, "right") - 1
                size = len(offsets) - 1
                known = places.slice(at, size)
                lists = np.diff(known.offsets.to_numpy())
                asked = known.flatten().to_numpy() + offsets[:-1].repeat(lists)
                # a place may be the anchor of two runs of windows
                for i in np.flatnonzero(np.isin(place, asked)):
                    r = row[i]
                    who = (keys[at + r], tags[at + r], int(low[i] - offsets[r]))
                    text = data[low[i]:high[i] + length].tobytes()
                    held = first.get(text)
                    if held is None:
                        first[text] = (*who, int(gram[i].view(np.int64)))
                    elif held[:3] > who:
                        gone.append((*held[:3], held[2] + len(text)))
                        first[text] = (*who, held[3])
                    elif held[:3] != who:
                        gone.append((*who, who[2] + len(text)))
            rows = [(g, k, t, s, None, c) for c, (k, t, s, g) in first.items()] + [(None, k, t, s, e, None) for k, t, s, e in gone]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["gram", "key", "tag", "start", "end", "context"])

    return texts.select("key", "tag", "text", "places").mapInArrow(run, "gram long, key long, tag int, start int, end int, context binary")


def repeats_in(contexts: list[bytes], keys: list[int], tags: list[int], starts: list[int], length: int):
    """(context, first window, last window) of every run of windows that also start earlier: by key, tag and start."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    order = window_order(data, offsets[:-1], offsets[1:] - length, length)
    run = np.cumsum(~equal_to_previous(data, order, length))
    of = np.searchsorted(offsets, order, "right") - 1
    who = np.lexsort((tags, keys))
    changed = np.ones(len(who), np.int64)
    k, t = np.array(keys)[who], np.array(tags)[who]
    changed[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    rank = np.empty(len(who), np.int64)
    rank[who] = np.cumsum(changed)
    spot = (rank[of] << 32) | (np.array(starts)[of] + order - offsets[of])
    heads = np.flatnonzero(np.diff(run, prepend=0))
    least = np.minimum.reduceat(spot, heads) if len(heads) else spot
    again = np.sort(order[spot > least[run - 1]])
    new = np.ones(len(again), bool)
    of = np.searchsorted(offsets, again, "right") - 1
    new[1:] = (again[1:] != again[:-1] + 1) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(again)) - 1 if len(first) else first
    return of[first], again[first] - offsets[of[first]], again[last] - offsets[of[first]]


def sorted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """key, tag, start, end of what repeats among contexts of equal gram. Rows stream in order of gram and context, so
    equal contexts are told before anything is held, and whole groups are sorted together up to CHUNK_BYTES."""
    dealt = contexts.repartition("gram").sortWithinPartitions("gram", "context", "key", "tag", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["key", "tag", "start", "end"])

        held: list[tuple] = []
        size, gram, gone = 0, None, []

        def flush():
            if len(held) > 1:
                of, low, high = repeats_in([h[3] for h in held], [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], length)
                gone.extend((held[c][0], held[c][1], held[c][2] + x, held[c][2] + y + length) for c, x, y in zip(of.tolist(), low.tolist(), high.tolist(), strict=True))
            held.clear()

        last, head, since = None, None, 0  # since: where the group of the current gram begins
        for b in batches:
            for g, k, t, s, c in zip(*(b.column(x).to_pylist() for x in ("gram", "key", "tag", "start", "context")), strict=True):
                if g != gram:
                    if len(held) - since == 1:
                        size -= len(held.pop()[3])  # nothing shares its gram
                    if size > CHUNK_BYTES:
                        flush()
                        size = 0
                    gram, last, since = g, None, len(held)
                if c != last:
                    held.append((k, t, s, c))
                    size += len(c)
                    last, head = c, (k, t, s)
                elif (k, t, s) != head:
                    gone.append((k, t, s, s + len(c)))
            if gone:
                yield out(gone)
                gone.clear()
        flush()
        yield out(gone)

    return dealt.mapInArrow(run, "key long, tag int, start int, end int")


def counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors of too many contexts to hold: every window as a row, combined before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t, s, c in zip(*(b.column(x).to_pylist() for x in ("key", "tag", "start", "context")), strict=True):
                names = [hashlib.blake2b(c[i:i + length], digest_size=16).digest() for i in range(len(c) - length + 1)]
                n = len(names)
                yield pa.record_batch([pa.array(names), pa.array([k] * n, pa.int64()), pa.array([t] * n, pa.int32()), pa.array(range(s, s + n), pa.int32())], ["window", "key", "tag", "start"])

    windows = contexts.select("key", "tag", "start", "context").mapInArrow(run, "window binary, key long, tag int, start int").distinct()
    least = windows.groupBy("window").agg(F.min(F.struct("key", "tag", "start")).alias("least"))
    return windows.join(least, "window").filter(F.struct("key", "tag", "start") > F.col("least")).select("key", "tag", "start", (F.col("start") + length).alias("end"))


def sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def dedup_passages(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): every byte of the text covered by a string of `length`
    bytes that also starts earlier (smaller doc_id, NULL last, or earlier in the same text) is removed. Judged on the
    input; overlaps count; matches never cross texts, so kept bytes may be no whole characters.

    1. Of equal texts all but the first go whole (shorter than `length`: nothing goes). 2. Each window has one anchor,
    its gram of least hash. Anchors of a gram that stands once are dropped. 3. The windows of a repeated anchor travel as
    one context to where all of its gram meet, and are put in suffix order; equal neighbours beyond the first repeat.
    Anchors of more contexts than a task should hold are compared window by window as rows.

    NULL is the empty text. Rows that repeat doc_id and text are one document given twice: each gets the result of the
    first. Rows that share a doc_id are ordered by a hash of their texts. Empty table: no rows. Input columns n_bytes,
    n_removed, n_spans, kept are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__tag": F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int")})
    long_ = named.filter(F.octet_length("text") >= length)
    base = long_.select(F.col("__key").alias("key"), F.col("__tag").alias("tag"), "text")
    texts = base.select("key", "tag", F.unhex(F.md5(F.col("text").cast("binary"))).alias("name"), F.octet_length("text").alias("end"))
    first = texts.groupBy("name").agg(F.min(F.struct("key", "tag")).alias("first"))
    copies = materialize(texts.join(first, "name").filter(F.struct("key", "tag") != F.col("first")).select("key", "tag", F.lit(0).alias("start"), "end").distinct())
    base = base.join(sized(copies.select("key", "tag")), ["key", "tag"], "left_anti")

    # counts combine before their shuffle, and the join may split a gram of very many anchors
    spots = anchors_of(base, length)
    twice = spots.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    places = materialize(spots.join(twice, "gram").groupBy("key", "tag").agg(F.collect_set("place").alias("places")))
    found = materialize(contexts_of(base.join(places, ["key", "tag"]), length))
    contexts = found.filter(F.col("gram").isNotNull()).select("gram", "key", "tag", "start", "context")
    crowds = contexts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_CONTEXTS).select("gram")
    ranges = found.filter(F.col("gram").isNull()).select("key", "tag", "start", "end").unionByName(copies)
    if crowds.limit(1).count():
        crowds = materialize(crowds)
        ranges = ranges.unionByName(counted_repeats(contexts.join(crowds, "gram", "left_semi"), length))
        contexts = contexts.join(crowds, "gram", "left_anti")
    ranges = ranges.unionByName(sorted_repeats(contexts, length))
    removed = materialize(ranges.groupBy("key", "tag").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges")))

    # names of their own, so that no column of docs clashes
    removed = removed.select(F.col("key").alias("__key"), F.col("tag").alias("__tag"), F.col("ranges").alias("__ranges"))
    joined = named.join(removed, ["__key", "__tag"], "left").select(*docs.columns, "__ranges")
    span = "array<struct<start:int,end:int>>"
    # ranges in order of start: they extend the last one or begin another
    last = lambda a: F.element_at(a, -1)
    merged = F.aggregate("__ranges", F.array().cast(span), lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]), F.concat(
        F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))))
    joined = joined.withColumn("__ranges", F.coalesce(merged, F.array().cast(span)))
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    starts = F.concat(F.array(F.lit(0)), F.transform("__ranges", lambda r: r["end"]))
    ends = F.concat(F.transform("__ranges", lambda r: r["start"]), F.array(F.octet_length(bytes_)))
    kept = F.when(F.size("__ranges") == 0, bytes_).otherwise(F.aggregate(F.arrays_zip(starts.alias("s"), ends.alias("e")), F.lit(b"").cast("binary"),
                                                                       lambda a, p: F.concat(a, F.substring(bytes_, p["s"] + 1, p["e"] - p["s"]))))
    return joined.withColumns({
        "n_bytes": F.octet_length(bytes_).cast("long"), "n_spans": F.size("__ranges").cast("long"), "kept": kept,
        "n_removed": F.aggregate("__ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])}).drop("__ranges")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return dedup_passages(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
windows as (select doc_id, p, md5(substr(h, 2 * p + 1, 200)) as w from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from texts where length(h) >= 200)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by w order by doc_id, p) as nth from windows) where nth > 1),
runs as (select *, sum(fresh) over (partition by doc_id order by p) as run
         from (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh from again)),
spans as (select doc_id, run, min(p) as s, max(p) + 100 as e from runs group by doc_id, run),
gaps as (select doc_id, s, lag(e, 1, 0) over (partition by doc_id order by s) as from_, s as to_ from spans
         union all select t.doc_id, 1000000000, coalesce(max(e), 0), length(any_value(h)) // 2 from texts t left join spans using (doc_id) group by t.doc_id),
kept as (select doc_id, string_agg(substr(h, cast(2 * from_ + 1 as bigint), cast(2 * (to_ - from_) as bigint)), '' order by g.s) as k from gaps g join texts using (doc_id) group by doc_id)
select t.doc_id, length(h) // 2 as n_bytes, cast(coalesce((select sum(e - s) from spans x where x.doc_id = t.doc_id), 0) as bigint) as n_removed,
       (select count(*) from spans x where x.doc_id = t.doc_id) as n_spans, sha256(unhex(k)) as kept_sha256
from texts t join kept using (doc_id)
"""
