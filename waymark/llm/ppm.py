"""Language-model scoring by prediction by partial matching over bytes, beside a smoothed unigram model of words."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, LOWER, BytesHasher, documents, materialize, mix, pieces, token_bounds

#: Bytes that UTF-8 never has: before the text, and its end.
BEFORE, END = 0xFE, 0xFF
#: Symbols that a text can hold: all bytes but those two, and the end.
SYMBOLS = 255
#: Most words whose counts go to every task; the rest are joined.
FREQUENT = 200_000
#: The end of a text as a word.
END_WORD = 1
#: Bytes of the longest context of the query.
ORDER = 5
#: Bytes of text that share one list of questions to the shards, and symbols sorted at once for it.
CHUNK_BYTES, SORTED = 16 << 20, 1 << 22
#: Symbols of training text for each partition of shards, and shards of a partition.
SHARD_SYMBOLS, SHARDS = 32 << 20, 4


def grams(data: np.ndarray, offsets: np.ndarray):
    """For each byte and each end: two bytes of context and the symbol, as one number; and the first of each row."""
    rows = len(offsets) - 1
    at = np.arange(len(data)) + 3 * np.repeat(np.arange(rows), np.diff(offsets)) + 2
    full = np.full(len(data) + 3 * rows, BEFORE, np.uint8)
    full[at] = data
    first = offsets + 3 * np.arange(rows + 1)
    full[first[1:] - 1] = END
    wide = full.astype(np.int32)
    all_ = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:] if len(wide) else np.zeros(0, np.int32)
    real = np.ones(len(all_), bool)
    for j in (2, 1):  # those whose symbol is padding
        real[first[1:-1] - j] = False
    return all_[real], offsets + np.arange(rows + 1)


def probabilities(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 P(symbol | two bytes) for all 2**24 combinations, from counts of three-byte contexts of the training texts.

    Escape by method C: a context with T symbols of D kinds gives c / (T + D) to each and D / (T + D) to leaving for the
    next shorter one, where the kinds already seen are excluded; below that of no bytes, all unseen symbols are alike.
    """
    a, b, s = keys >> 16, (keys >> 8) & 255, keys & 255
    two, one = np.zeros((256, 256)), np.zeros(256)
    np.add.at(two, (b, s), counts)
    one = two.sum(0)
    legal = np.ones(256, bool)
    legal[BEFORE] = False
    unseen = legal & (one == 0)
    out = np.empty((256, 256, 256), np.float32)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(257))

    def level(weights: np.ndarray, excluded: np.ndarray):
        """Shares of the kinds that are not excluded, and what is left for leaving."""
        w = np.where(excluded, 0.0, weights)
        total, kinds = w.sum(-1, keepdims=True), (w > 0).sum(-1, keepdims=True)
        whole = np.where(kinds > 0, total + kinds, 1.0)
        return w / whole, np.where(kinds > 0, kinds / whole, 1.0)

    for mid in range(256):
        own = order[cut[mid]:cut[mid + 1]]
        three = np.zeros((256, 256))
        np.add.at(three, (a[own], s[own]), counts[own])
        p2, left2 = level(three, np.zeros(256, bool))
        p1, left1 = level(two[mid], three > 0)
        p0, left0 = level(one, two[mid] > 0)
        last = unseen / max(unseen.sum(), 1)
        p = p2 + left2 * (p1 + left1 * (p0 + left0 * last))
        with np.errstate(divide="ignore"):
            out[:, mid, :] = np.log10(p)
    return out.reshape(-1)


def contexts(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte and each end: `order` bytes of context, the nearest first, and the symbol as one number."""
    rows = len(offsets) - 1
    full = np.full(len(data) + (order + 1) * rows, BEFORE, np.uint8)
    full[np.arange(len(data)) + (order + 1) * np.repeat(np.arange(rows), np.diff(offsets)) + order] = data
    first = offsets + (order + 1) * np.arange(rows + 1)
    full[first[1:] - 1] = END
    wide = full.astype(np.uint64)
    out = wide[order:].copy()
    for j in range(1, order + 1):
        out |= wide[order - j:-j] << np.uint64(8 * (order - j + 1))
    real = np.ones(len(out), bool)
    for j in range(1, order + 1):  # those whose symbol is padding
        real[first[1:-1] - j] = False
    return out[real]


def summed(keys: np.ndarray, n: np.ndarray):
    """Keys in order, each once, with the sum of its numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n[order], at) if len(at) else n


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as differences, compressed byte plane by byte plane."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return np.int64(len(keys)).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    planes = np.frombuffer(pa.decompress(blob[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


class Level:
    """Contexts of one length with what leaving them costs, and their symbols; sorted arrays.

    Symbols of a context are among those of each shorter one, so what a shorter one excludes depends on the two alone.
    """

    def __init__(self, nodes: np.ndarray, n: np.ndarray, shorter: Level | None):
        self.nodes, self.n = nodes, n.astype(np.float64)
        owner = nodes >> np.uint64(8)
        at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(nodes) else np.zeros(0, np.int64)
        self.keys = owner[at]
        self.total = np.add.reduceat(self.n, at) if len(at) else np.zeros(0)
        self.kinds = np.diff(np.append(at, len(nodes))).astype(np.float64)
        self.whole = np.log10(self.total + self.kinds)
        self.down = np.zeros(len(at))  # of leaving all shorter ones
        self.enter = np.zeros(len(at))
        if shorter is not None and len(at):
            up = np.searchsorted(shorter.keys, self.keys >> np.uint64(8))
            same = shorter.n[np.searchsorted(shorter.nodes, (owner >> np.uint64(8)) << np.uint64(8) | nodes & np.uint64(255))]
            kinds = shorter.kinds[up] - self.kinds
            rest = np.where(kinds > 0, shorter.total[up] - np.add.reduceat(same, at) + kinds, 1.0)
            self.down = shorter.down[up] + np.where(kinds > 0, np.log10(np.maximum(kinds, 1) / rest), 0.0)
            self.enter = -self.down - np.log10(rest)
        self.leave = np.log10(np.maximum(self.kinds, 1)) - self.whole + self.down


def levels(nodes: np.ndarray, n: np.ndarray, order: int, known: list[Level]) -> list[Level]:
    """Levels up to `order`, of which `known` are made, from the counts of the longest contexts."""
    lists = [(nodes, n)]
    for _ in range(order - len(known)):
        nodes, n = lists[-1]
        lists.append(summed(nodes >> np.uint64(16) << np.uint64(8) | nodes & np.uint64(255), n))
    out = list(known)
    for nodes, n in lists[::-1]:
        out.append(Level(nodes, n, out[-1] if out else None))
    return out


def log_shares(asked: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 P(symbol | context) of each of `asked`."""

    def find(keys, wanted):
        if not len(keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return i, keys[i] == wanted

    out = np.empty(len(asked))
    left, before = np.arange(len(asked)), np.zeros(len(asked), np.int64)
    spent, below = np.zeros(len(asked)), np.zeros(len(asked), bool)  # of leaving the longest context that was seen
    for j in range(len(trie) - 1, -1, -1):
        level, key = trie[j], asked[left] >> np.uint64(8 * (len(trie) - j))
        i, seen = find(level.keys, key)
        k, there = find(level.nodes, key << np.uint64(8) | asked[left] & np.uint64(255))
        at, old = there & ~below, there & below
        out[left[at]] = np.log10(level.n[k[at]]) - level.whole[i[at]]
        if old.any():
            out[left[old]] = spent[old] + trie[j + 1].enter[before[old]] + np.log10(level.n[k[old]])
        new = seen & ~below
        spent[new] = level.leave[i[new]]
        stay = ~there
        left, before, spent, below = left[stay], i[stay], spent[stay], (below | seen)[stay]
    out[left] = spent - np.log10(max(SYMBOLS - len(trie[0].nodes), 1))
    return out


def low_levels(trigrams: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels 0 to 2 from counts of three bytes, at most 2**24 of them."""
    k = trigrams.astype(np.uint64)
    turned = (k >> np.uint64(8) & np.uint64(255)) << np.uint64(16) | k >> np.uint64(16) << np.uint64(8) | k & np.uint64(255)
    return levels(*summed(turned, n), 2, [])


def chunked(docs: DataFrame, learn: Column) -> DataFrame:
    """chunk, doc_id, text, learn of every row, written once: a chunk is about CHUNK_BYTES of one task."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            size = b.column("text").nbytes
            if held and held + size > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            held += size
            yield pa.record_batch([pa.array(np.full(len(b), chunk)), *b.columns], ["chunk", *b.schema.names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    return materialize(rows.mapInArrow(numbered, f"chunk long, doc_id {id_type}, text string, learn boolean"))


def answers(rows: DataFrame, trigrams, order: int, parts: int) -> DataFrame:
    """chunk, keys, p: log10 of the share of every distinct (context, symbol) of each chunk.

    The trie is cut by the hash of the three nearest bytes of context, so all longer contexts of a place share a shard
    with it; shorter ones have at most 2**24 counts and go to every task. Chunks send each shard their distinct counts
    (kind 0) and, once it holds all of these, stream their distinct questions past it (kind 1). A shard's memory follows
    its distinct counts, of which three bytes have at most 2**24 at order 5.
    """
    shards = parts * SHARDS

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, held, found, chunk = [], 0, [], None

        def count():
            if raw:
                keys = np.concatenate(raw)
                keys.sort()
                at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                found.append((keys[at], np.diff(np.append(at, len(keys)))))
                raw.clear()

        def flush():
            count()
            keys, n = summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
            found.clear()
            learnt, wanted = keys & np.uint64(1) > 0, keys >> np.uint64(1)
            for kind, part, times in ((0, wanted[learnt], n[learnt]), (1, np.unique(wanted), None)):
                to = (mix(part >> np.uint64(8 * (order - 2))) % np.uint64(shards)).astype(np.int32)
                by = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[by], np.arange(shards + 1))
                full = np.flatnonzero(np.diff(cut))
                for some in np.array_split(full, max(1, len(full) // 64)):
                    own = [by[cut[i]:cut[i + 1]] for i in some]
                    yield pa.record_batch([
                        pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), pa.array(np.full(len(some), chunk)),
                        pa.array([packed(part[x]) for x in own], pa.binary()), pa.array([b"" if times is None else times[x].tobytes() for x in own], pa.binary())],
                        ["shard", "kind", "chunk", "keys", "n"])

        for b in batches:
            ids = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)] if len(ids) else []
            for lo, hi in zip(cuts, cuts[1:]):
                if chunk is not None and chunk != ids[lo]:
                    yield from flush()
                    held = 0
                chunk = int(ids[lo])
                learn = b.column("learn").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(np.uint64)
                for at, data, offsets in pieces(b.column("text").slice(lo, hi - lo)):
                    keys = contexts(data, offsets, order) << np.uint64(1)
                    keys |= np.repeat(learn[at:at + len(offsets) - 1], np.diff(offsets) + 1)
                    raw.append(keys)
                    held += len(keys)
                    if held > SORTED:
                        count()
                        held = 0
        if chunk is not None:
            yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = low_levels(*trigrams.value)
        shard, keys, n, waiting, size, trie = None, None, None, [], 0, None
        for b in batches:
            ids, kinds, chunks = (b.column(c).to_numpy() for c in ("shard", "kind", "chunk"))
            done = []
            for r in range(len(b)):
                if ids[r] != shard:
                    shard, keys, n, waiting, size, trie = ids[r], np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0, None
                mine = unpacked(b.column("keys")[r].as_py())
                if kinds[r] == 0:
                    waiting.append((mine, np.frombuffer(b.column("n")[r].as_py(), np.int64)))
                    size += len(mine)
                if waiting and (kinds[r] or size > max(len(keys), 1 << 20)):
                    keys, n = summed(np.concatenate([keys, *[k for k, _ in waiting]]), np.concatenate([n, *[x for _, x in waiting]]))
                    waiting, size = [], 0
                if kinds[r]:
                    trie = trie or levels(keys, n, order, low)
                    done.append((int(chunks[r]), b.column("keys")[r].as_py(), log_shares(mine, trie).astype(np.float32).tobytes()))
            if done:
                yield pa.record_batch([pa.array([x[0] for x in done], pa.int64()), *[pa.array([x[i] for x in done], pa.binary()) for i in (1, 2)]], ["chunk", "keys", "p"])

    asked = rows.select("chunk", "text", "learn").mapInArrow(ask, "shard int, kind int, chunk long, keys binary, n binary")
    return (asked.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, "chunk long, keys binary, p binary"))


def _word_hashes(data: np.ndarray, offsets: np.ndarray, hasher: BytesHasher):
    low = LOWER[data]
    starts, ends, first = token_bounds(low, offsets, BLANK_CLASS)
    return hasher.ranges(low, starts, ends), first


def gather(docs: DataFrame) -> DataFrame:
    """kind, key, n: counts over all texts of words (kind 0, by 64-bit hash) and of three-byte contexts (kind 1)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dense, words, held = BytesHasher(), np.zeros(1 << 24, np.uint32), [], 0

        def batch(kind, keys, n):
            return pa.record_batch([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])

        for b in batches:
            for _, data, offsets in pieces(b.column("text")):
                g, _ = grams(data, offsets)
                np.add.at(dense, g, np.uint32(1))
                h, _ = _word_hashes(data, offsets, hasher)
                words += [h, np.full(len(offsets) - 1, END_WORD, np.uint64)]
                held += len(h)
                if held > 1 << 20:
                    yield batch(0, *np.unique(np.concatenate(words), return_counts=True))
                    words, held = [], 0
        if words:
            yield batch(0, *np.unique(np.concatenate(words), return_counts=True))
        seen = np.flatnonzero(dense)
        yield batch(1, seen, dense[seen])

    return docs.select("text").mapInArrow(counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, learn: Column, order: int = 2) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; `learn` says on docs which rows both
    models learn from (NULL: not).

    Base: words between ASCII white space, A-Z lower-cased, then one end; sum of log10((c + 1) / (N + V + 1)). Score:
    log10 probability of the bytes and the end under the byte model. NULL is the empty text. Repeated rows count each and
    each have a result. Only doc_id and text are read, so other columns may have any name; very long texts are scored
    whole, piece by piece. With nothing to learn, N = V = 0 and the byte model is uniform. An empty table gives no rows.
    Contexts of the byte model have `order` bytes (2 to 5) and fewer. What goes to every task is bounded: at most
    FREQUENT word counts, and counts of three bytes (at most 2**24). Counts of longer contexts grow with the texts; they
    stay in shards, and each chunk of texts asks them for its distinct ones.
    """
    if not 2 <= order <= 5:
        raise ValueError("order is 2 to 5")
    spark = docs.sparkSession
    if order > 2:
        docs = chunked(docs, learn)
        learn = F.col("learn")
    counts = materialize(gather(docs.filter(learn)))
    words = counts.filter("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # counts from 2**k on: the smallest k that leaves FREQUENT words at most
    sizes = dict(words.groupBy(F.floor(F.log2("c")).cast("int")).count().collect())
    k = max(sizes, default=0) + 1
    while k > 0 and sum(n for e, n in sizes.items() if e >= k - 1) <= FREQUENT:
        k -= 1
    often = words.filter(F.col("c") >= 1 << k).toPandas()
    trie = counts.filter("kind = 1").select("key", "n").toPandas()
    often = often.assign(word=often["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
    shared_trie = trie["key"].to_numpy(np.int64), trie["n"].to_numpy(np.float64)
    shared = spark.sparkContext.broadcast((often["word"].to_numpy(np.uint64), often["c"].to_numpy(np.float64), *(shared_trie if order == 2 else ())))

    def dense():
        """Cost of each row of a piece, from one table."""
        _, _, keys, n = shared.value
        mark = hashlib.sha256(keys.tobytes() + n.tobytes()).digest()
        held = sys.__dict__.setdefault("_waymark_ppm", {})  # one table a worker process
        if mark not in held:
            held.clear()
            held[mark] = probabilities(keys, n)
        table = held[mark]

        def cost_of(data, offsets):
            g, first = grams(data, offsets)
            cost = np.concatenate([[0.0], np.cumsum(table[g], dtype=np.float64)])
            return cost[first[1:]] - cost[first[:-1]]

        return cost_of

    def looked_up(keys: np.ndarray, p: np.ndarray):
        """Cost of each row of a piece (fewer than 2**16 rows), from answers to its chunk."""

        def cost_of(data, offsets):
            g = contexts(data, offsets, order) << np.uint64(16)
            g |= np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets) + 1)
            g.sort()
            key = g >> np.uint64(16)
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            cost = np.repeat(p[np.searchsorted(keys, key[at])], np.diff(np.append(at, len(g))))
            return np.bincount((g & np.uint64(0xFFFF)).astype(np.int64), cost, minlength=len(offsets) - 1)

        return cost_of

    def scored(batches: Iterator[pa.RecordBatch], cost_of=None) -> Iterator[pa.RecordBatch]:
        hasher = BytesHasher()
        known, c = shared.value[:2]
        logs = np.log10(c + 1)
        cost_of = cost_of or dense()
        for b in batches:
            for at, data, offsets in pieces(b.column("text")):
                rows = len(offsets) - 1
                h, begin = _word_hashes(data, offsets, hasher)
                row = np.repeat(np.arange(rows), np.diff(begin))
                h, row = np.concatenate([h, np.full(rows, END_WORD, np.uint64)]), np.concatenate([row, np.arange(rows)])
                i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                there = known[i] == h if len(known) else np.zeros(len(h), bool)
                base = np.bincount(row[there], logs[i[there]], minlength=rows)
                rare, of = h[~there], row[~there]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
                begins = np.flatnonzero(new)
                times = np.diff(np.append(begins, len(rare)))
                lists = pa.array(np.searchsorted(of[begins], np.arange(rows + 1)), pa.int32())
                yield pa.record_batch([
                    b.column("doc_id").slice(at, rows), pa.array(np.diff(begin) + 1, pa.int64()), pa.array(np.bincount(row[there], minlength=rows), pa.int64()),
                    pa.array(base, pa.float64()), pa.array(cost_of(data, offsets), pa.float64()),
                    pa.ListArray.from_arrays(lists, pa.array(rare[begins].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))],
                    ["doc_id", "n_tokens", "known", "base", "score", "rare", "times"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {id_type}, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"

    def scored_chunk(texts: pa.Table, answered: pa.Table) -> pa.Table:
        keys = np.concatenate([unpacked(x) for x in answered.column("keys").to_pylist()])
        p = np.concatenate([np.frombuffer(x, np.float32) for x in answered.column("p").to_pylist()])
        by = np.argsort(keys)
        return pa.Table.from_batches(scored(texts.to_batches(max_chunksize=1000), looked_up(keys[by], p[by])))

    if order == 2:
        rows = docs.select("doc_id", "text").mapInArrow(scored, result)
    else:
        low = spark.sparkContext.broadcast(shared_trie)
        parts = max(12, int(shared_trie[1].sum()) // SHARD_SYMBOLS)
        told = answers(docs, low, order, parts)
        rows = docs.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(scored_chunk, result)
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))  # numbers hold once written
    asked = rows.select("uid", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))))
    answered = (asked.join(words.filter(F.col("c") < 1 << k), "word").groupBy("uid")
                .agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_base")))
    all_words = F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))
    return rows.select("uid", "doc_id", "n_tokens", "known", "base", "score").join(answered, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - all_words).alias("base_score"), "score")


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_texts(docs, ~held_out, ORDER).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
