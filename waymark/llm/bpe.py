"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import configure_text, documents, plain_names

#: Pieces of text whose ids one worker remembers.
REMEMBERED = 400_000

#: White space, and how a byte-level pre-tokeniser splits text.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else
    the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Exact encoder and decoder of one byte-level vocabulary file.

    Merges are known by rank: a token's rank is that of the merge that makes it, below that single bytes. A sequence of
    tokens is the one that merging by rank gives exactly if each two neighbours are compatible, that is if merging their
    joined bytes gives them back. So the encoder takes the longest token at a place, steps to shorter ones where it
    isn't compatible with its predecessor, and steps back where none is; a place found dead is never tried again.
    """

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            vocab.pop(content.encode(), None)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.vocab = vocab
        self.rank = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            i = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = i
            if self.halves[i] is None:
                self.halves[i], self.rank[i] = (vocab[a], vocab[b]), r
        # tokens as strings of one letter a byte: what the automaton takes
        self.longest = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.longest.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.longest.make_automaton()
        self.shorter = [next((vocab[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in vocab), -1) for t in self.token]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.length = [len(t) for t in self.token]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum(self.length)])
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.split = regex.compile(SPLIT)
        self.coarse = re.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank never joins across the border of a and b. Undo the merges of both in falling rank;
        at each state the two tokens at the border must not merge earlier than the next merge that was undone."""
        x, y, rank = a, b, self.rank
        bound = len(rank) + 1  # rank of the merge undone last: what joins at the border must come before it
        good = True
        while True:
            joined = self.merged.get((x, y))
            # at equal rank the left merge comes first, so a merge undone on the right loses a tie
            if joined is not None and rank[joined] < bound:
                good = False
                break
            if rank[x] < 0 and rank[y] < 0:
                break
            if rank[x] > rank[y]:
                bound, x = rank[x], self.halves[x][1]
            else:
                bound, y = rank[y] + 1, self.halves[y][0]
        if len(self.pairs) < REMEMBERED:
            self.pairs[a, b] = good
        return good

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if (whole := self.vocab.get(data)) is not None:
            return [whole]
        n = len(data)
        start = [-1] * n  # longest token from each place: matches come by their end
        for end, (back, i) in self.longest.iter(data.decode("latin-1")):
            start[end - back] = i
        length, shorter, pairs, compatible = self.length, self.shorter, self.pairs.get, self.compatible
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, last = 0, start[0], -1
        while True:
            end = at + length[token]
            if not dead[end] and (last < 0 or (compatible(last, token) if (good := pairs((last, token))) is None else good)):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, start[end]
            elif (token := shorter[token]) < 0:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def _piece(self, piece: str) -> bytes:
        known, out = self.known, []
        for part in (self.split.findall(piece) if not piece.isalpha() else (piece,)):
            if (packed := known.get(part)) is None:
                packed = b"".join([self.packed[i] for i in self.encode_bytes(part.encode())])
                if len(known) < REMEMBERED:
                    known[part] = packed
            out.append(packed)
        packed = b"".join(out)
        if len(out) > 1 and len(known) < REMEMBERED:
            known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        known, piece = self.known.get, self._piece
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.packed[self.special[part]])
            else:
                out += [known(p) or piece(p) for p in self.coarse.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens: one gather from the table of all tokens' bytes by their offsets."""
        i = np.frombuffer(ids, "<u4")
        first = self.offsets[i]
        size = self.offsets[i + 1] - first
        end = np.cumsum(size)
        return self.bytes[np.repeat(first - end + size, size) + np.arange(end[-1] if len(end) else 0)].tobytes()


def codec(text: str) -> Codec:
    """One codec a worker process and vocabulary."""
    made = sys.__dict__.setdefault("_waymark_codecs", {})
    key = hashlib.sha256(text.encode()).digest()
    if key not in made:
        made.clear()
        made[key] = Codec(text)
    return made[key]


def encode_decode(docs: DataFrame, vocabulary: str | None = None, ids: bool = False, decoded: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and if asked ids (array<int>) and decoded (string). NULL and
    empty texts have no tokens. Each row by itself, whole; repeated rows stay. Input columns of these names are replaced.
    vocabulary: path of the file on the driver; its text goes to the workers."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, whatever the corpus
    added = [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())]
    added += [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))] * ids + [("decoded", T.StringType(), pa.string())] * decoded
    docs = docs.drop(*(name for name, _, _ in added))
    plain, at = plain_names(docs), docs.columns.index("text")
    schema = T.StructType(list(plain.schema.fields))
    for name, kind, _ in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            out: list[list] = [[] for _ in added]
            for text in b.column(at):
                packed = c.encode(text.as_py() or "")
                plain = c.decode(packed).decode("utf-8", "replace")
                row = [len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()]
                row += [np.frombuffer(packed, "<i4")] * ids + [plain] * decoded
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            full = b.schema
            for name, _, kind in added:
                full = full.append(pa.field(name, kind))
            yield pa.record_batch([*b.columns, *(pa.array(x, kind) for x, (_, _, kind) in zip(out, added, strict=True))], schema=full)

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *(name for name, _, _ in added))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")


def tokens_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure_text(spark)
    return encode_decode(docs)
