"""Secret scans: spans that a pattern proves, and weak candidates that only complementary parts nearby make credible."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, row_hash, same_row

#: The base patterns and least lengths. Letters of the first are meant in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Spans are sorted by start, then by this order.
KINDS = ("assign", "access", "hex", "bare", "user", "endpoint")

#: Parts that mean nothing alone.
USER = re.compile(r"""(?<![A-Za-z])(?:access_?key(?:_?id)?|client_?id|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?<![A-Za-z])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}""", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Scopes are blocks of lines between blank ones; parts reach this many code points beyond their ends.
BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
REACH = 300


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of assign, access and hex: leftmost and non-overlapping per kind; matches that are too short
    are dropped after they have taken their place. Code points, end exclusive; a span is its whole match."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]  # runs end where the class does, so 24+ is all of [0-9a-f]+
    return sorted(out)


def looks_random(token: str) -> bool:
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= 3.0


def weak_parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int]]:
    """(start, kind, end, role, scope) of all parts of a text that has an identifier; else none. Roles: id, secret, endpoint."""
    users = [m.span() for m in USER.finditer(text)] if re.search(r"[:=]", text) else []
    if not users and not any(k == 1 for _, k, _ in base):
        return []
    taken = [(s, e) for s, _, e in base] + users
    ends = [m.span() for m in ENDPOINT.finditer(text)]
    parts = [(s, k, e, "id" if k == 1 else "secret") for s, k, e in base]
    parts += [(s, 4, e, "id") for s, e in users] + [(s, 5, e, "endpoint") for s, e in ends]
    taken = sorted(taken + ends)
    at = 0
    for m in BARE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if (at == len(taken) or taken[at][0] >= m.end()) and looks_random(m[0]):
            parts.append((m.start(), 3, m.end(), "secret"))
    cuts = [m.start() for m in BLANK_LINE.finditer(text)]
    out, scope = [], 0
    for s, k, e, role in sorted(parts):
        while scope < len(cuts) and cuts[scope] < s:
            scope += 1
        out.append((s, k, e, role, scope))
    return out


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (text of the base spans), base_sha256, spans (all, with the linked ones).

    A bare random token is reported if an identifier (access key, user or client id) lies within reach in its scope; a
    user id if a secret and an endpoint do; an endpoint if an identifier and a secret do. Nearest parts are read off
    ordered windows, one scope of one text at a time: no pairs are formed.
    NULL is the empty text. Each row by itself and whole; rows that repeat doc_id and text stay, with equal results.
    Columns other than doc_id and text are left out.
    """
    rows = docs.select("doc_id", "text", row_hash().alias("__row"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    part = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("role", pa.string()), ("scope", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, parts = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                found = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                parts.append([{"start": s, "kind": k, "end": e, "role": r, "scope": c} for s, k, e, r, c in weak_parts(text, found)])
            yield pa.record_batch([b.column("doc_id"), b.column("__row"), pa.array(base, span), pa.array(parts, part)], ["doc_id", "__row", "base", "parts"])

    struct = "array<struct<start:int,kind:int,end:int{}>>"
    found = rows.mapInArrow(scan, f"doc_id {id_type}, __row long, base {struct.format('')}, parts {struct.format(',role:string,scope:int')}")

    parts = found.filter(F.size("parts") > 0).dropDuplicates(["doc_id", "__row"]).select("doc_id", "__row", F.inline("parts"))
    scope = Window.partitionBy("doc_id", "__row", "scope").orderBy("start", "kind", "end")
    before, after = scope.rowsBetween(Window.unboundedPreceding, -1), scope.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for role in ("id", "secret", "endpoint"):
        own = F.col("role") == role
        near[role] = (F.coalesce(F.col("start") - F.max(F.when(own, F.col("end"))).over(before) <= reach, F.lit(False))
                      | F.coalesce(F.min(F.when(own, F.col("start"))).over(after) - F.col("end") <= reach, F.lit(False)))
    flagged = parts.withColumns({f"near_{role}": c for role, c in near.items()})
    linked = flagged.filter(F.when(F.col("kind") == 3, F.col("near_id"))
                            .when(F.col("kind") == 4, F.col("near_secret") & F.col("near_endpoint"))
                            .when(F.col("kind") == 5, F.col("near_id") & F.col("near_secret")).otherwise(False))
    added = linked.groupBy("doc_id", "__row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))

    def written(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    base = found.drop("parts")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    none = F.array().cast(struct.format(""))
    out = base.join(added, same_row(base, added), "left").select(
        base["doc_id"], count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        written(F.col("base")).alias("base"), written(F.concat("base", F.coalesce("added", none))).alias("spans"))
    return out.withColumn("base_sha256", F.sha2(F.col("base").cast("binary"), 256))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
