"""N-gram Jaccard join: documents of identical prefix and size form one group; pairs of groups are filtered, then members
are expanded and verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CLASS, LOWER, BytesHasher, columns_of, configure_text, counted_broadcasts, documents, free_name, materialize, mix, pieces, row_hash, same_row, shingles, token_bounds
from .graph import components

#: Most candidates whose keys are sent to every task; beyond that the second scan joins all texts by shuffle.
SMALL = 500_000
#: Members of a list up to which all of its components are paired; in longer ones by their differences from one of them.
LONG = 32
#: Rounds in which long lists choose the hub they meet around; in the last one each list has its own choice.
ROUNDS = 4


def least_common(n: int, percent: int) -> int:
    """Least intersection of a set of n with a set it links to."""
    return -(-percent * n // 100)


def each_set(texts: pa.Array, size: int, hasher: BytesHasher):
    """Sorted distinct shingle hashes of each text, A-Z lower-cased, words between ASCII white space."""
    for _, data, offsets in pieces(texts):
        low = LOWER[data]
        starts, ends, first = token_bounds(low, offsets, BLANK_CLASS)
        all_, begin = shingles(hasher.ranges(low, starts, ends), first, size)
        for i in range(len(begin) - 1):
            yield np.unique(all_[begin[i]:begin[i + 1]])


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, __row, n, s1, s2, ranked, more: set size, a 128-bit signature of the set, and the tokens that can stand in
    its prefix. Tokens are ordered by rarity where their hash is below a share of the range, and after those by hash
    alone; any order that all documents share finds all pairs, and this one needs only that share counted. `ranked`
    are the tokens of the share, `more` those of smallest hash beyond it that a prefix still needs."""
    top = np.uint64(min(1.0, 2 * (100 - percent) / 100) * ((1 << 64) - 1025))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = BytesHasher()
        for b in batches:
            n, s1, s2, ranked, more = [], [], [], [], []
            for s in each_set(b.column("text"), size, hasher):
                r = int(np.searchsorted(s, top))
                prefix = len(s) - least_common(len(s), percent) + 1 if len(s) else 0
                n.append(len(s))
                s1.append(int(np.sum(mix(s), dtype=np.uint64).view(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(7))).view(np.int64)) if len(s) else 0)
                ranked.append(s[:r].view(np.int64))
                more.append(s[r:max(r, prefix)].view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in xs])]), pa.int32()),
                                              pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64))) for xs in (ranked, more)]
            yield pa.record_batch([b.column("doc_id"), b.column("__row"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), *lists],
                                  ["doc_id", "__row", "n", "s1", "s2", "ranked", "more"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_hash().alias("__row"), "text").mapInArrow(
        run, f"doc_id {id_type}, __row long, n long, s1 long, s2 long, ranked array<long>, more array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """uid, gid, members, shingles of the rows of docs that wanted (uid, doc_id, __row, gid, members) names. Only a 64-bit
    key of each is sent, so that the driver holds little; the texts it lets through meet the rest by shuffle."""
    keyed = docs.select("doc_id", row_hash().alias("__row"), "text")
    if wanted.count() <= SMALL:
        key = F.xxhash64("doc_id", "__row")
        keyed = keyed.withColumn("__key", key).join(F.broadcast(wanted.select(key.alias("__key"))), "__key", "left_semi").drop("__key")
    rows = keyed.join(wanted.hint("merge"), same_row(keyed, wanted)).select("uid", "gid", "members", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = BytesHasher()
        for b in batches:
            sets = [s.view(np.int64) for s in each_set(b.column("text"), size, hasher)]
            yield pa.record_batch([*(b.column(c) for c in ("uid", "gid", "members")), pa.array(sets, pa.list_(pa.int64()))], ["uid", "gid", "members", "shingles"])

    return materialize(rows.mapInArrow(run, "uid long, gid long, members long, shingles array<long>"))


def heads_of(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(uid, gid, n, shared) of the members that can link at all, and (gid, head, alive, most) of their groups. `shared`
    counts a member's tokens that another member has too: with fewer than percent of its set it links with nothing. The
    head of a group is the member nearest to what most of the group holds, such as the text that the others were made
    from, so that links are found around it instead of among all."""
    spread = sets.select("uid", "gid", "members", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    twice = spread.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token")
    alive = (spread.join(twice, "token").groupBy("uid", "gid", "n").agg(F.count("*").alias("shared"))
             .filter(F.col("shared") * 100 >= F.col("n") * percent))
    crowd = spread.filter("members > 2")
    common = crowd.groupBy("gid", "token", "members").agg(F.count("*").alias("held")).filter(F.col("held") * 2 > F.col("members")).select("gid", "token")
    hits = crowd.join(common, ["gid", "token"]).groupBy("uid").agg(F.count("*").alias("hits"))
    alive = materialize(alive.join(hits, "uid", "left"))
    nearest = F.struct(F.coalesce(2 * F.col("hits") - F.col("n"), F.lit(-1 << 40)), -F.col("uid"))
    return alive, materialize(alive.groupBy("gid").agg(F.max_by("uid", nearest).alias("head"), F.count("*").alias("alive"), F.max("shared").alias("most")))


def gathered(lists: DataFrame) -> DataFrame:
    """(h, gid): crowds of groups, such that every list (token, band) of lists (token, band, gid, head, alive) is whole in
    one of them. Lists of near copies overlap much, and a crowd for each would have the same pairs again and again. So in
    each round a list names its largest group, of equal ones that in most lists; a group named by half of its lists becomes
    a hub, its head is h, and lists that are whole in a crowd are done, whoever they named."""
    left, crowds = lists.select("token", "band", "gid", "head", "alive"), None
    for last in [False] * (ROUNDS - 1) + [True]:
        found_in = left.groupBy("gid").agg(F.count("*").alias("lists"))
        choice = F.max(F.struct("alive", "lists", -F.col("gid"), "head")).alias("best")
        named = materialize(left.join(found_in, "gid").groupBy("token", "band").agg(choice, F.count("*").alias("groups"))
                            .select("token", "band", "groups", F.col("best.lists").alias("lists"), F.col("best.head").alias("h")))
        hubs = named.groupBy("h", "lists").agg(F.count("*").alias("wins")).filter(F.lit(last) | (F.col("wins") * 2 >= F.col("lists"))).select("h")
        new = left.join(named.join(hubs, "h").select("token", "band", "h"), ["token", "band"]).select("h", "gid")
        crowds = materialize((new if crowds is None else crowds.unionAll(new)).distinct())
        within = left.join(crowds, "gid").groupBy("token", "band", "h").agg(F.count("*").alias("groups"))
        done = within.join(named.select("token", "band", "groups"), ["token", "band", "groups"]).select("token", "band").distinct()
        left = materialize(left.join(done, ["token", "band"], "left_anti"))
        if not left.limit(1).count():
            return crowds
    return crowds


def differences(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """crowd with added (tokens of x that h lacks) and lost (tokens of h that x lacks)."""
    xs, hs = sets.select(F.col("uid").alias("x"), F.col("shingles").alias("sx")), sets.select(F.col("uid").alias("h"), F.col("shingles").alias("sh"))
    return materialize(crowd.join(xs, "x").join(hs, "h").select(*crowd.columns, F.array_except("sx", "sh").alias("added"), F.array_except("sh", "sx").alias("lost")))


def by_difference(crowd: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of crowd (h, x, n, shared, c: members x of size n that meet around one member h, itself among them; their component):
    links (a, b) with the member nearest to the centre, and the pairs (a, b) of members of different components that may
    link.

    The centre M of a crowd are the tokens that more than half of it has: for near copies about the text they were made
    from, whether that is still there or not. D(x), what x has beyond M (added) and lacks of it (lost), is small for near
    copies. A link means |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)| <= (n + m) r, r = (100 - percent) / (100 + percent). Let
    z have the least |D| - n r of all: whoever could link without a difference in common links with z then. So two that
    link are both linked with z, thus of one component, or have a difference in common; and x shares at least k = |D(x)| -
    n (100 - percent) / percent with whom it links, so one of the |D(x)| - k + 1 first of its differences in an order that
    all share. Added tokens come first and rare ones among them. Two with only lost tokens in common share no more than
    either shares with M, which bounds the size of the second. Near copies of one text differ from it at places of their
    own, so few meet, however many there are."""
    diff = differences(crowd, sets)
    signed = diff.select("h", "x", F.explode("added").alias("token"), F.lit(False).alias("inside")).unionAll(diff.select("h", "x", F.explode("lost").alias("token"), F.lit(True).alias("inside")))
    size = crowd.groupBy("h").agg(F.count("*").alias("members"))
    counts = materialize(signed.groupBy("h", "token", "inside").agg(F.count("*").alias("times")).join(size, "h").filter("times > 1 OR times * 2 > members"))
    most = counts.filter("times * 2 > members")
    # how the centre differs from h: what most have beyond it, and what most lack of it
    turned = most.groupBy("h").agg(F.collect_list(F.when(~F.col("inside"), F.col("token"))).alias("more"), F.collect_list(F.when(F.col("inside"), F.col("token"))).alias("less"))
    none = F.array().cast("array<bigint>")
    diff = diff.join(turned, "h", "left").withColumns({"more": F.coalesce("more", none), "less": F.coalesce("less", none)})
    diff = diff.select("h", "x", "n", "shared", "c", F.concat(F.array_except("added", "more"), F.array_except("less", "lost")).alias("added"),
                       F.concat(F.array_except("lost", "less"), F.array_except("more", "added")).alias("lost"))
    d = F.size("added") + F.size("lost")
    diff = materialize(diff.withColumn("held", F.col("n") - F.size("added")))
    near = diff.groupBy("h").agg(F.min(F.struct(d * (100 + percent) - F.col("n") * (100 - percent), "x")).alias("z")).select("h", F.col("z.x").alias("z"))
    near = diff.join(near.withColumnRenamed("z", "x"), ["h", "x"]).select("h", F.col("x").alias("z"), F.col("n").alias("nz"), F.concat("added", "lost").alias("dz"))
    apart = d + F.size("dz") - 2 * F.size(F.array_intersect(F.concat("added", "lost"), "dz"))
    diff = materialize(diff.join(near, "h").withColumn("star", (F.col("x") == F.col("z")) | (apart * (100 + percent) <= (F.col("n") + F.col("nz")) * (100 - percent))).drop("nz", "dz"))
    stars = diff.filter("star AND x <> z").select(F.least("z", "x").alias("a"), F.greatest("z", "x").alias("b")).distinct()

    scalars = ["h", "x", "n", "shared", "c", "held", "star", (F.size("added") + F.size("lost")).alias("d")]
    each = diff.select(*scalars, F.explode("added").alias("token"), F.lit(0).alias("gone")).unionAll(diff.select(*scalars, F.explode("lost").alias("token"), F.lit(1).alias("gone")))
    # who differs from the centre at a token that most have beyond h or lack of it are those that do not differ from h there
    times = counts.select("h", "token", F.expr("IF(times * 2 > members, members - times, times)").alias("times")).filter("times > 1")
    own = each.join(times, ["h", "token"]).groupBy("h", "x", "n", "shared", "c", "held", "star", "d").agg(
        F.sum("gone").alias("lost"), F.count("*").alias("able"), F.array_sort(F.collect_list(F.struct("gone", "times", "token"))).alias("tokens"))
    own = own.withColumn("added", F.col("able") - F.col("lost"))
    k = F.when(F.col("star"), 1).otherwise(F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * (100 - percent) / F.lit(percent))))
    own = materialize(own.withColumn("keep", (F.col("able") - k + 1).cast("int")).filter("keep > 0"))
    scalars = ["h", "x", "n", "shared", "c", "held", "star", "d", "lost", "added"]
    prefix = own.select(*scalars, F.explode(F.slice("tokens", 1, F.col("keep"))).alias("t")).select(*scalars, F.col("t.gone").alias("gone"), F.col("t.token").alias("token"))
    # sizes by buckets of a sixteenth of the range that links allow; -1 for added tokens, whatever the size
    step = math.log(100 / percent) / 16 if percent < 100 else 1e-9
    bucket = lambda n: F.floor(F.ln(n) / step)
    low, high = F.ceil(F.col("n") * percent / F.lit(100)), F.floor(F.col("held") * (100 + percent) / F.lit(percent)) - F.col("n")
    spans = F.when(F.col("gone") == 0, F.array(F.lit(-1).cast("long"))).when(high >= low, F.sequence(bucket(low), bucket(high)))
    first = prefix.filter(~F.col("star")).select("*", F.explode(spans).alias("size")).drop("star", "held")
    then = prefix.withColumn("size", F.when(F.col("gone") == 0, -1).otherwise(bucket(F.col("n"))).cast("long")).drop("star", "held", "gone")
    then = then.select("h", "token", "size", *[F.col(c).alias(f"{c}2") for c in ("x", "n", "shared", "c", "d", "lost", "added")])
    most = F.least("lost", "lost2") + F.when(F.col("gone") == 0, F.least("added", "added2")).otherwise(0)
    able = ((F.col("x") != F.col("x2")) & (F.col("c") != F.col("c2")) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
            & (F.least("shared", "shared2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
            & ((F.col("d") + F.col("d2") - 2 * most) * (100 + percent) <= (F.col("n") + F.col("n2")) * (100 - percent)))
    # the differences themselves join once a pair; beside each of their own tokens they would take their square
    met = first.join(then, ["h", "token", "size"]).filter(able).select("h", F.least("x", "x2").alias("a"), F.greatest("x", "x2").alias("b")).distinct()
    side = lambda name, i: own.select("h", F.col("x").alias(name), F.col("n").alias(f"n{i}"), F.col("d").alias(f"d{i}"), F.transform("tokens", lambda t: t["token"]).alias(f"own{i}"))
    both = met.join(side("a", 1), ["h", "a"]).join(side("b", 2), ["h", "b"])
    apart = F.col("d1") + F.col("d2") - 2 * F.size(F.array_intersect("own1", "own2"))
    near = both.filter(apart * (100 + percent) <= (F.col("n1") + F.col("n2")) * (100 - percent)).select("a", "b").distinct()
    return stars, near


@counted_broadcasts
def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """uid, doc_id, __row, n_shingles, label, component_id of every row of docs.

    A row's set: distinct shingles of `size` words; with fewer words the whole sequence as one; without words or text,
    empty and linked with nothing. Rows link when 100 * intersection >= percent * union. component_id is the smallest
    doc_id reachable by links (NULL only if all are), label the same for all rows of a component.

    1. Equal sets are one node. 2. A node's prefix are its first n - ceil(percent n / 100) + 1 tokens; tokens of a single
    document come first and can meet nothing, so a node with only such is alone. 3. Nodes of equal size and prefix are a
    group. 4. Groups that share a prefix token pass bounds on size and on the position of that token. 5. Members are
    verified against the first of their group, and first ones of paired groups against each other; whatever is not yet
    in one component after that is expanded to member pairs and verified, in a list of more than LONG members only where
    differences from one of them allow it. All links are thereby known as far as components go, without all pairs within
    a group of copies.

    Only doc_id and text are read, so other columns may have any name. A very long text is one set, sketched whole. Ties at
    the border count as links (the comparison is of whole numbers). Rows that repeat are nodes of equal sets. Sets are compared by 64-bit hashes of their shingles. Empty table: no rows.
    """
    rows = materialize(sketches(docs, size, percent).withColumn("uid", F.monotonically_increasing_id()))
    some = rows.filter("n > 0")
    nodes = materialize(some.groupBy("n", "s1", "s2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least")))

    # rarity over all documents; one exchange serves the counts and the rows that get them
    tokens = some.select("uid", F.explode("ranked").alias("token")).repartition("token")
    seen = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    known = tokens.join(seen, "token").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("known"))
    rows_n = some.select("uid", "doc_id", "__row", "n", F.size("ranked").alias("r"), "more").join(nodes.select(F.col("node").alias("uid")), "uid")
    none = F.array().cast("array<struct<df:bigint,token:bigint>>")
    ranked = rows_n.join(known, "uid", "left").withColumn("known", F.coalesce("known", none))
    ranked = ranked.withColumn("u", F.col("r") - F.size("known"))  # tokens that no other document has
    take = (F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1 - F.col("u")).cast("int")
    prefix = F.concat(F.transform(F.slice("known", 1, F.col("take")), lambda x: x["token"]), F.slice("more", 1, F.greatest(F.lit(0), F.col("take") - F.size("known"))))
    able = materialize(ranked.withColumn("take", take).filter("take > 0").select("uid", "doc_id", "__row", "n", "u", prefix.alias("prefix")))

    groups = materialize(able.groupBy("n", "u", "prefix").agg(F.min("uid").alias("gid"), F.count("*").alias("members")))
    # lists of groups by prefix token and band of sizes; sets that link are in one band or in two next to each other, so
    # each group is listed in its own band and as a guest in the next
    step = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    spots = groups.select("gid", "n", F.posexplode("prefix").alias("at", "token"), "u").select("token", "gid", "n", (F.col("u") + F.col("at")).alias("at"), F.floor(F.ln("n") / step).alias("band"))
    lists = spots.select("token", "gid", "n", "at", F.inline(F.array(*[F.struct((F.col("band") + k).alias("band"), F.lit(k).alias("guest")) for k in (0, 1)])))
    met = lists.groupBy("token", "band").agg(F.count("*").alias("k")).filter("k > 1").select("token", "band")
    met = lists.join(met, ["token", "band"], "left_semi").select("gid").distinct().withColumn("met", F.lit(True))
    member = able.join(groups, ["n", "u", "prefix"]).select("uid", "doc_id", "__row", "gid", "members")
    member = member.join(met, "gid", "left").filter("members > 1 or met").select("uid", "doc_id", "__row", "gid", "members")
    sets = full_sets(docs, materialize(member), size)
    alive, heads = heads_of(sets, percent)

    def verified(ab: DataFrame) -> DataFrame:
        with_b = ab.join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b")
        both = with_b.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.filter(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b"))

    listed = materialize(lists.join(heads, "gid"))
    other = lambda df: df.select("token", "band", *[F.col(c).alias(f"{c}2") for c in df.columns if c not in ("token", "band")])
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"), F.col("most"), F.col("most2"))
    may = ((F.col("gid") != F.col("gid2")) & (F.col("guest") + F.col("guest2") < 2) & (F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent)
           & (room * (100 + percent) >= (F.col("n") + F.col("n2")) * percent))

    # links are looked for around heads first: of each group for its members, of the largest group of a list for the
    # other heads, and of the largest of these for all members
    hub = listed.groupBy("token", "band").agg(F.max_by(F.struct(*[c for c in listed.columns if c not in ("token", "band")]), F.struct("alive", -F.col("gid"))).alias("hub")).select("token", "band", "hub.*")
    around = listed.join(other(hub), ["token", "band"]).filter(may).select("gid", "head", "gid2", "head2", "alive2").distinct()
    largest = around.groupBy("gid").agg(F.max_by("head2", F.struct("alive2", -F.col("gid2"))).alias("x"))
    own = alive.join(heads, "gid").select(F.col("head").alias("x"), F.col("uid").alias("y"))
    tried = own.unionAll(around.select("head", "head2")).unionAll(alive.join(largest, "gid").select("x", F.col("uid").alias("y")))
    tried = materialize(tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct())
    first = verified(tried)
    part = components(first)
    placed = alive.join(part.withColumnRenamed("node", "uid"), "uid", "left").select("uid", "gid", "n", "shared", F.coalesce("component", "uid").alias("c"))
    placed = materialize(placed)
    kinds = placed.groupBy("gid", "c", "n").agg(F.max("shared").alias("most"))

    # what is left can only link across components: in a short list, those outside its commonest component with all others
    seen_in = listed.drop("most").join(kinds.drop("n"), "gid")
    counts = seen_in.groupBy("token", "band", "c").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("token", "band").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("token", "band", "main")
    mixed = mixed.join(listed.groupBy("token", "band").agg(F.sum("alive").alias("held")), ["token", "band"])
    mixed = materialize(mixed)
    short = materialize(seen_in.join(mixed.filter(F.col("held") <= LONG).drop("held"), ["token", "band"]).drop("head", "alive"))
    across = short.filter("c <> main").join(other(short), ["token", "band"]).filter(may & (F.col("c") != F.col("c2")))
    across = across.select(F.col("gid").alias("a"), F.col("c").alias("ca"), F.col("gid2").alias("b"), F.col("c2").alias("cb"))
    few = kinds.join(heads.filter(F.col("alive") <= LONG).select("gid"), "gid")  # members of a larger group meet in their long list
    inside = few.select(F.col("gid").alias("a"), "n", "most", F.col("c").alias("ca")).join(few.select(F.col("gid").alias("a"), F.col("most").alias("most2"), F.col("c").alias("cb")), "a")
    inside = inside.filter((F.col("ca") < F.col("cb")) & (F.least("most", "most2") * (100 + percent) >= F.col("n") * 2 * percent)).select("a", "ca", "cb")
    left = across.unionByName(inside.withColumn("b", F.col("a"))).distinct()
    side = lambda g, c, i: placed.select(F.col("gid").alias(g), F.col("c").alias(c), F.col("uid").alias(f"u{i}"), F.col("n").alias(f"n{i}"), F.col("shared").alias(f"s{i}"))
    rest = left.join(side("a", "ca", 1), ["a", "ca"]).join(side("b", "cb", 2), ["b", "cb"])
    rest = rest.filter((F.least("s1", "s2") * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent))
    rest = rest.select(F.least("u1", "u2").alias("a"), F.greatest("u1", "u2").alias("b"))
    # in long lists, by differences from the hubs they meet around
    crowd = gathered(materialize(listed.join(mixed.filter(F.col("held") > LONG), ["token", "band"])))
    crowd = materialize(crowd.join(placed.withColumnRenamed("uid", "x"), "gid").select("h", "x", "n", "shared", "c"))
    stars, near = by_difference(crowd, sets, percent)
    rest = rest.unionByName(near).distinct().join(tried, ["a", "b"], "left_anti")
    second = verified(rest).unionByName(stars)
    # what the second links join are components of the first
    of = lambda name, c: placed.select(F.col("uid").alias(name), F.col("c").alias(c))
    bridges = second.join(of("a", "ca"), "a").join(of("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = components(bridges).select(F.col("node").alias("c"), "component")
    whole = placed.join(merged, "c", "left").select(F.col("uid").alias("node"), F.coalesce("component", "c").alias("component"))

    # a component's smallest doc_id by its nodes; rows then join their node, of which one may hold very many
    named = nodes.join(whole, "node", "left").withColumn("label", F.coalesce("component", "node"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(smallest, "label").select("n", "s1", "s2", "label", "component_id"))
    linked = some.select("uid", "doc_id", "__row", "n", "s1", "s2").join(named.hint("merge"), ["n", "s1", "s2"]).select(
        "uid", "doc_id", "__row", F.col("n").alias("n_shingles"), "label", "component_id")
    alone = rows.filter("n = 0").select("uid", "doc_id", "__row", F.col("n").alias("n_shingles"), F.col("uid").alias("label"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) as s
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as i from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * i >= 90 * (p.n + q.n - i)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join both_ways b on b.x = r.y)
select d.doc_id, coalesce(z.n, 0) as n_shingles, min(r.y) as component_id
from documents d left join sizes z on z.doc_id = d.doc_id join reach r on r.x = d.doc_id
group by all
"""


@counted_broadcasts
def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near duplicates (five words, similarity 0.8 or more): the one of smallest
    doc_id (NULL last), with its columns, whatever the names of those beside doc_id and text. Rows without words all stay,
    repeated ones too; of repeated rows with words one stays."""
    configure_text(spark)
    found = materialize(near_duplicates(docs.select("doc_id", "text")))
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("uid"))
    keep = materialize(found.join(best.select("uid"), "uid").select("doc_id", "__row", "n_shingles")).hint("merge")
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, row_hash())
    repeated = found.filter("n_shingles > 0").groupBy("doc_id", "__row").count().filter("count > 1").limit(1).count()
    if not repeated:
        return keyed.join(keep, same_row(keyed, keep, row), "left_semi").select(columns_of(docs))
    worded, empty = keep.filter("n_shingles > 0"), keep.filter("n_shingles = 0")
    kept = keyed.join(worded, same_row(keyed, worded, row), "left_semi").dropDuplicates(["doc_id", row])
    return kept.unionByName(keyed.join(empty, same_row(keyed, empty, row), "left_semi")).select(columns_of(docs))
