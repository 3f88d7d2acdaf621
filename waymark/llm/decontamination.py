"""Benchmark decontamination: which documents hold passages of benchmark items, by a prefix-filtered join of shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, configure_text, documents, free_name, materialize, row_hash, same_row

#: Words of a shingle; shorter windows are one shingle.
SHINGLE = 3
#: Most shingles or windows of the benchmark that are sent to every task; beyond that the joins shuffle.
SMALL = 1_000_000
#: Fixed value: what separates words after A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, BREAK), "")


def joined(words: Column, first: Column, size: int) -> Column:
    """`size` words from index `first` (0-based) on as one string; words hold no space."""
    return F.concat_ws(" ", *[F.get(words, first + j) for j in range(size)])


def item_windows(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(item, window) and (window, n, offset, shingle) of every distinct window. A window is `size` consecutive words of
    an item, or all of them if there are fewer, but not none; it is named by its words. The shingles listed cover the
    window without needless overlap, so a window occurs where all of them do."""
    words = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(size))
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.slice("words", i, n))).alias("w"))
    cut = materialize(cut.select("item", F.array_join("w", " ").alias("window"), "w").distinct())
    length = F.least(F.size("w"), F.lit(SHINGLE))
    offsets = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(SHINGLE)), lambda o: F.least(o, F.size("w") - length)))
    distinct = cut.select("window", "w").distinct()
    at = distinct.select("window", F.size("w").alias("n"), "w", length.alias("length"), F.explode(offsets).alias("offset"))
    return cut.select("item", "window"), materialize(at.select("window", "n", "length", "offset", F.array_join(F.slice("w", F.col("offset") + 1, F.col("length")), " ").alias("shingle")))


def sized(df: DataFrame) -> DataFrame:
    """Sent to every task if it has few rows, else joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def find_overlaps(docs: DataFrame, items: DataFrame, size: int = 10, unnamed: bool = False) -> DataFrame:
    """doc_id, __row, n_words, n_hit, n_items, items (ids as strings, sorted, comma-joined) for each row of docs.

    A word of a document is hit if it lies in an occurrence of any window of any item. Shingles of documents meet the
    shingles of windows once; what meets is kept with its place and counted over all documents. Each window is then
    looked for only where its rarest shingle stands (containment must keep every shingle, so a prefix of one is enough),
    where the text has room for it before and after, and is verified by its other shingles at their places.

    NULL texts have no words; an item without words has no window and an empty benchmark hits nothing. Items of equal
    words count each. Rows that repeat doc_id and text have equal results; a NULL doc_id is an id. Items of NULL item_id
    are left out, or with `unnamed` hit like others and count as one item that the list does not name. Only doc_id and text
    are read, so other columns may have any name. A very long text is one row whose shingles that some window holds are
    kept; its words are held while it is cut. Empty docs give no rows.
    """
    keyed = docs.select("doc_id", row_hash().alias("__row"), words_of(F.col("text")).alias("words"))
    if not unnamed:
        items = items.filter(F.col("item_id").isNotNull())
    of_item, of_window = item_windows(items, size)
    wanted = of_window.select("shingle").distinct()
    sizes = [r["length"] for r in of_window.select("length").distinct().collect()]  # at most SHINGLE numbers
    n = F.size("words")
    none = F.array().cast("array<struct<at:int,shingle:string>>")

    def all_of(k: int) -> Column:
        spot = lambda i: F.struct(i.alias("at"), joined(F.col("words"), i, k).alias("shingle"))
        return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), spot)).otherwise(none)

    spots = F.concat(none, *map(all_of, sorted(sizes)))
    counted = keyed.select("doc_id", "__row", n.cast("long").alias("n_words"), spots.alias("spots"))
    # one pass over the texts: rows keep only spots that some window could use, and their word count
    found = materialize(counted.select("doc_id", "__row", "n_words", F.inline_outer("spots")).join(sized(wanted.withColumn("wanted", F.lit(True))), "shingle", "left")
                        .filter(F.col("wanted") | (F.coalesce(F.col("at"), F.lit(0)) == 0)).select("doc_id", "__row", "n_words", "at", F.when(F.col("wanted"), F.col("shingle")).alias("shingle")))
    spots = found.filter(F.col("shingle").isNotNull()).distinct()
    rarity = spots.groupBy("shingle").agg(F.count("*").alias("seen"))
    order = Window.partitionBy("window").orderBy("seen", "offset")
    rarest = (of_window.join(rarity, "shingle").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
              .select("window", "n", "shingle", "offset"))
    starts = (spots.join(sized(rarest), "shingle").withColumn("start", F.col("at") - F.col("offset"))
              .filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words"))).select("doc_id", "__row", "window", "n", "start"))
    parts = starts.join(sized(of_window.select("window", "offset", "shingle")), "window").withColumn("at", F.col("start") + F.col("offset"))
    there = spots.select(F.col("doc_id").alias("d"), F.col("__row").alias("r"), F.col("at").alias("a"), F.col("shingle").alias("s"))
    met = parts.join(there, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__row") == F.col("r")) & (F.col("at") == F.col("a")) & (F.col("shingle") == F.col("s")))
    needed = of_window.groupBy("window").agg(F.count("*").alias("needed"))
    hits = (met.groupBy("doc_id", "__row", "window", "n", "start").agg(F.count("*").alias("parts"))
            .join(sized(needed), "window").filter("parts = needed").select("doc_id", "__row", "window", "n", "start"))
    hits = materialize(hits)

    end = F.col("start") + F.col("n")
    earlier = Window.partitionBy("doc_id", "__row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0))))
    covered = hits.select("doc_id", "__row", "start", "n").distinct().withColumn("fresh", fresh).groupBy("doc_id", "__row").agg(F.sum("fresh").alias("hit"))
    named = (hits.select("doc_id", "__row", "window").distinct().join(sized(of_item), "window").select("doc_id", "__row", "item").distinct()
             .groupBy("doc_id", "__row").agg(F.count("*").alias("item_count"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("item_list")))
    both = covered.join(named, same_row(covered, named)).select(covered["doc_id"], covered["__row"], "hit", "item_count", "item_list")
    # every row of docs, with its word count
    rows = docs.select("doc_id", row_hash().alias("__row"))
    lengths = found.filter(F.coalesce(F.col("at"), F.lit(0)) == 0).select("doc_id", "__row", "n_words").distinct()
    rows = rows.join(lengths, same_row(rows, lengths)).select(rows["doc_id"], rows["__row"], "n_words")
    return rows.join(both, same_row(rows, both), "left").select(
        rows["doc_id"], rows["__row"], "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_count", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_list", F.lit("")).alias("items"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(documents(spark, sf_dir).select("doc_id", "text"), _benchmark(spark, sf_dir), unnamed=True)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", "n_items",
                        F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with words as (
  select kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from (select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from benchmark)),
windows as (
  select distinct id, len(part) as n, array_to_string(part, ' ') as win
  from (select id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + least(len(w), 10) - 1))) as part
        from words where kind = 'i' and len(w) > 0)),
sizes as (select distinct n from windows),
spots as (
  select id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as win
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as p from words, sizes where kind = 'd' and len(w) >= n)),
hits as (select s.id, s.p, s.n, w.id as item from spots s join windows w on s.win = w.win),
covered as (select id, count(distinct x) as n_hit from (select id, unnest(range(p, p + n)) as x from hits) group by id),
items as (select id, count(*) as n_items, string_agg(item, ',' order by item) as list from (select distinct id, cast(item as varchar) as item from hits) group by id)
select d.id as doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.list, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from words d left join covered c on c.id = d.id left join items i on i.id = d.id
where d.kind = 'd'
"""


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs in which no word of a benchmark passage is hit, with their columns; other columns than doc_id and text may have
    any name. NULL and empty texts stay, rows that repeat share their fate, empty docs give no rows."""
    configure_text(spark)
    row = free_name(docs, "__row")
    keyed = docs.withColumn(row, row_hash())
    bad = find_overlaps(docs.select("doc_id", "text"), _benchmark(spark, sf_dir), unnamed=True).filter("n_hit > 0").select("doc_id", "__row").distinct()
    return keyed.join(bad, same_row(keyed, bad, row), "left_anti").select(columns_of(docs))
