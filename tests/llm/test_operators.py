"""Each operator against a plain restatement, on rows that hold the awkward cases."""

import hashlib
import math
import random
import sys

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def llm(spark):
    from waymark.llm.common import configure_text
    return configure_text(spark)


def made(seed=3, n=60):
    """Texts with copies, near copies, shared passages and lines, very short and very long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "Ber", "co", "dé", "ü", "Fo", "x1"]) for _ in range(rng.randint(1, 3)))
    text = lambda k: " ".join(word() + rng.choice(["", ".", ",", "\n", "  ", "\t"]) for _ in range(k))
    shared, line = text(40), "Shared  Line of all"
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not rows:
            t = text(rng.randint(1, 120))
        elif kind == 1:
            t = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            w = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 3:
            t = text(20) + " " + shared + " " + text(10)
        elif kind == 4:
            t = f"{line}\n" + text(30) + "\n  shared  line OF all".replace("OF", "of") + "\n" + f" {line.lower()}\t"
        else:
            t = rng.choice([None, "", " ", "a", "A b", "\n", "x" * 300, "ab " * 90, "é" * 120])
        rows.append((i, t))
    rows.append((n, text(30_000)))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(df, want):
    assert rows_of(df) == sorted(want, key=str)


def extra(spark, rows):
    """The rows with columns whose names clash with inner ones."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "lines", "n", "label", "key", "tag", "start", "end", "gram", "words", "size", "shard", "window", "uid", "base", "word", "kind", "ranges"):
        df = df.withColumn(name, F.lit("z"))
    return df


# --- 1 decontamination ------------------------------------------------------------------------------

@pytest.mark.parametrize("small", [1_000_000, 1])
def test_decontamination(llm, monkeypatch, small):
    from waymark.llm import decontamination
    from waymark.llm.decontamination import find_overlaps
    monkeypatch.setattr(decontamination, "SMALL", small)
    docs = made()
    w = brute.bench_words(docs[3][1])
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[20:26]).upper() + "!"), (10, w[3]), (11, None), (12, "..."), (13, "No Such Words here at all in any of the given texts"),
             (14, " ".join(w[5:30])), (None, w[4]), (15, "a")]
    out = find_overlaps(extra(llm, docs), llm.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1)))
    got = out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256), F.col("n_hit") > 0)
    same(got, brute.decontamination(docs, [x for x in items if x[0] is not None]))


def test_decontamination_edges(llm):
    from waymark.llm.decontamination import find_overlaps
    items = llm.createDataFrame([(1, "one two")], "item_id long, text string")
    docs = llm.createDataFrame([(7, "one two"), (7, "one two"), (7, "two one two one two"), (None, "One TWO three")], DOCS)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in find_overlaps(docs, items).collect()) == [(0, 3, 2), (7, 2, 2), (7, 2, 2), (7, 5, 4)]
    assert find_overlaps(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in find_overlaps(docs, items.limit(0)).collect()] == [0] * 4


def test_copies_without_words_stay_beside_repeated_rows(llm):
    from waymark.llm.jaccard_groups import keep_one_of_group
    docs = [(1, None), (1, None), (2, ""), (2, ""), (3, "a b c d e f"), (3, "a b c d e f")]
    got = sorted(r.doc_id for r in keep_one_of_group(llm, llm.createDataFrame(docs, DOCS), "").collect())
    assert got == [1, 1, 2, 2, 3]


def test_items_without_id_contaminate(llm, folder):
    from waymark.llm.decontamination import drop_contaminated, op1_decontamination
    docs = llm.createDataFrame([(1, "one two three"), (2, "four five"), (3, "six")], DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    llm.createDataFrame([(None, "two three"), (None, "one"), (5, "five"), (6, "one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op1_decontamination(llm, folder).collect()}
    assert got == {1: (3, 2, brute.sha("6"), True), 2: (1, 1, brute.sha("5"), True), 3: (0, 0, brute.sha(""), False)}
    assert [r.doc_id for r in drop_contaminated(llm, docs, folder).collect()] == [3]


def test_decontamination_plan_is_native(llm, capsys):
    from waymark.llm.decontamination import op1_decontamination
    op1_decontamination(llm, SF).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# --- 2 secrets --------------------------------------------------------------------------------------

def test_secrets(llm):
    from waymark.llm.secret_links import KINDS, scan_secrets
    key = "AKIA" + "Q" * 16
    docs = [(1, None), (2, ""), (3, f"é {key} and Password: 'hunter22' x"), (4, "password: token: abcdef"), (5, "token=abc"), (6, "0123456789abcdef01234567 g"),
            (7, "AKIASHORT"), (8, "ſecret=abcdefgh"), (9, "api-key=abcdefgh apikey = abcdefgh API_KEY:\"abcdef1"), (9, "f" * 5000), (None, "passwd=abcdefg")]
    out = scan_secrets(extra(llm, docs))
    got = sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out.collect())
    want = []
    for _, t in docs:
        s = brute.secrets(t or "")
        want.append((*(sum(k == j for _, k, _ in s) for j in range(3)), brute.sha(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in s))))
    assert got == sorted(want)
    assert scan_secrets(llm.createDataFrame([], DOCS)).count() == 0


def test_weak_parts_need_company(llm):
    from waymark.llm.secret_links import scan_secrets
    key, bare = "AKIA" + "Q" * 16, "w9Jk3LmQ7xZp2VbN8sRt"
    docs = [(1, f"{key}\n{bare}\n"), (2, f"{bare}\n"), (3, f"{key}\n\n{bare}\n"), (4, f"user=alice host=db.example.org\n{bare}"), (5, f"user=alice {bare}"),
            (6, f"{key} {'y ' * 400}{bare}"), (7, "user=alice host=db.example.org")]
    spans = {r.doc_id: [x.split(":")[0] for x in r.spans.split(",")] if r.spans else [] for r in scan_secrets(llm.createDataFrame(docs, DOCS)).collect()}
    assert spans == {1: ["access", "bare"], 2: [], 3: ["access"], 4: ["user", "endpoint", "bare"], 5: ["bare"], 6: ["access"], 7: []}


# --- 3 top-k ----------------------------------------------------------------------------------------

def test_top_k(llm):
    from waymark.llm.block_topk import top_k
    rng = random.Random(1)
    vecs = [(i, [rng.randint(-3, 3) for _ in range(4)]) for i in range(300)] + [(7, None), (None, [1, 1, 1, 1]), (400, [1, None, 1, 1]), (500, []), (600, [1 << 40] * 4), (620, [1 << 20] * 4)]
    vecs += [(620, [1 << 20] * 4), (640, [5, 5])]
    df = llm.createDataFrame(vecs, "vec_id long, terms array<long>")
    got = rows_of(top_k(df, F.col("vec_id") % 20 == 0, k=7, block=16, part=64, group=5))
    good = {i: v for i, v in vecs if i is not None and v and None not in v}
    want = []
    for q, v in good.items():
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, u, strict=True)), i) for i, u in good.items() if i != q and len(u) == len(v)))[:7]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want, key=str)
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_blocks_are_pruned():
    from waymark.llm.block_topk import best_of_part
    rng = np.random.default_rng(0)
    matrix = np.repeat(np.array([[9, 0], [0, 9], [1, 1]]), 32, axis=0) + rng.integers(0, 2, (96, 2))
    high, low = np.maximum.reduceat(matrix, [0, 32, 64]), np.minimum.reduceat(matrix, [0, 32, 64])
    *_, scored = best_of_part(np.arange(96), matrix, high, low, np.array([-1]), np.array([[5, 0]]), 4, 32)
    assert scored == 1


# --- 4 Jaccard --------------------------------------------------------------------------------------

@pytest.mark.parametrize("size,percent,long,small", [(3, 90, 32, 500_000), (3, 90, 1, 1), (5, 80, 1, 500_000), (5, 80, 8, 1), (2, 70, 2, 500_000)])
def test_jaccard(llm, monkeypatch, size, percent, long, small):
    from waymark.llm import jaccard_groups
    from waymark.llm.jaccard_groups import near_duplicates
    monkeypatch.setattr(jaccard_groups, "LONG", long)
    monkeypatch.setattr(jaccard_groups, "SMALL", small)
    docs = made(5, 120)
    rng = random.Random(2)
    long_ = [f"w{i}" for i in range(150)]
    for i in range(200, 240):  # near copies that link in chains
        w = list(long_)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    family = [list(long_)]
    for i in range(400, 520):  # of the first, and of one another: words replaced, left out and put in at few places
        w = list(rng.choice(family[-30:]) if i % 3 else long_)
        for _ in range(rng.randint(1, 4)):
            at = rng.choice([rng.randrange(len(w)), 10, len(w) - 1])
            w[at:at + rng.randint(0, 2)] = [f"y{rng.randrange(4)}"] * rng.randint(0, 1)
        family.append(w)
        docs.append((i, " ".join(w)))
    docs += [(300, "b a"), (5, "B A"), (301, " ".join(f"k{i}" for i in range(11))), (302, " ".join(f"k{i}" for i in range(12)))]
    got = near_duplicates(extra(llm, docs), size, percent).select("doc_id", "n_shingles", "component_id")
    same(got, brute.jaccard(docs, size, percent))


def test_jaccard_edges(llm):
    from waymark.llm.jaccard_groups import near_duplicates
    docs = llm.createDataFrame([(4, None), (3, None), (9, "a b c"), (9, "a b c"), (8, "A  b\tc"), (None, "a b c"), (None, "q")], DOCS)
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in near_duplicates(docs, 3, 90).collect())
    assert got == [(0, 1, 0), (0, 1, 8), (3, 0, 3), (4, 0, 4), (8, 1, 8), (9, 1, 8), (9, 1, 8)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_jaccard_lists_that_overlap_share_a_crowd(llm):
    from waymark.llm.jaccard_groups import gathered
    rng = random.Random(3)
    held = {0: {1, 2, 3}, 1: {2, 3}, 2: {500, 501}} | {k: {g + 100 * (k % 2) for g in range(100, 160) if rng.random() < 0.4} for k in range(10, 50)}
    held |= {k: {600 + k, 601 + k} for k in range(60, 70)}  # a chain: each round names few of it
    alive = {501: 40, 500: 2}
    rows = [(k, 7, g, -g, alive.get(g, 1)) for k, gs in held.items() for g in gs]
    crowds = {}
    for r in gathered(llm.createDataFrame(rows, "token long, band long, gid long, head long, alive long")).collect():
        assert r.gid not in crowds.setdefault(r.h, set())
        crowds[r.h].add(r.gid)
    assert all(any(gs <= c for c in crowds.values()) for gs in held.values())
    assert crowds[-501] == {500, 501}  # around the largest
    families = [len(c) for c in crowds.values() if max(c) < 300 and min(c) >= 100]
    by_list = {(min(gs), g) for k, gs in held.items() if 10 <= k < 50 for g in gs}  # a hub for each list, as before
    assert 2 * sum(families) < len(by_list)


# --- 5 passages -------------------------------------------------------------------------------------

@pytest.mark.parametrize("crowd,small", [(200_000, 1), (1, 500_000)])
def test_passages(llm, monkeypatch, crowd, small):
    from waymark.llm import suffix_dedup
    monkeypatch.setattr(suffix_dedup, "GROUP_CONTEXTS", crowd)
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    docs = [x for x in made(7, 50) if x[0] < 50] + [(90, "ab" * 400), (91, "=" * 350), (92, "x" * 99), (93, "q" * 100), (94, "q" * 100)]
    got = suffix_dedup.dedup_passages(extra(llm, docs)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    same(got, brute.passages(docs, 100))


def test_passages_edges(llm):
    from waymark.llm.suffix_dedup import dedup_passages
    docs = llm.createDataFrame([(None, "n" * 100), (2, "m" * 100), (2, "m" * 100), (3, "n" * 100), (4, None)], DOCS)
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in dedup_passages(docs).collect())
    assert got == [(0, 100, 100), (2, 100, 0), (2, 100, 0), (3, 100, 0), (4, 0, 0)]
    assert dedup_passages(docs.limit(0)).count() == 0


def test_window_order():
    from waymark.llm.suffix_order import equal_to_previous, window_order
    rng = np.random.default_rng(0)
    for trial in range(60):
        length = (8, 12, 40)[trial % 3]
        alphabet = np.frombuffer((b"ab", b"a", b"abc ", bytes(range(256)))[trial % 4], np.uint8)
        parts = [bytes(rng.choice(alphabet, rng.integers(length, length + 60))) for _ in range(rng.integers(1, 8))]
        parts += parts[:1] * (trial % 2)
        data = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]
        order = window_order(data, starts, ends - length, length)
        found = [data[i:i + length].tobytes() for i in order]
        assert sorted(order.tolist()) == [i for s, e in zip(starts, ends, strict=True) for i in range(s, e - length + 1)]
        assert found == sorted(found)
        assert [a == b for a, b in zip(found[1:], found, strict=False)] == equal_to_previous(data, order, length)[1:].tolist()


# --- 6 encoding -------------------------------------------------------------------------------------

def test_encoding(llm):
    from tokenizers import Tokenizer

    from waymark.llm.bpe import default_vocabulary, encode_decode
    t = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(4)
    bits = ["a", "e", "th", " ", "  ", "\n", "\t", "'s", "'re", "1", "é", "ß", "日", "👍", "\xa0", "　", "\x85", "\x1c", "...", "==", "<|endoftext|>", "<|endo", "tion", "aaaa"]
    texts = [t for _, t in made(9)] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["a" * 3000, "ab" * 999]
    docs = list(enumerate(texts))
    got = {r.doc_id: r for r in encode_decode(extra(llm, docs).withColumn("ids", F.lit(0)), ids=True, decoded=True).collect()}
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        plain = t.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (ids, len(ids), plain)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == brute.sha(plain)
    assert encode_decode(llm.createDataFrame([], DOCS)).count() == 0


# --- 7 quality --------------------------------------------------------------------------------------

def test_quality(llm):
    from waymark.llm.quality import op7_quality
    sf = "/root/testdata/sf0.01"
    got = op7_quality(llm, sf)
    joined = got.join(llm.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == llm.read.parquet(f"{sf}/documents.parquet").count()
    assert (joined.held_out == joined.doc_id.map(lambda d: brute.fold(d, 5) == 0)).all()
    held = joined[joined.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert (held[held.quality == 1].predicted == 1).all()
    assert ((joined.score >= 0.3) == (joined.predicted == 1)).all() and joined.score.between(0, 1).all()


def test_quality_edges(llm):
    from waymark.llm.quality import score, train
    docs = extra(llm, [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (4, "bad $$$ ### $$$ ###"), (None, "x")])
    labels = llm.createDataFrame([(3, 1), (4, 0), (4, 1), (1, None), (None, 1), (99, 5)], "doc_id long, quality int")
    w = train(docs, labels, F.lit(True))
    got = {r.doc_id: r.quality_score for r in score(docs, w).collect()}
    assert got[4] < got[3] and got[1] == got[2]
    assert {r.quality_score for r in score(docs, train(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert score(docs.limit(0), w).count() == 0


# --- 8 lines ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("shard", [200_000, 3])
def test_lines(llm, monkeypatch, shard):
    from waymark.llm import line_dedup
    monkeypatch.setattr(line_dedup, "SHARD_LINES", shard)
    docs = made(11) + [(100 + i, f" boiler \x0b\nown {i}\n\nBOILER") for i in range(9)] + [(120, "ÉTÉ\r\nété")] + [(130 + i, "É") for i in range(10)]
    docs += [(150, "boiler"), (150, "boiler"), (None, "boiler\nq")]
    got = line_dedup.dedup_lines(extra(llm, docs)).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256))
    same(got, brute.lines(docs, 10))
    assert line_dedup.dedup_lines(llm.createDataFrame([], DOCS)).count() == 0


def test_line_index():
    from waymark.llm.line_dedup import LineIndex
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.int64)).view(np.uint64)
    counts = rng.integers(1, 70_000, len(keys))
    index = LineIndex(keys, counts)
    assert sorted(index.numbers(keys).tolist()) == list(range(len(keys)))  # minimal and perfect
    assert (index.probe(keys) == np.minimum(counts, 65535)).all()
    assert (index.probe(keys + np.uint64(1)) > 0).mean() < 0.001
    assert LineIndex(keys[:0], counts[:0]).probe(keys[:3]).tolist() == [0, 0, 0]


# --- 9 language model -------------------------------------------------------------------------------

@pytest.mark.parametrize("frequent", [200_000, 5])
def test_language_model(llm, monkeypatch, frequent):
    from waymark.llm import ppm
    monkeypatch.setattr(ppm, "FREQUENT", frequent)
    docs = [x for x in made(13, 40) if x[0] < 40] + [(41, "zz unseen ∂ words"), (42, None), (42, None)]
    got = sorted(map(tuple, ppm.score_texts(extra(llm, docs), F.col("doc_id") % 3 != 0).collect()), key=str)
    trained = [t for d, t in docs if d % 3]
    want = sorted([(*x, brute.ppm(t, trained)) for x, (_, t) in zip(brute.unigram(docs, lambda d: d % 3), docs, strict=True)], key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-6)


@pytest.mark.parametrize("order", [3, 5])
def test_language_model_of_longer_contexts(llm, monkeypatch, order):
    from waymark.llm import ppm
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(ppm, "SORTED", 500)
    docs = [x for x in made(13, 40) if x[0] < 40] + [(41, "zz unseen ∂ words"), (42, None), (42, None), (43, "abcdef" * 30), (45, "abcdef xbcdef abcdeg")]
    got = sorted(((r.doc_id, r.score) for r in ppm.score_texts(extra(llm, docs), F.col("doc_id") % 3 != 0, order).collect()), key=str)
    trained = [t for d, t in docs if d % 3]
    want = sorted([(d, brute.ppm_of_order(t, trained, order)) for d, t in docs], key=str)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert sorted(x[1] for x in got) == pytest.approx(sorted(x[1] for x in want), rel=1e-5)
    assert dict(got)[45] == pytest.approx(dict(want)[45], rel=1e-5)
    none = ppm.score_texts(llm.createDataFrame([(1, "a b"), (None, None)], DOCS), F.lit(False), order).collect()
    assert sorted(r.score for r in none) == pytest.approx([-4 * math.log10(255), -math.log10(255)])
    assert ppm.score_texts(llm.createDataFrame([], DOCS), F.lit(True), order).count() == 0


def test_language_model_query_sees_longer_contexts(llm, folder):
    from waymark.llm.ppm import op9_ppm
    asked = [i for i in range(60) if __import__("zlib").crc32(str(i).encode()) % 7 == 2]
    docs = [(i, t) for i in range(60) for t in (("abcdeX", "abcdeY") if i in asked else ("abcdeX qbcdeY ",))]
    llm.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    held = {}
    for r in op9_ppm(llm, folder).filter("held_out").collect():
        held.setdefault(r.doc_id, []).append(r.score)
    assert sorted(held) == asked and all(abs(a - b) > 0.3 for a, b in held.values())  # two bytes before X and Y are the same


def test_language_model_edges(llm):
    from waymark.llm.ppm import probabilities, score_texts
    p = 10.0 ** probabilities(np.array([(97 << 16) | (98 << 8) | 99, (97 << 16) | (98 << 8) | 255]), np.array([3.0, 1.0])).reshape(256, 256, 256)
    assert p.sum(2) == pytest.approx(1, abs=1e-5)
    none = score_texts(llm.createDataFrame([(1, "a b"), (None, None)], DOCS), F.lit(False)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in none) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert score_texts(llm.createDataFrame([], DOCS), F.lit(True)).count() == 0


# --- 10 sharding ------------------------------------------------------------------------------------

def test_sharding(llm):
    from waymark.llm.sharding import assign_shards
    docs = made(15, 300) + [(900 + i, "same text " * 20) for i in range(150)] + [(2000, "twice"), (2000, "twice"), (None, "none")]
    got = [Row(*x) for x in assign_shards(extra(llm, docs), 8, bundles=64, cell_rows=20).collect()]
    assert len(got) == len(docs)
    text = dict(docs)
    shard_of, slots, load, sizes = {}, {}, {}, {}
    for doc, size, crc, law, shard, slot, grown in got:
        t = (text[doc] or "").encode()
        assert (size, law, grown, crc) == (len(t) + 1, "bytes", None, __import__("zlib").crc32(t))
        assert shard_of.setdefault(t, shard) == shard  # groups stay together
        slots.setdefault(shard, []).append(slot)
        load[shard] = load.get(shard, 0) + size
        sizes[t] = sizes.get(t, 0) + size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    rest = [x for s, x in load.items() if x != max(load.values())]
    assert max(rest) - min(rest) <= max(sizes.values())
    assert assign_shards(llm.createDataFrame([], DOCS)).count() == 0


def test_schedule():
    from waymark.llm.sharding import schedule
    assert schedule([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


# --- queries and pipeline ---------------------------------------------------------------------------

def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_queries_match_their_statements(llm):
    import duckdb

    from check import table_of
    from waymark.llm.queries import oracle_sql, queries
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = queries()
    for name, sql in oracle_sql().items():
        df = found[name](llm, SF)
        cur = con.execute(sql)
        assert table_of(df.columns, [tuple(r) for r in df.collect()]) == table_of([d[0] for d in cur.description], cur.fetchall()), name


def test_pipeline(llm, folder):
    import corpus_pipeline
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        rows = {r.doc_id: r.text for r in before.collect()}
        stage(llm, before, SF).write.parquet(f"{folder}/{i}")
        docs = llm.read.parquet(f"{folder}/{i}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(rows) <= ids
        if i < 4:
            assert docs.columns == before.columns
        if name == "line dedup":
            assert {d: brute.sha(t or "") for d, t in after.items()} == {d: h for d, _, _, h in brute.lines(list(rows.items()), 10)}
        if name == "n-gram Jaccard join":
            assert set(after) == {c if n else d for d, n, c in brute.jaccard(list(rows.items()), 5, 80)}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {d for d, *_, bad in brute.decontamination(list(rows.items()), items) if not bad}
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)
    assert len(after) > len(ids) / 2
    assert sys.modules["corpus_pipeline"].run(llm, SF).count() == len(after)


# --- callers' columns and ids through the stages ------------------------------------------------------

def test_stages_keep_columns(llm):
    """Columns that are called as inner ones stay as they are, ids of other types too; repeated, NULL and empty rows."""
    import corpus_pipeline
    docs = [(i, t) for i, t in made(4, 60) if i < 60] + [(3, None), (3, None), (None, "a b c d e f g"), (7, "")]
    df = llm.createDataFrame(docs, "doc_id int, text string").withColumn("n_chars", F.length("text").cast("long"))
    names = ("__row", "__lines", "quality_score", "n_lines", "n_dropped", "kept_text", "hit", "label", "uid", "n_shingles", "a.b", "text_hash")
    for n in names:
        df = df.withColumn(n, F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm, df, SF)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        for r in out.collect():
            assert all(r[n] == n + ("none" if r["doc_id"] is None else str(r["doc_id"])) for n in names), name
        assert stage(llm, df.limit(0), SF).count() == 0


def test_products_beyond_64_bits(llm):
    from waymark.llm.block_topk import top_k
    big = 1 << 61
    df = llm.createDataFrame([(0, [big, big]), (1, [big, 1]), (2, [big, big - 5]), (3, [-big, -big]), (4, [1, 1])], "vec_id long, terms array<long>")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, (1 << 63) - 1), (0, 2, 1, (1 << 63) - 1), (0, 3, 4, 1 << 62), (0, 4, 3, -(1 << 63))]


def test_huge_components(llm, tmp_path):
    from waymark.llm.block_topk import op3_block_topk
    rows = [(0, [1e10, 1.0]), (1, [1e10, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (20, [-3e38, 2.0])]
    llm.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r)[:3] for r in op3_block_topk(llm, str(tmp_path)).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)] or got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]


def test_line_dedup_counts_rows(llm, tmp_path):
    """Rows that repeat a doc_id are documents of their own, in the query as in its SQL."""
    import duckdb

    from waymark.llm import line_dedup
    docs = [(i % 3, f"own {i}\nshared line") for i in range(10)] + [(5, "other\nNine"), (6, None)] + [(7, "nine\n nine ")] * 8
    llm.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = rows_of(line_dedup.op8_line_dedup(llm, str(tmp_path)))
    assert got == sorted(con.execute(line_dedup.ORACLE).fetchall(), key=str) and sum(r[2] for r in got) == 10
