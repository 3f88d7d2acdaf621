"""Main text of pages, whitening and importance resampling against plain restatements, on rows that hold the awkward cases."""

import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute
from .test_operators import extra, llm, made, rows_of, same  # noqa: F401

SF = "/root/testdata/sf0.001"


# --- 11 main text ---------------------------------------------------------------------------------

LONG = "This is a paragraph of the article that runs on for some while, with commas and all, so that it has weight."
ARTICLE = f"<h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p>\n<p>Two\n  <b>bo</b>ld <i>words</i><br>after &nbsp; a break &lt;3. {LONG}</p>"
WANT = f"Title & more\n{LONG}\nShort.\nTwo bold words after a break <3. {LONG}"
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us all</a></li></ul></nav>'
TALK = f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{LONG * 3}</p></article></section>'

PAGES = {
    "plain": f"<html><head><title>T</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>{MENU}<!-- ad --><div class='ad'>Buy now.</div>"
             f"<article>{ARTICLE}</article><footer>&copy; me</footer></body></html>",
    "comments beside": f"<body>{MENU}<article>{ARTICLE}</article>{TALK}",
    "comments within": f"<body>{MENU}<article>{ARTICLE}{TALK}</article>",
    "main, sidebar": f"<body><header><h1>Site</h1></header>{MENU}<main>{ARTICLE}</main><aside><p>{LONG}</p></aside>",
    "no names": f'<body><div class="t"><a href="1">Home</a> <a href="2">About</a></div><div class="x1"><div class="x2">{ARTICLE}</div></div><div class="c">Copyright 2020</div>',
    "table": f"<table><tr><td><a href=1>Home</a><br><a href=2>About</a></td><td>{ARTICLE}</td></tr></table>",
    "page in a form": f"<form id=all>{MENU}<article>{ARTICLE}<form><label>Mail</label><input></form></article></form>",
    "notice": f'<div id="cookie-notice"><p>{LONG * 5}</p></div><div id="content">{ARTICLE}</div><div class="sideBar"><p>{LONG * 4}</p></div>',
    "nothing closed": f"<body>{MENU}<article>{ARTICLE.replace('</p>', '').replace('</h1>', '')}<footer>foo</footer></article><div class=ad>buy",
    "own header": f"<article><header><h1>Title &amp; more</h1></header>{ARTICLE.split('</h1>')[1]}</article>",
    "aside within": f"<article>{ARTICLE}<aside>{LONG}</aside><div class='newsletter-signup'>{LONG}</div></article>",
    "teaser": f"<article>{ARTICLE}</article><article><h2>Next</h2><p>short <a href=1>more</a></article>",
    "hidden": f"<article>{ARTICLE}<div style='display: none'>{LONG}</div><p hidden>{LONG}</p></article>",
    "cut off": f"<article>{ARTICLE}<div cla",
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    from waymark.llm.html_content import main_text
    assert main_text(PAGES[name])[0] == WANT


def test_pages(llm):  # noqa: F811
    from waymark.llm.html_content import extract
    long = "".join(f"<p>{i} {LONG}</p>" for i in range(3000))
    rows = [(1, "u", PAGES["plain"]), (1, "u", PAGES["plain"]), (2, None, None), (None, "v", ""), (3, "w", "<script>x</script>"), (4, "x", " plain \n text "),
            (5, "y", f"{MENU}<article>{long}</article>")]
    df = llm.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit("mine")).withColumn("n_chars", F.lit(1)).withColumn("lines", F.lit(1))
    whole = "\n".join(f"{i} {LONG}" for i in range(3000))
    texts = [WANT, WANT, "", "", "", "plain text", whole]
    same(extract(df).select("page_id", "url", "text", "n_chars"), [(p, u, t, len(t)) for (p, u, _), t in zip(rows, texts)])
    assert extract(df.limit(0)).count() == 0


def test_pages_of_the_table(llm):  # noqa: F811
    """Pages of the test tables hold the article in one element, whose paragraphs a pattern can cut out."""
    import html
    import re

    from waymark.llm.html_content import op11_html_content
    want = {}
    for r in llm.read.parquet(f"{SF}/pages.parquet").collect():
        found = re.search(r"<article>(.*?)</article>", r["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " ") if found else "")
        want[r["page_id"]] = "\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub("<[^>]*>", "", p)).split())))
    got = {r["page_id"]: r["text"] for r in op11_html_content(llm, SF).collect()}
    assert got == want


# --- 12 whitening ---------------------------------------------------------------------------------

def test_spectrum():
    from waymark.llm.spectrum import below, leading
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    cases = [np.cov((rng.standard_normal((3 * n, n)) * rng.random(n)).T).reshape(n, n) * 1e5 for n in (1, 2, 3, 17, 64)]
    cases += [np.eye(6), np.zeros((4, 4)), turn @ np.diag([3.0, 3, 3, 1, 1, 0, 0, 0]) @ turn.T, np.diag([1.0, 1 + 1e-10, 1 + 1e-13, 2]), -turn @ np.diag(range(8)) @ turn.T,
              np.array([[0.0, 1], [1, 0]])]
    for a in cases:
        values, vectors = leading(a, 32)
        want = np.linalg.eigvalsh(a)[::-1][:32]
        size = max(np.abs(want).max(), 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * size
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size
        for s in (want.min() - 0.5 * size, *((want[1:] + want[:-1]) / 2)[np.abs(np.diff(want)) > 1e-6 * size]):
            assert below(a, s) == (np.linalg.eigvalsh(a) < s).sum()


def plain_white(rows, top):
    """Restated with whole numbers and the library's eigenvectors; whitened is left signless."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max(Counter(len(v) for _, v in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = [(i, [math.floor(64 * x) + 1000000 for x in v]) for i, v in kept if len(v) == d]
    n, s = len(kept), [sum(v[j] for _, v in kept) for j in range(d)]
    c = np.array([[n * x - t for x, t in zip(v, s)] for _, v in kept], object)
    cov = np.array([[float(Fraction(x, n ** 3)) for x in row] for row in c.T @ c])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for (i, v), r in zip(kept, c):
        for k in range(min(top, d)):
            white = abs(float((r / n).astype(float) @ q[:, k]) / math.sqrt(e[k])) if e[k] > 1e-12 * e[0] else None
            out.append((i, k + 1, n, sum((n * x - t) ** 2 for x, t in zip(v, s)), white, e[k] / e.sum() if white is not None else 0.0))
    return out


def test_whitening(llm):  # noqa: F811
    from waymark.llm.whitening import whiten
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(6) * [3, 2, 1.5, 1, 0.7, 0]]) for i in range(50)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (60, None), (61, [1.0, None] + [0.0] * 4), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (64, []), (65, [1.0, 2.0])]
    df = llm.createDataFrame(rows, "vec_id int, embedding array<double>")
    for name in ("v", "d", "n", "component", "i", "j", "dim", "total"):
        df = df.withColumn(name, F.lit("z"))
    for top in (4, 32):
        got = whiten(df, top).collect()
        want = plain_white(rows, top)
        key = lambda x: (str(x[0]), x[1], x[3])
        assert len(got) == len(want)
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert tuple(g)[:4] == w[:4]
            assert (g["whitened"] is None) == (w[4] is None) and abs(abs(g["whitened"] or 0) - (w[4] or 0)) < 1e-9
            assert abs(g["explained"] - w[5]) < 1e-12 and g["identity_error"] < 1e-10
        for k in range(1, min(top, 5) + 1):  # one sign for all rows
            signs = {np.sign(g["whitened"]) * np.sign(dict(rows)[g["vec_id"]][0]) for g in got if g["component"] == k == 1 and g["vec_id"] is not None and abs(g["whitened"]) > 1}
            assert len(signs) <= 1


def test_whitening_edges(llm):  # noqa: F811
    from waymark.llm.whitening import LONGEST, whiten
    schema = "vec_id long, embedding array<double>"
    assert whiten(llm.createDataFrame([], schema)).count() == 0
    assert whiten(llm.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whiten(llm.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [tuple(r) for r in one] == [(1, k, 1, 0, None, 0.0, None) for k in (1, 2)]
    # values so large that sums of products leave 64 bits
    rows = [(1, [1e300, 1.0]), (2, [-1e9, 2.0]), (3, [5e6, -3.0]), (4, [1.0, 4.0])]
    got = whiten(llm.createDataFrame(rows, schema)).collect()
    x = [[min(max(math.floor(64 * c) if abs(c) < 1e200 else 1 << 40, -(1 << 31)), 1 << 31) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    for r in got:
        assert r["deviation"] == min(LONGEST, sum((4 * c - t) ** 2 for c, t in zip(x[r["vec_id"] - 1], s)))
        assert r["identity_error"] < 1e-4 and math.isfinite(r["whitened"])


def test_whitening_of_the_table(llm):  # noqa: F811
    from waymark.llm.whitening import op12_whitening
    got = op12_whitening(llm, SF).collect()
    rows = [(r["vec_id"], list(r["embedding"])) for r in llm.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = plain_white(rows, 32)
    assert {(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got} == {w[:4] for w in want}
    white = {w[:2]: w[4:] for w in want}
    assert max(abs(abs(r["whitened"]) - white[r["vec_id"], r["component"]][0]) for r in got) < 1e-7
    assert max(abs(r["explained"] / white[r["vec_id"], r["component"]][1] - 1) for r in got) < 1e-9 and got[0]["identity_error"] < 1e-10


# --- 13 importance resampling -----------------------------------------------------------------------

def plain_draw(docs, items, order=2, buckets=10_000, least=20, percent=25):
    def grams(text):
        w = brute.bench_words(text)
        return w, [" ".join(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in grams(text)[1]) for texts in ([x[1] for x in docs], items))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc, text in docs:
        w, f = grams(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    ranks = {id(x): i + 1 for i, x in enumerate(able[:len(able) * percent // 100])}
    return [(*x[:4], ranks.get(id(x))) for x in out]


@pytest.mark.parametrize("order,percent,copies", [(2, 25, 100_000), (1, 100, 100_000), (3, 60, 2)])
def test_importance(llm, monkeypatch, order, percent, copies):  # noqa: F811
    from waymark.llm import importance
    monkeypatch.setattr(importance, "COPIES", copies)
    docs = made(8)
    docs += [docs[3]] * 5 + [(None, docs[3][1]), (None, None), (None, docs[0][1]), (4, docs[9][1])]
    items = [docs[9][1][:200], None, "", "an an Ber", "zzz never there"]
    df = extra(llm, docs).withColumn("weight", F.lit("z")).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("copies", F.lit(0))
    target = llm.createDataFrame([(x,) for x in items], "text string")
    ranked = importance.resample(df, target, order=order, percent=percent)
    same(ranked.select("doc_id", "n_features", "weight", "score", "rank"), plain_draw(docs, items, order, percent=percent))
    texts = importance.drawn_texts(df, ranked)
    assert texts.count() == ranked.filter("rank is not null").count() and texts.filter("text is null").count() == 0


def test_importance_edges(llm):  # noqa: F811
    from waymark.llm.importance import resample
    none = llm.createDataFrame([], "doc_id int, text string")
    some = llm.createDataFrame([(1, "a b " * 30), (2, "c"), (3, None)], "doc_id int, text string")
    assert resample(none, some).count() == 0
    same(resample(some, none, percent=100).select("doc_id", "n_features", "weight", "score", "rank"), plain_draw([tuple(r) for r in some.collect()], [], percent=100))


def test_importance_of_the_table(llm):  # noqa: F811
    from waymark.llm.importance import op13_importance
    docs = [tuple(r) for r in llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [r["text"] for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
    same(op13_importance(llm, SF), plain_draw(docs, items))
    assert rows_of(op13_importance(llm, SF))


# --- restatements of operators 7 and 10 ----------------------------------------------------------------

def test_quality_features_and_updates_are_those_of_plain_python():
    """Features by their texts instead of hashes, and the updates one weight at a time, for ten rows."""
    import re

    import pyarrow as pa

    from waymark.llm import quality
    from waymark.llm.common import BytesHasher, pieces
    texts = ["", "a", "a a a b", "The cat. The CAT!", "x y x y x y", "ü ü é", "1 2 3 4 5 6 7 8 9 1", "--- ... ---", "one two\nthree", "b " * 40]
    (_, data, offsets), = pieces(pa.array(texts))
    slots, values, first = quality.features(data, offsets, BytesHasher())
    rows, seen = [], {}
    for i, text in enumerate(texts):
        tokens = re.findall(r"[0-9a-z\x80-\U0010ffff]+|[!-/:-@\[-`{-\x7f]+", text.translate(brute.UPPER))
        named = [next((f"repeat {lag}" for lag in range(1, 9) if at >= lag and tokens[at - lag] == t), t) for at, t in enumerate(tokens)]
        count = Counter(("one", t) for t in named) + Counter(("two", a, b) for a, b in zip(named, named[1:]))
        length = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values()))
        own = dict(zip(slots[first[i]:first[i + 1]].tolist(), values[first[i]:first[i + 1]].tolist()))
        assert sorted(round(v, 9) for v in own.values()) == sorted(round(math.log1p(n) / length, 9) for n in count.values()) and 0 not in own
        rows.append((slots[first[i]:first[i + 1]], values[first[i]:first[i + 1]], i % 2))
        for f in count:
            seen.setdefault(f, set()).add(i)
    got = quality.ftrl(rows * 3)
    z, n = Counter(), Counter()
    weigh = lambda k: 0.0 if abs(z[k]) <= 0.05 else (math.copysign(0.05, z[k]) - z[k]) / ((1 + math.sqrt(n[k])) + 0.1)
    for s, v, y in rows * 3:
        x = dict(zip(s.tolist(), v.tolist())) | {0: 1.0}
        w = {k: weigh(k) for k in x}
        p = 1 / (1 + math.exp(-sum(w[k] * x[k] for k in x)))
        for k in x:
            g = (p - y) * x[k]
            sigma = math.sqrt(n[k] + g * g) - math.sqrt(n[k])
            z[k] += g - sigma * w[k]
            n[k] += g * g
    assert all(abs(got[k] - weigh(k)) < 1e-6 for k in z) and np.count_nonzero(got) == sum(weigh(k) != 0 for k in z)


def test_shard_loads_are_those_of_the_plain_schedule(llm):  # noqa: F811
    import heapq

    from waymark.llm.sharding import assign_shards
    docs = made(11, 80) + [(200 + i, "same text " * 9) for i in range(7)] + [(300, None), (301, "")]
    got = assign_shards(llm.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    groups = Counter()
    for _, text in docs:
        groups[text or ""] += len((text or "").encode()) + 1
    heap = [0] * 8
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    loads, of = Counter(), {}
    for r in got:
        loads[r["shard"]] += r["size"]
        assert of.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
    assert len(got) == len(docs)
    total, largest = sum(groups.values()), max(groups.values())
    small = sum(s for s in groups.values() if s * 4096 <= total)  # the rest goes one by one
    assert max(loads.values()) <= max(heap) + small and max(loads.values()) >= max(largest, -(-total // 8))
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
