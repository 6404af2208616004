"""Hard negatives, resampling and main text against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vertexflow.llm import html_text, negatives, queries, resample


def brute_negatives(rows, anchors, k=5, few=3):
    out = []
    scored = lambda a, r: sum(x * y for x, y in zip(a[2], r[2]))
    for a in anchors:
        others = [(-scored(a, r), r[0], r[1]) for r in rows if r[0] != a[0]]
        for s, i, _ in sorted(x for x in others if x[2] == a[1])[:k]:
            found = sorted(x for x in others if x[2] != a[1] and -50 * s <= -100 * x[0] <= -95 * s)[:few]
            out += [(a[0], i, n, j, -s, -t) for n, (t, j, _) in enumerate(found, 1)]
    return Counter(out)


def usable(rows):
    return [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if None not in (i, g) and v and all(x is not None and math.isfinite(x) for x in v)]


@pytest.mark.parametrize("scale", [0.2, 1e-3, 1e4])
def test_hard_negatives_with_ties_and_odd_rows(spark, scale):
    rng = random.Random(int(scale * 1000))
    rows = [(i, rng.randrange(4), [round(rng.gauss(0.3, 1) * scale, rng.choice([1, 6])) for _ in range(rng.choice([6, 6, 4]))]) for i in range(400)]
    rows += [(i, 1, rows[i][2]) for i in range(0, 40, 4)] + [rows[50], rows[51]]
    rows += [(900, None, [0.1]), (901, 2, None), (902, 2, []), (903, 1, [0.1, None]), (904, 1, [float("nan")]), (None, 1, [0.5]), (950, 77, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "score", "anchor", "rank")}).repartition(3)
    got = Counter(tuple(r) for r in negatives.hard_negatives(spark, df, F.col("vec_id") % 50 == 0, block_bytes=256).collect())
    fine = usable(rows)
    anchors = list({(i, g, tuple(v)): (i, g, v) for i, g, v in fine if i % 50 == 0}.values())
    assert got == brute_negatives(fine, anchors)
    assert sum(got.values()) > 30
    none = negatives.hard_negatives(spark, df.limit(0), F.col("vec_id") % 50 == 0)
    assert none.collect() == [] and none.columns[0] == "anchor_id"


def test_sliced_products_are_whole_and_drop_only_what_cannot_qualify():
    rng = np.random.default_rng(3)
    for most in (3, 200, 1 << 20, 1 << 26):
        a, x = rng.integers(-most, most, (20, 7)), rng.integers(-most, most, (300, 7))
        able = rng.random((20, 300)) < 0.9
        seen = []

        def still(anchor, low, high):
            seen.append(len(anchor))
            return high >= negatives.kth_best(anchor, low, 4, 20)[anchor]

        i, j, score = negatives.sliced(a, x, able, still)
        whole = a @ x.T
        assert (score == whole[i, j]).all()
        want = np.where(able, whole, np.iinfo(np.int64).min)
        for q in range(20):
            assert sorted(score[i == q])[::-1][:4] == sorted(want[q])[::-1][:4]
        assert seen[-1] < able.sum()


def brute_resample(docs, target, most, buckets, least, percent):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    features = lambda t: [" ".join(w[i : i + k]) for w in [words(t)] for k in range(1, most + 1) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    scored = []
    for key, text in docs:
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        scored.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    may = sorted((r for r in scored if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = may[: percent * len(may) // 100]
    return Counter([(*r[:4], i) for i, r in enumerate(drawn, 1)] + [(*r[:4], None) for r in may[len(drawn) :]] + [(*r[:4], None) for r in scored if not r[4]])


@pytest.mark.parametrize("most, nodes, percent", [(1, 50, 10), (3, 40, 50), (2, 1_000_000, 100)])
def test_resample(spark, small, monkeypatch, most, nodes, percent):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (3, docs[5][1]), (docs[0][0], docs[0][1]), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "İ ß A-b_c \x00 ﬁ 12ab " * 3000), (10**6 + 3, " \n "), (10**6 + 4, "Zz zz ZZ")]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").select("text").collect()] + [None, "", "zz zz"]
    for f in (resample.bucket_totals, resample.weigh):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], nodes))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "n", "bucket", "weight", "place", "may", "before", "rank")}).repartition(3)
    got = resample.resample(spark, df, spark.createDataFrame([(t,) for t in target], "text string"), most_words=most, buckets=97, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute_resample(docs, target, most, 97, 20, percent)


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    got = resample.resample(spark, docs, docs.limit(0), percent=100).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in got) == [(1, 40, 1), (2, 0, None)]
    assert resample.resample(spark, docs.limit(0), docs).collect() == []


PROSE = "This is the text of an article, and it has all of the words that the language has in it. " * 3
MARKED = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar">
<header class="site-header"><h1>Site</h1><p>{PROSE}</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-banner"><p>{PROSE}</p></div><main><div class="breadcrumb"><a href=1>a</a> / b</div>
<article><header><h1>Real &amp; title</h1><p class=byline>By X</p></header><p>Short &#233;&nbsp;one<br>goes
on.<p>{PROSE}<script>var t = "</p>";</script></p><div class="ad">{PROSE}</div><h2>Points</h2><ul><li>First<li>Second</ul>
<aside>{PROSE}</aside>tail text<br><br>after a break<h3>See also</h3><ul><li><a href=1>One link</a><li><a href=2>Two links</a></ul>
<form><label>Your email</label><textarea>{PROSE}</textarea></form>
<section class="comments"><h2>Comments</h2><article><p>{PROSE}</p></article></section></article></main>
<div id="sidebar">{PROSE}</div><footer>f</footer>"""
PLAIN = f"""<body><div><a href=1>Home</a> | <a href=2>About</a></div><div id=content><h2>A heading</h2><p>{PROSE}</p><p>Tiny.</p><p>{PROSE}</p></div>
<div>Copyright by me</div><div class="comment-list"><p>{PROSE}</p></div>"""


def test_main_text_of_marked_and_plain_pages():
    prose = PROSE.strip()
    assert html_text.main_text(MARKED) == "\n\n".join(["Real & title", "Short é one goes on.", prose, "Points", "First", "Second", "tail text", "after a break"])
    assert html_text.main_text(PLAIN) == "\n\n".join(["A heading", prose, "Tiny.", prose])


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<p>unclosed <a href=\"x>y", "<!-- never ends <p>x", "<script>x", "</p></div>", "<a title=\"" * 20000, "<span class=ad>" * 20000, "<div>" * 20000, "<a '" * 20000])
def test_odd_pages_end_without_main_text(page):
    assert html_text.main_text(page) == ""


def test_pages_of_an_unknown_language_and_very_long_ones():
    strange = "xq zwv prl mmk ttn " * 30
    assert html_text.main_text(f"<div><p>{strange}</p></div>") == strange.strip()
    assert len(html_text.main_text("<article>" + "<p>word</p>" * 50_000 + "</article>")) == 6 * 50_000 - 2


def test_pages_query_holds_every_article(spark, small):
    """The tables' pages hold their text in one article; it is cut here by its own tags."""
    import html

    got = {r["page_id"]: r for r in queries.op13_html_text(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        cut = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert got[r["page_id"]]["text"] == "\n\n".join(x for x in cut if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_blocks_and_extra_columns(spark):
    pages = spark.createDataFrame([(1, "u", MARKED), (1, "u", MARKED), (None, None, None), (3, "v", PLAIN)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "tag", "place")})
    texts = html_text.extract(pages)
    assert texts.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r["page_id"], r["url"], r["n_chars"]) for r in texts.collect()) == Counter([(1, "u", len(html_text.main_text(MARKED)))] * 2 + [(None, None, 0), (3, "v", len(html_text.main_text(PLAIN)))])
    kept = defaultdict(list)
    for r in html_text.label_blocks(pages.where("page_id = 3")).orderBy("place").collect():
        kept[r["page_id"]] += [r["text"]] if r["kept"] else []
    assert "\n\n".join(kept[3]) == html_text.main_text(PLAIN)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_new_queries_on_the_small_tables(spark, small):
    assert queries.op11_hard_negatives(spark, small).count() > 0
    got = queries.op12_resample(spark, small).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(1 for r in got if r["n_features"] >= 20) * 10 // 100))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_resample", "op13_html_text"])
def test_queries_against_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(map(tuple, found.fetchall())) == Counter(tuple(r) for r in got.select(columns).collect())
