"""Quality classifier, HTML extraction, and the pipeline."""

import functools
import os
import random
import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import html_text, quality


def text_of(rng, good):
    w = ["".join(rng.choice(["ba", "ne", "lo", "ti", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 90))]
    if good:
        return " ".join(w).capitalize() + "."
    return rng.choice([" | ".join(w), " ".join(w).upper().replace(" ", "!! "), " ".join(x + rng.choice(["***", "%%%"]) for x in w), " ".join(x for y in w[:6] for x in [y] * 12)])


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = [(i, text_of(rng, i % 4 != 0), "en", f"s{i % 3}", 0) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    return docs, spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, n)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = quality.fitted(docs, labels)
    got = quality.score(docs, model).withColumn("h", quality.held_out(F.col("doc_id"))).where("h").collect()
    assert len(got) > 80 and sum((r["score"] >= 0.7) == (r["doc_id"] % 4 != 0) for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None, "a"), (1, "", "a"), (None, "x " * 100_000, "a")], "doc_id long, text string, score string")
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect())


def test_labels_of_one_kind_or_none(spark):
    docs, labels = corpus(spark, 20)
    for part in (labels.where("false"), labels.where("quality = 1"), labels.where("quality = 0")):
        got = quality.score(docs, quality.fitted(docs, part)).collect()
        assert len(got) == 20 and len({r["score"] for r in got}) == 1


def test_the_draw_is_bounded_and_keeps_both_labels(spark):
    docs, labels = corpus(spark, 200)
    rows = quality.training_rows(docs, labels)
    again = rows.unionByName(rows.where("label = 1")).unionByName(spark.range(300).selectExpr("id + 5000 as id", "'one boilerplate text' as text", "1 as label"))
    drawn = [tuple(r) for r in quality.drawn_rows(again, 40, 10**9).collect()]
    assert sum(y for _, y in drawn) == 20 and sum(1 - y for _, y in drawn) == 20
    few = quality.drawn_rows(again, 40, 2_000).collect()
    assert {r["label"] for r in few} == {0, 1} and len(few) < 40
    for sample, most in ((2, 10**9), (6000, 1)):
        assert "coef" in quality.fit(again, sample=sample, most_bytes=most)
    many = spark.range(300).selectExpr("id", "'the same text' as text", "1 as label").unionByName(rows.where("label = 0"))
    assert "coef" in quality.fit(many)


def test_dual_descent_reaches_the_least_loss():
    """The hinge loss by dual descent is that of a slow subgradient descent on the primal, to a thousandth."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    y = np.where(x @ rng.normal(size=6) + 0.8 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    w = quality.dual_descent([np.arange(6)] * 80, list(x), y, cost, 6, epochs=3000)
    ones = np.column_stack([x, np.ones(80)])
    loss = lambda v: 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (ones @ v))
    best, v = np.inf, np.zeros(7)
    for step in range(1, 60_000):
        bad = y * (ones @ v) < 1
        v = v - (v - ((cost * y)[bad] @ ones[bad])) / (step + 10)
        best = min(best, loss(v))
    assert loss(w) <= best * 1.001


def test_indicators_are_distinct_and_whole():
    ids = quality.indicators("Le Le Le Le")
    assert len(set(ids.tolist())) == len(ids) and ids[-1] == 2 * quality.BYTES + quality.SHAPES - 1
    assert quality.indicators(None).tolist() == quality.indicators("").tolist() == [2 * quality.BYTES]
    long = "ab cd " * 50_000
    assert set(quality.indicators(long + "!?zz").tolist()) > set(quality.indicators("ab cd ab cd").tolist()[:-1])


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>menu</a></ul></nav><!-- x --><div class="ad">buy</div>
    <article><h1>Head &amp; line</h1><p><b>First  one.<br><p>Second&nbsp;two &#233; &lt;b&gt;</p><aside>side</aside><div class="comments"><article>reply</article></div><p>Third<form>f<input></form></article>
    <div id="sidebar">s</div><footer>&copy; foot</footer></body></html>"""
    assert html_text.main_text(html_text.blocks(page)) == "Head & line\nFirst one.\nSecond two é <b>\nThird"
    assert html_text.main_text(html_text.blocks("<p>a<p>b")) == "a\nb"
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<script>x") == []
    assert html_text.main_text(html_text.blocks("1 < 2 & 3 <4> <b")) == "1 < 2 & 3 <4> <b"


def test_shared_open_lines_are_deleted(spark):
    page = lambda i: f"<div>Top of site</div><p>Own text {i}.</p><p>More {i}.</p><div>End of site</div>"
    rows = [(i, f"http://h.com/a/{i}", page(i), "c") for i in range(40)] + [(100, "http://alone.com/x", page(7), "c"), (101, None, page(1), "c"), (102, "http://h.com/a/5", None, "c"), (103, "http://h.com/b", "", "c"), (None, "http://h.com/a/1", page(99), "c"), (1, "http://h.com/a/1", page(1), "c")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[i] == f"Own text {i}.\nMore {i}." for i in range(40))
    assert by[100].startswith("Top of site") and by[101].startswith("Top of site") and by[102] == by[103] == "" and by[None] == "Own text 99.\nMore 99."
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_articles_of_copies_are_kept(spark):
    page = "<nav>m</nav><article><p>One.</p><p>Two.</p></article>"
    got = html_text.extract(spark.createDataFrame([(i, f"http://h.com/{i}", page) for i in range(5)], "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {"One.\nTwo."}


def test_hostile_markup_takes_time_in_proportion():
    for bad in ("<a \"'", "<a<a", "<b>", "<b></x>", "<p>", "<b><hr>", '<a ">"', "<script", "<!--", "<li><b>"):
        began = time.process_time()
        html_text.blocks(bad * (300_000 // len(bad)) + ">")
        assert time.process_time() - began < 5, bad
    assert html_text.blocks("x <a \"' y <b>bold</b> <p>z") == [(html_text.OPEN, "x bold"), (html_text.OPEN, "z")]


def test_long_pages_in_little_memory():
    rng = random.Random(2)
    a, b = ([rng.randrange(10**9) if rng.random() < 0.5 else i % 700 for i in range(20_000)] for _ in range(2))
    tracemalloc.start()
    got = html_text.common_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 60_000_000 and len(got) > 4000
    tracemalloc.stop()


def brute_extract(pages, window=4, copied=0.9):
    """Every page's text by plain loops: (page_id, text)."""
    seen = {}
    for _, host, path, page in pages:
        parts = tuple(html_text.blocks(page))
        if parts:
            seen[host, parts] = min(seen.get((host, parts), path), path)

    def digest(parts):  # pages at one path are in order of their digest
        return next(html_text._parse([pd.DataFrame({"page_id": [1], "url": [""], "host": [""], "path": [""], "html": ["".join(f"<p>{t}" for _, t in parts)]})]))["digest"][0]

    order = sorted(seen, key=lambda k: (k[0], seen[k], digest(k[1])))
    gone = {}
    for i, (host, parts) in enumerate(order):
        best = []
        for j in range(max(0, i - window), min(len(order), i + window + 1)):
            h, other = order[j]
            lines = {t for _, t in other}
            open_ = [t for z, t in parts if z == html_text.OPEN]
            if j != i and h == host and sum(len(t) for t in open_ if t in lines) < copied * sum(map(len, open_)):
                same = len(os.path.commonprefix([seen[host, parts], seen[h, other]]))
                best.append((-same, abs(i - j), j - i, j))
        if best:
            other = [t for _, t in order[min(best)[-1]][1]]
            a = [t for _, t in parts]
            d = [[0] * (len(other) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a)):
                for y in range(len(other)):
                    d[x + 1][y + 1] = d[x][y] + 1 if a[x] == other[y] else max(d[x][y + 1], d[x + 1][y])
            x, y = len(a), len(other)
            lost = set()
            while x and y:
                if a[x - 1] == other[y - 1]:
                    lost.add(x - 1)
                    x, y = x - 1, y - 1
                elif d[x - 1][y] >= d[x][y - 1]:
                    x -= 1
                else:
                    y -= 1
            gone[host, parts] = lost
    return sorted((i, "\n".join(t for k, (z, t) in enumerate(html_text.blocks(p)) if z == html_text.ARTICLE or z == html_text.OPEN and k not in gone.get((h, tuple(html_text.blocks(p))), ()))) for i, h, _, p in pages)


def test_extract_is_as_by_brute_force(spark):
    """Lines are in one order on all pages of a host, so that their longest common subsequence is unique."""
    rng = random.Random(8)
    pages = []
    for i in range(160):
        frame = [f"<div>frame {k}</div>" for k in range(6) if rng.random() < 0.7]
        text = [f"<p>text {rng.randrange(4 if i % 5 == 0 else 10**6)} of page</p>" for _ in range(rng.randrange(4))]
        pages.append((i, rng.choice(["a.com", "a.com", "b.com"]), f"/{rng.randrange(3)}/{i:04d}", "".join([*frame[:3], *dict.fromkeys(text), *frame[3:], "<nav>menu</nav>" * (i % 2)])))
    pages += [(200 + k, "a.com", f"/0/copy{k}", pages[0][3]) for k in range(12)]
    docs = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, h, p, x in pages], "page_id long, url string, html string")
    want = brute_extract(pages)
    for parts in (1, 5):
        assert sorted((r["page_id"], r["text"]) for r in html_text.extract(docs.repartition(parts)).collect()) == want


def test_a_copy_is_no_pair(spark):
    frame = "<div>Top of the whole site</div>{}<div>End of the whole site</div>"
    own = "".join(f"<p>A long line of the article, number {k}.</p>" for k in range(30))
    rows = [(k, f"http://h.com/a/{k}", frame.format(own + f"<p>edit {k}</p>")) for k in range(3)] + [(9, "http://h.com/z", frame.format("<p>Other text</p>"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith("A long line") and got[k].endswith(f"edit {k}") and got[k].count("\n") == 30 for k in range(3)) and got[9] == "Other text"


def test_a_pair_is_found_beyond_many_copies(spark):
    frame = "<div>Top of the whole site</div>{}<div>End of the whole site</div>"
    own = "".join(f"<p>A long line of the article, number {k}.</p>" for k in range(30))
    rows = [(k, f"http://h.com/a/{k:02d}", frame.format(own + f"<p>edit {k}</p>")) for k in range(20)] + [(99, "http://h.com/z", frame.format("<p>Other text</p>"))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].startswith("A long line") and got[k].endswith(f"edit {k}") and got[k].count("\n") == 30 for k in range(20)) and got[99] == "Other text"


def copies(rng):
    """Pages of groups of near copies of which some differ in more and more lines, between pages of other text; lines are in one order on all pages of a host."""
    pages = []
    for host, groups in (("a.com", 3), ("b.com", 1), ("c.com", 5)):
        for group in range(groups):
            base = [f"text {group} {k} of the page" for k in range(25)]
            folder, at = rng.choice(["/a/b", "/a/c", "/"]), rng.randrange(10**4)
            for i in range(rng.choice([14, 45])):
                text = [f"edit {rng.randrange(10**6)} of page" if rng.random() < (0.02, 0.06)[group % 2] else t for t in base]
                pages.append((len(pages), host, f"{folder}/{at if rng.random() < 0.9 else rng.randrange(10**4):04d}/{i:03d}", "".join(f"<p>{t}</p>" for t in ["top of site", *dict.fromkeys(text), *["end of site"] * (1 + group % 2)])))
        for i in range(5):
            pages.append((len(pages), host, f"/{rng.choice('abz')}/{rng.randrange(10**4):04d}", f"<p>top of site</p><p>other {rng.randrange(10**6)}</p><p>end of site</p>"))
    return pages


@pytest.mark.parametrize("leaf, directory, load", [(256, 16 << 20, 4096), (3, 16 << 20, 2), (2, 9000, 7), (2, 0, 1)])
def test_pairs_beyond_the_window_are_as_by_brute_force(spark, monkeypatch, leaf, directory, load):
    pages = copies(random.Random(leaf))
    docs = spark.createDataFrame([(i, f"http://{h}{p}", x) for i, h, p, x in pages], "page_id long, url string, html string")
    want = brute_extract(pages, window=len(pages))
    assert want != brute_extract(pages)
    monkeypatch.setattr(html_text, "shared_open_lines", functools.partial(html_text.shared_open_lines, leaf=leaf, directory=directory, load=load))
    assert sorted((r["page_id"], r["text"]) for r in html_text.extract(docs.repartition(3)).collect()) == want


def test_bounds_rule_out_no_page_that_differs():
    rng = random.Random(5)
    page = lambda lines: html_text._Page("h", "/" + "x" * rng.randrange(3), 0, bytes(html_text.OPEN if rng.random() < 0.8 else html_text.BOILERPLATE for _ in lines), np.array([5 + v % 7 for v in lines], "<i4").tobytes(), np.array(lines, "<u8").tobytes())
    some = lambda: page([v for v in range(30) if rng.random() < 0.97] + [rng.randrange(40) for _ in range(rng.randrange(3))])
    ruled = 0
    for _ in range(300):
        pages = sorted((some() for _ in range(rng.randrange(1, 40))), key=lambda y: y.path)
        x = some()
        leaves = [pages[i : i + 3] for i in range(0, len(pages), 3)]
        tree = html_text._Tree(7, [html_text._Bound.over([html_text._Bound.of(y) for y in b]) for b in leaves], fan=2)
        for side in (-1, 1):
            for start in range(7, 7 + len(leaves)):
                got = list(tree.leaves(x, start, side, -1, 0.9))
                all_of = list(range(start, 7 + len(leaves)) if side > 0 else range(start, 6, -1))
                assert got == [k for k in all_of if k in got]
                assert all(x.has_copy(y, 0.9) for k in all_of if k not in got for y in leaves[k - 7])
                ruled += len(all_of) - len(got)
    assert ruled > 1000


@pytest.mark.parametrize("cut", [0, 3, 9])
def test_longest_common_lines(cut):
    rng = random.Random(cut)

    def longest(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(300):
        a, b = ([rng.randrange(5 + cut) for _ in range(rng.randrange(14))] for _ in range(2))
        got = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(got) == longest(a, b) and all(x in rest for x in [a[i] for i in got])


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    docs, labels = corpus(spark)
    plain = docs.where("doc_id % 4 <> 0")
    copies = plain.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 10_000)
    secret = plain.where("doc_id = 61").withColumns({"doc_id": F.lit(20_000).cast("long"), "text": F.concat(F.lit("Some other words and password=49b0203a9cc466e6ee now "), F.reverse("text"))})
    nulls = spark.createDataFrame([(30_000, None, None, None, None), (30_001, "", "en", "s0", 0)], docs.schema)
    both = docs.unionByName(copies).unionByName(secret).unionByName(nulls)
    both.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    step = both
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if k == 0:
            assert len(kept & {r["doc_id"] for r in plain.collect()}) >= 0.97 * plain.count() and sum(i % 4 == 0 for i in kept if i < 600) <= 10
        if k == 1:
            assert not kept & {r["doc_id"] for r in copies.collect()}
        if k == 2 and 20_000 in kept:
            text = out.where("doc_id = 20000").first()
            assert "<SECRET>" in text["text"] and "49b0203a9cc466e6ee" not in text["text"] and text["n_chars"] == len(text["text"])
        if k > 1:
            assert kept == before
        before = kept
        path = str(tmp_path / f"out{k}")
        out.write.parquet(path)
        step = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == step.count()


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(6)]
    near = lambda t: t + " end"
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[2]), (8, near(texts[2])), (None, near(texts[0])), (None, texts[3]), (None, near(texts[3])), (None, texts[4]), (3, texts[5]), (2, near(texts[5])), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.keep_one_of_group(spark, docs, "").collect()]
    three = [r for r in got if r in ((None, texts[3]), (None, near(texts[3])))]
    assert len(three) == 1
    assert sorted(map(repr, set(got) - set(three))) == sorted(map(repr, [(7, texts[0]), (7, texts[1]), (7, texts[2]), (None, texts[4]), (2, near(texts[5])), (9, None)])) and len(got) == 7


def test_text_beside_a_small_article_stays(spark):
    page = lambda k: f"<nav>menu</nav><p>shared banner</p><h1>Title {k}</h1><div>main text of {k}</div><article><p>teaser</p></article><p>shared end</p>"
    rows = [(k, f"http://h.com/{k}", page(k)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nmain text of {k}\nteaser" for k in range(3)}
