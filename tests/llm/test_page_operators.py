"""Main text, WARC files, image copies and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import image_copies as I
from turnloom.llm import warc
from turnloom.llm.common import materialise
from turnloom.llm.html_text import Page, extract, main_text
from turnloom.llm.queries import op8_local_descriptors

PARAGRAPHS = ["A first paragraph with enough words to be read as the text of a page, and then some more of them.", "Another one &amp; its <b>bold <i>words</i></b>,<br>which go on for a while so that it weighs more than a menu."]
TEXT = "The title of it\n\n" + PARAGRAPHS[0] + "\n\nAnother one & its bold words, which go on for a while so that it weighs more than a menu."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}<script>var a = '<p>no</p>';</script></body></html>"


@pytest.mark.parametrize(
    "body",
    [
        "<nav><ul><li><a href=/>Home</a></ul></nav><article><h1>The title of it</h1><p>{0}<p>{1}</article><footer>&copy; us</footer>",
        "<header class=top><a href=/>Site</a></header><main><h1>The title of it</h1><p>{0}</p><p>{1}</p><aside>aside text here</aside></main>",
        '<div id="menu"><a href=1>one</a> <a href=2>two</a></div><div class=wrap><div class=story><h2>The title of it</h2><p>{0}</p><div class="ad">Buy this now, it is cheap and good and new.</div><p>{1}</p></div><div id="comments"><p>I am a reader and I have a very long opinion on what is written above, which I share.</p></div></div>',
        "<article><header><h1>The title of it</h1></header><!-- <p>hidden</p> --><p>{0}</p><form><label>Mail</label><input></form><p>{1}</p><div class='cookie-notice'>We use cookies.</div></article>",
        "<ARTICLE><H1>The\n title   of it</H1><P>{0}</P><noscript>no script</noscript><section><p>{1}</p></section></ARTICLE>",
    ],
)
def test_main_text_of_pages(body):
    assert main_text(page(body.format(*PARAGRAPHS))) == TEXT


@pytest.mark.parametrize(
    "body",
    [
        "<main><article><p>{0}</p><p>Short.</p></article><article><p>{1}</p>{2}</article></main>",
        "<article><p>{0}</p><article class=card>{2}</article><p>{1}</p><p>Short.</p></article>",
        "<div><article><p>{0}</p></article><article>{2}</article><article><h3>An hour later</h3><p>{1}</p><p>Short.</p></article></div>",
    ],
)
def test_text_of_all_articles_of_a_page(body):
    longer = "This one is the longest paragraph of all of them, " * 6
    text = main_text(page("<nav><a href=/>Home</a></nav>" + body.format(*PARAGRAPHS, f"<p>{longer}<a href=/x>link</a></p>" * 6) + "<footer>us</footer>"))
    assert set(text.split("\n\n")) - {"An hour later"} == {PARAGRAPHS[0], TEXT.split("\n\n")[2], longer + "link", "Short."}


@pytest.mark.parametrize("box", ["div class='content has-sidebar'", "div class=layout-no-sidebar", "div class='post comments-open'", "div class=page-with-header", "div id=popular-science", "section class=legal-guide", "div class='discussion social'", "div class=sidebar", "form action=x", "form class=search"])
def test_text_of_a_page_inside_a_marked_box(box):
    inner = f"<nav><a href=/>Home</a></nav><h1>The title of it</h1><p>{PARAGRAPHS[0]}</p><label>Mail</label><input><select><option>one</select><div class=main-nav>no text</div><p>{PARAGRAPHS[1]}</p><div id=comments-area><p>A reader's view.</p></div><button>Send</button>"
    assert main_text(page(f"<{box}>{inner}</{box.split()[0]}><div class=ad-slot>Buy now.</div>")) == TEXT
    assert main_text(page(f"<{box}><article>{inner}</article></{box.split()[0]}><footer>us</footer>")) == TEXT


def test_marked_boxes_beside_the_text_stay_out():
    views = "<p>I am a reader and I have a very long opinion on what is written above.</p>" * 20
    for box in ("div class=comments", "div id=comment-list", "form", "div class='site-footer wide'"):
        assert main_text(page(f"<div><h1>The title of it</h1><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p></div><{box}>{views}</{box.split()[0]}>")) == TEXT


def test_densities_follow_their_definition():
    rng = random.Random(9)

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return ("#text", "word " * rng.randint(1, 30), [])
        return (rng.choice(["div", "section", "p" if depth == 1 else "div", "a"]), "", [tree(depth - 1) for _ in range(rng.randint(1, 4))])

    def html_of(t):
        return t[1] if t[0] == "#text" else f"<{t[0]}>{''.join(map(html_of, t[2]))}</{t[0]}>"

    def counted(t, linked=False):
        """(characters, tags, characters in links, links) below a node; text next to text is one stretch."""
        if t[0] == "#text":
            return len(t[1]), 0, len(t[1]) * linked, 0
        linked = linked or t[0] == "a"
        every = [counted(x, linked) for x in t[2]]
        inner = [x for x in t[2] if x[0] != "#text"]
        joined = [len("".join(x[1] for x in g).strip()) for k, g in itertools.groupby(t[2], lambda x: x[0] == "#text") if k]
        below = [e for e, x in zip(every, t[2], strict=True) if x[0] != "#text"]
        own = sum(joined)
        return own + sum(e[0] for e in below), len(inner) + sum(e[1] for e in below), own * linked + sum(e[2] for e in below), sum(x[0] == "a" for x in inner) + sum(e[3] for e in below)

    for _ in range(60):
        t = ("html", "", [("body", "", [tree(4) for _ in range(3)])])
        page_ = Page(html_of(t[2][0]))
        chars, density, total = page_.densities()
        c0, _, l0, _ = counted(t)
        nodes, sums = [], []

        def walk(x):
            c, tags, lc, lt = counted(x)
            tags = max(1, tags)
            base = math.log(math.e + l0 / max(1, c0) * c + c * lc / max(1, c - lc))
            nodes.append(c / tags * max(0.0, math.log(max(1.0, c * tags / (max(1, lc) * max(1, lt))))) / max(1.0, math.log(base)) if c else 0.0)
            at = len(nodes) - 1
            sums.append(0.0)
            for y in x[2]:
                if y[0] != "#text":
                    sums[at] += walk(y)
            return nodes[at]

        walk(t)
        linked = [x for x in range(len(page_.tag)) if page_.tag[x] == "a"]
        own = [i for i in range(len(nodes)) if not any(a == i or a in _above(page_, i) for a in linked)]
        assert len(nodes) == len(density) and all(abs(nodes[i] - density[i]) < 1e-6 * max(1, nodes[i]) for i in own) and abs(sums[0] - total[0]) < 1e-6 * max(1, sums[0])


def _above(page_, i):
    while i:
        i = page_.parent[i]
        yield i


@pytest.mark.parametrize("unit", ["<a ", "<a href='", '<a b="x" ', "</style", "<!-", "<!--", "<b>", "</i>", "<b><p></p>", "<div ", "<style", "<script>", "<a =\"'>", "&#"])
def test_a_page_of_unclosed_tags_takes_linear_time(unit):
    begin = time.process_time()
    main_text("<p>text</p>" + unit * (1_000_000 // len(unit)))
    assert time.process_time() - begin < 8


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain  text"), (3, "u", "plain  text"), (4, "u", "<div>" * 3000 + "deep text" + "</div>" * 10), (5, "u", "<p>" + "long words " * 50_000), (None, "u", "<<>&&amp;#x41;</p>"), (6, "u", "<script>never closed <p>x")]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4, 6)] == ["", "", "plain text", "deep text", ""] and got[5]["n_chars"] == 550_000 - 1
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clashing = spark.createDataFrame([(1, "u", "<p>some text</p>", "other", 5)], "page_id long, url string, html string, text string, n_chars string")
    assert extract(clashing).collect() == [(1, "u", "some text", 9)]


def test_warc_records_read_back_alone_and_in_order():
    rng = random.Random(1)
    records = [warc.record(i, f"http://x/{i}", (p := f"<p>page {i} " * rng.randint(0, 40)).encode(), warc.digest(p.encode()), None, False) for i in range(60)]
    data, places = warc.pack_file(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.unpack_file(data)) == records and list(warc.unpack_file(data, [places[7], places[3]])) == [records[7], records[3]]
    assert list(warc.unpack_file(warc.pack_file(records[:1])[0])) == records[:1]
    head, http, body = warc.parse(records[5])
    assert head["warc-type"] == "response" and int(http["content-length"]) == len(body) and head["warc-payload-digest"] == f"sha1:{warc.digest(body)}"


def test_warc_revisits(spark):
    rows = [(1, "a", "same"), (2, "b", "same"), (9, "c", "same"), (9, "c", "same"), (3, "d", None), (4, None, ""), (5, "e\r\nx", "other é"), (None, "n", "none"), (None, "n", "same")]
    index = warc.write_warcs(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS sha1", "2 AS last", "3 AS k"))
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_warcs(index).collect()), key=repr)
    d = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    expected = [(0, "response", None, 4, d("none")), (0, "revisit", 9, 4, d("same")), (1, "revisit", 9, 4, d("same")), (2, "revisit", 9, 4, d("same")), (3, "revisit", 4, 0, d("")), (4, "response", None, 0, d("")), (5, "response", None, 8, d("other é")), (9, "response", None, 4, d("same")), (9, "revisit", 9, 4, d("same"))]
    assert got == sorted(expected, key=repr)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warcs(warc.write_warcs(none)).count() == 0


def written(df, spark):
    return materialise(df, "written")


def edited(df, kind):
    return I.features(I.drawn(df.withColumn("kind", F.expr(kind)), edit="kind"))


def by_brute_force(q, c):
    """Pairs of images whose descriptors agree, every one of q against every one of c (pandas of FEATURES)."""
    parts = {k: (g["x"].to_numpy() + 1j * g["y"].to_numpy(), g[["d0", "d1", "d2", "d3"]].to_numpy().view(np.uint64)) for k, g in c.groupby("image_id")}
    out = set()
    for k, g in q.groupby("image_id"):
        at, d = g["x"].to_numpy() + 1j * g["y"].to_numpy(), g[["d0", "d1", "d2", "d3"]].to_numpy().view(np.uint64)
        for j, (there, e) in parts.items():
            bits = np.bitwise_count(d[:, None] ^ e[None]).sum(2, dtype=np.int64)
            met = bits.min(1) <= I.AGREE_BITS
            if met.sum() >= I.LEAST_INLIERS and I.consensus(at[met], there[bits.argmin(1)[met]])[0] >= I.LEAST_INLIERS:
                out.add((k, j))
    return out


def test_edited_copies_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(120, 64)))]
    vectors += [(200, vectors[3][1]), (201, None), (202, []), (203, [0.0] * 64)]
    vectors += [(300 + i, [float(x) for x in np.array(vectors[0][1]) + rng.normal(size=64) * 0.05]) for i in range(20)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    equal = {r["image_id"]: r["class_id"] for r in I.classes(I.drawn(df)).collect()}
    assert equal[200] == 3 and equal[5] == 5 and 201 not in equal
    rows = written(I.features(I.drawn(df)), spark)
    near = {r["image_id"]: r["near_id"] for r in I.near_classes(rows.filter("image_id <> 200")).collect()}
    assert set(near) >= {0, *range(302, 318)} and set(near.values()) == {0} and not set(near) & set(range(1, 120))
    queries = written(edited(df.filter("vec_id % 20 = 0 AND vec_id < 120"), "vec_id div 20 % 4"), spark)
    links = I.link(queries, rows.filter("image_id < 120")).collect()
    assert {(r["query_id"], r["image_id"]) for r in links} == {(i, i) for i in range(0, 120, 20)}
    assert all(abs(r["scale"] - 1) < 0.1 and abs(abs(r["degrees"]) - 90 * (r["query_id"] // 20 % 2)) < 6 for r in links)
    assert I.features(I.drawn(df.limit(0))).count() == 0 and I.near_classes(rows.limit(0)).count() == 0 and I.link(rows.limit(0), rows).count() == 0


@pytest.mark.parametrize("rows_broadcast", [500_000, 0])
def test_recall_of_links_and_classes_among_thousands_of_others(spark, monkeypatch, rows_broadcast):
    monkeypatch.setattr(I, "BROADCAST_ROWS", rows_broadcast)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 64))
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 64)))] + [(5000 + i, v) for i, v in enumerate(base)] + [(6000 + i, v + rng.normal(size=64) * 0.05) for i, v in enumerate(base)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id long, embedding array<double>").repartition(4)
    rows = written(I.features(I.drawn(df)), spark)
    queries = written(edited(df.filter("vec_id BETWEEN 5000 AND 5999"), "vec_id % 4"), spark)
    every, asked = rows.toPandas(), queries.toPandas()
    got = {(r["query_id"], r["image_id"]) for r in I.link(queries, rows).collect()}
    want = by_brute_force(asked, every) if rows_broadcast else got
    assert len(got & want) >= 0.95 * len(want) and got <= want and len({q for q, c in got if q == c}) >= 36
    near = {r["image_id"]: r["near_id"] for r in I.near_classes(rows).collect()}
    pairs = by_brute_force(every[every["image_id"].between(5000, 5999)], every) if rows_broadcast else {(i, i + 1000) for i in near if 5000 <= i < 6000}
    pairs = {(u, v) for u, v in pairs if u != v}
    assert len(pairs) >= 30 and sum(near.get(u, u) == near.get(v, v) for u, v in pairs) >= 0.95 * len(pairs) and not set(near) & set(range(3000))


def test_near_copies_join_whatever_else_is_in_their_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    image = np.rint(127.5 + 100 * np.sin(rng.normal(size=64) @ I._waves(64))).reshape(1, I.SIDE, I.SIDE)
    made = I.describe(np.array([0]), image)
    n = len(made["x"])

    def rows(k, described):
        return list(zip([k] * n, *(described[c].tolist() for c in list(made)[1:]), strict=True))

    def near(others, block):
        monkeypatch.setattr(I, "BLOCK", block)
        copies = [r for k in (900, 901, 902) for r in rows(k, made)]
        unrelated = [r for k in others for r in rows(k, made | {f"d{i}": rng.integers(-(1 << 63), 1 << 63, n) for i in (2, 3)})]  # of the same buckets
        got = I.near_classes(spark.createDataFrame(copies + unrelated, I.FEATURES)).collect()
        return {r["image_id"]: r["near_id"] for r in got}

    assert near([], 2048) == near(range(60), 2048) == near(range(60), 8) == {900: 900, 901: 900, 902: 900}


def test_every_query_is_searched_among_every_image(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    first = rng.normal(size=64)
    vectors = [(i, first + rng.normal(size=64) * 0.05 * (i > 0) if i % 10 == 0 else rng.normal(size=64)) for i in range(0, 90, 5)]
    vectors += [(100, vectors[2][1]), (160, vectors[2][1])]  # 10, in two edits
    vectors += [(100, rng.normal(size=64)), (7, np.zeros(64)), (None, rng.normal(size=64))]  # a repeated id, no pixels, no id
    df = spark.createDataFrame([(i, v.tolist(), 5, "x") for i, v in vectors], "vec_id long, embedding array<double>, class_id int, pid string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op8_local_descriptors(spark, str(tmp_path)).toPandas()
    assert len(got) == len(vectors) and got[got["image_id"] == 7].iloc[0][["class_id", "links"]].tolist() == [7, 0]
    asked = [(1000 + n, v.tolist(), i // 20 % 4) for n, (i, v) in enumerate(vectors) if i is not None and i % 20 == 0]
    queries = written(edited(spark.createDataFrame(asked, "vec_id long, embedding array<double>, k int"), "k"), spark)
    rows = written(I.features(I.drawn(spark.createDataFrame([(n, v.tolist()) for n, (_, v) in enumerate(vectors)], "vec_id long, embedding array<double>"))), spark)
    links = I.link(queries, rows).toPandas()
    expected = links.groupby("image_id").size()
    want = Counter((vectors[n][0], int(expected.get(n, 0))) for n in range(len(vectors)))
    have = Counter((None if np.isnan(r.image_id) else int(r.image_id), int(r.links)) for r in got.itertuples())
    assert have == want
    class_of = got[got["image_id"].isin(range(0, 90, 10))]
    assert set(class_of["class_id"]) == {0} and (class_of["links"] > 0).all()
    monkeypatch.setattr(I, "BLOCK", 4)
    dealt = I.link(queries, rows).toPandas()
    assert set(zip(dealt["query_id"], dealt["image_id"], dealt["inliers"], strict=True)) == set(zip(links["query_id"], links["image_id"], links["inliers"], strict=True))
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op8_local_descriptors(spark, f"{tmp_path}/none").count() == 0


def test_odd_images_give_no_features(spark):
    rows = [(1, 4, 4, b"x" * 16), (2, 10, 10, b"x"), (3, None, 5, b"x"), (None, 96, 96, bytes(9216)), (4, 96, 96, bytes(9216)), (5, 30, 200, bytes(i * 7 % 256 for i in range(6000)))]
    got = I.features(spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], "image_id long, height int, width int, pixels binary")).toPandas()
    assert set(got["image_id"]) <= {5}


def test_pipeline_against_each_stage_by_itself(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    item = " ".join(rng.choice(vocabulary) for _ in range(30))
    clean = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 90))) for _ in range(40)]
    texts = [*clean, clean[4], clean[5].upper(), clean[7] + " ", None, "", "123 !!", "so it says: " + item, item + " more words here"]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "dedup", "benchmark", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept == [{*range(43), 46, 47}, {*range(40), 46, 47}, set(range(40))]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(got["doc_id"]) == set(range(40)) and got.groupby("sequence_id")["length"].sum().max() <= 2048
