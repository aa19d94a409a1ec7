"""Columns of any name, and urls as they were given."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from turnloom.llm import decontaminate, simhash, warc

TEXT = "the cat sat on the mat and the dog ran over the hill with a red ball"


def test_documents_with_columns_of_any_name(spark):
    rows = [(1, TEXT, 0), (2, TEXT, 0), (3, "something else entirely that nobody has ever written before", 0), (None, TEXT, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x int")
    for name in ("_text_hash", "_keep_id", "_keep_hash", "kept1", "kept3", "kept_", "fp", "root", "doc_id_1"):
        got = simhash.deduplicate(docs.withColumnRenamed("x", name))
        assert got.columns == ["doc_id", "text", name] and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]


def test_the_pipeline_keeps_columns_of_any_name(spark):
    names = ["_text_hash", "_keep_id", "fp", "row", "a", "h", "kept1", "score", "lang_pred", "held_out", "item_id"]
    docs = spark.createDataFrame([(i, f"{TEXT} number {i} of the many", "en", "s", 9, *range(len(names))) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    spark.createDataFrame([(1, "an item of a benchmark that none of the documents holds")], "item_id long, text string").write.parquet(f"{(at := warc.new_path(spark, 'tables'))}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).columns == docs.columns


def test_blocks_of_items_leave_what_all_items_leave(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"once {w} sees {w} and {w} then {w} again and more") for i, w in enumerate("alpha beta gamma delta epsilon".split())], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{w} sees {w} and {w} then {w} again") for i, w in enumerate("alpha gamma delta".split())], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    got = decontaminate.decontaminate(docs, items)
    assert sorted(r.doc_id for r in got.collect()) == [1, 4] and got._jdf.queryExecution().toString().count("MapInArrow") <= 4


def test_urls_come_back_as_they_were_given(spark):
    urls = [None, "", " ", "http://x/a  b ", "http://x/%20b", "http://x/é\r\nX-Page-ID: 9", "\thttp://x", "http://x/plain?a=1:2"]
    pages = spark.createDataFrame([(i, u, f"<p>{i % 3}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = warc.read_warcs(warc.write_warcs(pages))
    assert {r.page_id: r.url for r in got.collect()} == dict(enumerate(urls))
    assert got.filter("record_type = 'response'").agg(F.count("*")).first()[0] == 3


def test_pages_are_read_in_time_proportional_to_their_length():
    import time

    from turnloom.llm.html_text import main_text

    for head, unit in (("", "<form>"), ("<i><div>" + "<b>" * 20_000, "</i>"), ("<p><button>" + "<b>" * 20_000, "<div></div>"), ("", "<div class=search>words "), ("", "<form>x<h2>")):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            main_text(head + unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 1, unit
