"""The clause grammar against its machines run one after another and against a plain reading of clauses; held-out accuracy."""

from __future__ import annotations

import random
from itertools import product
from math import log1p

import pytest
from pyspark.sql import functions as F

from turnloom.llm import toxicity as X

SCHEMA = "doc_id long, text string, lang string, toxic string, score double"
WORDS = "river stone yellow market window garden simple quiet autumn letter travel bridge".split()


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic documents hold insults of an invented stem, or a fixed word; clean ones hold words that only begin like the fixed one."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(WORDS, k=rng.randint(20, 200))
        toxic = i % 4 == 0
        for _ in range(rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "zork" + rng.choice(["el", "ung", "ito", "aba"])]) if toxic else rng.choice(["moroni", "quartz"]))
        docs.append((i, " ".join(w + rng.choice(["", "", "", ".", ","]) for w in words), "en", "x", 0.5))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(labelled):
    docs, labels = labelled
    model = X.learn(docs, labels)
    got = X.score(docs, model).collect()
    assert len(got) == 1500 and {r.held_out for r in got} == {True, False}
    assert all((r.predicted == 1) == (r.doc_id % 4 == 0) for r in got)
    assert X.weight(*model.states["zor"], model.toxic, model.clean) > X.LEAST  # the stem, whatever follows
    assert X.Reader(model.states, model.toxic, model.clean)._read("zorkxyz")[0] == X.INSULT
    assert X.Reader(model.states, model.toxic, model.clean)._read("moroni")[0] == X.OTHER


def test_labels_that_are_held_out_are_not_learnt(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert X.learn(docs, labels) == X.learn(docs, flipped)


def test_the_composed_machine_equals_its_parts():
    """Every sequence of up to five classes and a stop: a plain reading of the clause gives the same kind."""
    for symbols in product(range(7), repeat=5):
        state = X.START
        for s in symbols:
            state, out = X.TABLE[state][s]
            assert out is None
        state, kind = X.TABLE[state][X.STOP]
        found, negated, said, quoted, target, threat = 0, False, False, False, False, False
        for s in symbols:
            if s == X.INSULT:
                found = max(found, 1 if said or quoted else 2 if negated else 3)
            elif s == X.THREAT:
                threat |= not (said or quoted or negated)
            elif s == X.TARGET:
                target = True
            elif s == X.NEGATION:
                negated = True
            elif s == X.REPORT:
                said = True
            elif s == X.QUOTE:
                quoted = not quoted
        want = {3: "insult", 2: "negated", 1: "reported"}[found] + ("@" if target else "") if found else "none"
        assert kind == ("threat@" if threat and target and found < 3 else want), symbols


def test_clauses_are_weighed_whole():
    reader = X.Reader({"moron$": (300, 0), "mor": (300, 50)}, 1000, 9000)
    w = reader._read("moron")[1]
    kinds = dict(zip(X.KINDS[1:], range(1, 8), strict=True))
    for text, kind, weight in (
        ("You moron.", "insult@", w), ("MORON moron!", "insult", 2 * w), ("you are not a moron", "negated@", w), ("she said moron", "reported@", w), ("“such a moron” is what was read", "reported", w), ("I will kill you", "threat@", 1.0),
    ):
        got = reader.features(text)
        assert got[kinds[kind]] == pytest.approx(log1p(weight)), text
        assert sum(map(bool, got[1:8])) == 1
    # Quotation marks reach over clauses, a verb of saying does not; a document is not counted for itself.
    assert reader.features("“one. moron. two” he said. moron")[kinds["insult"]] == pytest.approx(log1p(w))
    assert reader.features("moron", 1)[kinds["insult"]] < reader.features("moron")[kinds["insult"]]


def test_edges(spark, labelled):
    docs, labels = labelled
    model = X.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, "en", "1", 0.0), (None, "moron", None, None, None), (3, "", "", "", 0.0), (3, "", "", "", 0.0), (4, "word " * 200_000 + "moron", "en", "", 0.0), (5, "。\x00 !!", "", "", 0.0)], SCHEMA)
    got = X.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False] and [r.predicted for r in got if r.doc_id is None] == [1]
    for d, l in ((docs.limit(0), labels), (docs, labels.limit(0)), (docs, labels.filter("toxic = 1")), (docs.withColumn("text", F.lit(None).cast("string")), labels)):
        got = X.score(d, X.learn(d, l))
        assert got.count() == d.count() and got.filter("predicted = 1 AND held_out IS NULL").count() == 0
