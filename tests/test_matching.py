"""Patterns in texts, active branches and bundles against plain readings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from turnloom.operators import matching
from turnloom.operators.refs import active_branch
from turnloom.shared import new_path
from turnloom.sources import bundles


def test_patterns_in_texts_in_blocks_too(spark, monkeypatch):
    rng = random.Random(1)
    patterns = [(rng.randint(0, 3), rng.choice(["Report 1", "port", "a", "", "é b", "zz", None, "Report 12"]), i) for i in range(60)]
    texts = [(rng.randint(0, 4), rng.choice(["Report 12.txt", "no", "é b a", "", None, "zzz Report 1"]), i) for i in range(200)]
    want = sorted((p, t) for k, a, p in patterns for q, b, t in texts if k == q and a is not None and b is not None and a in b)
    for most in (10_000, 7):
        monkeypatch.setattr(matching, "TEXTS", most)
        monkeypatch.setattr(matching, "PATTERNS", most)
        got = matching.containing(spark.createDataFrame(patterns, "k int, a string, p int"), spark.createDataFrame(texts, "k int, b string, t int"), ["k"], "a", "b")
        assert sorted((r.p.p, r.t.t) for r in got.collect()) == want


def test_ten_thousand_links_and_turns_of_one_conversation(spark):
    links = spark.range(10_000).select(F.lit(1).alias("c"), F.concat(F.lit("Label "), "id", F.lit(".")).alias("label"), "id")
    turns = spark.range(10_000).select(F.lit(1).alias("c"), F.concat(F.lit("said Label "), "id", F.lit(". and more")).alias("text"), F.col("id").alias("turn"))
    got = matching.containing(links, turns, ["c"], "label", "text")
    assert got.filter("p.id = t.turn").count() == got.count() == 10_000


def test_active_branch_of_long_chains_and_cycles(spark):
    long = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.concat(F.lit("n"), "id").alias("node_id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"), F.lit("n19999").alias("current_node"))
    rows = [(2, "a", "c", "c"), (2, "b", "a", "c"), (2, "c", "b", "c"), (2, "side", "a", "c"), (3, "y", None, "gone"), (3, "x", "y", "gone"), (4, "q", "q", "q"), (5, "k", "missing", "k"), (5, "l", "k", None)]
    got = active_branch(long.unionByName(spark.createDataFrame(rows, "conv_id long, node_id string, parent_id string, current_node string")))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert got.filter("conv_id = 1 AND node_id = concat('n', position)").count() == 20_000
    found = {}
    for r in got.filter("conv_id > 1").orderBy("conv_id", "position").collect():
        found.setdefault(r.conv_id, []).append(r.node_id)
    assert found == {2: ["a", "b", "c"], 3: ["x", "y"], 4: ["q"], 5: ["k"]}
    assert active_branch(long.limit(0)).count() == 0


def test_bundles_come_back_and_only_what_was_committed(spark, monkeypatch):
    bundles.register(spark)
    rows = [(i % 7, f"e{i}", bytes([i % 256]) * (i * 37 % 900)) for i in range(300)] + [(None, "none", None)]
    df = spark.createDataFrame(rows, "conv_id long, name string, bytes binary")
    df.repartition(3).write.format("turnloom_bundles").mode("append").save(to := new_path(spark, "bundles"))
    df.limit(5).write.format("turnloom_bundles").mode("append").save(to)
    bundles.BundleWriter(to).write(iter(df.limit(9).toArrow().to_batches()))  # an attempt that is not committed
    got = spark.read.format("turnloom_bundles").load(to)
    want = sorted([(str(c), n, b or b"") for c, n, b in [*rows, *rows[:5]]])
    assert sorted((str(r.conv_id), r.name, bytes(r.bytes)) for r in got.collect()) == want
    assert got.filter(F.sha2("bytes", 256) != F.col("sha256")).count() == 0
    some = got.filter("conv_id = 3 AND size > 100")
    assert sorted((str(r.conv_id), r.name, bytes(r.bytes)) for r in some.collect()) == [x for x in want if x[0] == "3" and len(x[2]) > 100]
    reader = bundles.BundleReader(to)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    assert list(reader.pushFilters([EqualTo(("conv_id",), 3), IsNotNull(("conv_id",))])) == [IsNotNull(("conv_id",))]
    assert {e[0] for p in reader.partitions() for e in p.entries} == {3}
    assert spark.read.format("turnloom_bundles").load(new_path(spark, "nothing")).count() == 0
