"""Which of many texts hold which of many patterns, within a key: an automaton over the patterns instead of a join of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS, PATTERNS = 4_096, 20_000  # of a key that meet in one group; a key with more is dealt out in blocks
BROADCAST_ROWS = 500_000  # of large keys; beyond that they are shuffled


def _large(rows: DataFrame, key: list[str], most: int, name: str) -> DataFrame:
    """Keys with more than `most` rows, and how many blocks they take. There is at most one for every `most` rows."""
    return rows.groupBy(*key).agg(F.ceil(F.count("*") / most).cast("int").alias(name)).filter(F.col(name) > 1)


def containing(patterns: DataFrame, texts: DataFrame, key: list[str], pattern: str, text: str) -> DataFrame:
    """(p, t): structs of the other columns of a pattern and of a text of its key that contains it, once for each pair of rows.

    Nulls contain nothing and are in nothing; an empty pattern is in every text of its key. Each task builds one automaton for
    each group of patterns and reads each text once, so the cost is that of the texts, the patterns and the matches.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    p_cols, t_cols = ([c for c in d.columns if c not in (*key, x)] for d, x in ((patterns, pattern), (texts, text)))
    left, right = patterns.filter(F.col(pattern).isNotNull()), texts.filter(F.col(text).isNotNull())
    large = _large(left, key, PATTERNS, "pn").join(_large(right, key, TEXTS, "tn"), key, "full")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    n = {k: F.coalesce(k, F.lit(1)) for k in ("pn", "tn")}

    def dealt(rows: DataFrame, s: str, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if c not in key and not t.startswith("map")]), n[own])
        got = rows.join(large, key, "left").withColumn(f"_{own}", mine).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), n[other] - 1)))
        return got.select(*key, F.col("_pn").cast("int").alias("_pn"), F.col("_tn").cast("int").alias("_tn"), F.lit(side).alias("_side"), F.col(s).alias("_s"), F.struct(*(p_cols if side == 0 else t_cols)).alias("p" if side == 0 else "t"))

    both = dealt(left, pattern, "pn", "tn", 0).unionByName(dealt(right, text, "tn", "pn", 1), allowMissingColumns=True)
    group = [*key, "_pn", "_tn"]
    both = both.select(*group, "_side", "_s", "p", "t").repartition(*group).sortWithinPartitions(*group, "_side")
    schema = StructType([both.schema["p"], both.schema["t"]])
    arrow, width = to_arrow_schema(schema), len(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        now, words, machine, out = None, {}, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:width] != now:
                    now, words, machine = row[:width], {}, None
                side, s, p, t = row[width:]
                if side == 0:
                    words.setdefault(s, []).append(p)
                    continue
                if not words:
                    continue
                if machine is None:
                    machine = ahocorasick.Automaton()
                    for w in words:
                        if w:
                            machine.add_word(w, w)
                    machine.make_automaton()
                found = {w for _, w in machine.iter(s)} if len(machine) else set()
                if "" in words:
                    found.add("")
                out += [{"p": x, "t": t} for w in found for x in words[w]]
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return both.mapInArrow(run, schema)
