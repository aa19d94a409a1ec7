"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five machines make the grammar. The insult acceptor reads a word's letters; its states are word
beginnings and whole words, and the weight of a word is that of the deepest state it reaches: the
log odds of toxic documents, learned from labels, less two standard errors. The others are small
transducers over the classes of a clause's words: negation, reported speech (a verb of saying, or
quotation marks), threats and targets. They are composed once, and the composed machine reads each
clause and says at its end what it matched: an insult that stands, is negated or is reported, with
a target or without one, or a threat to a target. Matched clauses, not words, are scored: a clause
weighs what its insults weigh. Logistic regression over the weights of the kinds of clauses gives the score.

Learning takes at most SAMPLE labelled documents of each class, those of least hash, and of word
beginnings the TERMS that tell most; scoring takes all of every text. In learning, each document is
left out of the counts that weigh its own words. A null text is empty. Repeated rows are scored alike; in learning, an id that several
rows bear counts once, with the greatest of its texts, and is toxic if any of its labels says so. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf, log, log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialise, small_batches

SAMPLE = 20_000  # labelled documents of a class that the model learns from
TERMS = 40_000  # states of the acceptor that weigh something, and as many below them that do not
SHORTEST, LONGEST, END = 3, 14, "$"  # letters of a beginning; a whole word ends in END
SUPPORT, LEAST = 3, 1.0  # toxic documents that a state needs, and the weight from which a word is an insult
THRESHOLD = 0.3

#: Words of the four languages' grammars.
THREATS = frozenset("kill murder hurt destroy attack shoot töten umbringen verletzen vernichten erschießen tuer détruire blesser abattre matar destruir herir disparar".split())
TARGETS = frozenset("you your yours u they them she he her him du dich dir ihr euch sie ihn tu toi te vous ils elles tú ti usted ustedes ellos ellas vosotros".split())
NEGATIONS = frozenset("not never none cannot don't isn't aren't nicht kein keine keinen nie niemals jamais aucun aucune pas nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says wrote writes told claimed quoted sagte sagt schrieb behauptete zitierte dit disait écrit affirmait citait dijo dice escribió afirmó citó".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, STOP = range(8)
KINDS = ("none", "insult", "insult@", "negated", "negated@", "reported", "reported@", "threat@")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:…\n]+|[\"“”„«»]")


@dataclass(frozen=True)
class Transducer:
    """start; step(state, symbol) -> (state, symbol out). What it does not know it hands on."""

    start: object
    arcs: dict[tuple, tuple]

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def composed(machines: list[Transducer], symbols: range) -> tuple[object, dict[tuple, tuple]]:
    """The machines one after another as a single one: its start and its arcs, of all states that can be reached."""
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            out, to = symbol, []
            for m, s in zip(machines, state, strict=True):
                s, out = m.step(s, out)
                to.append(s)
            arcs[state, symbol] = (tuple(to), out)
            if tuple(to) not in seen:
                seen.add(tuple(to))
                todo.append(tuple(to))
    return start, arcs


def grammar() -> tuple[int, dict[int, list[tuple[int, str | None]]]]:
    """The composed machine over word classes, its states numbered: state -> for each class, the next state and the kind that a STOP gives."""
    negated, reported = ("i", "negated"), ("i", "reported")
    negation = Transducer(False, {(False, NEGATION): (True, OTHER), (True, NEGATION): (True, OTHER), (True, INSULT): (True, negated), (True, THREAT): (True, OTHER), (True, STOP): (False, STOP)})
    # Said by a verb up to the clause's end; quoted up to the next mark, over clauses.
    told = {}
    for quoted in (False, True):
        for said in (False, True):
            told[(quoted, said), REPORT] = ((quoted, True), OTHER)
            told[(quoted, said), QUOTE] = ((not quoted, said), OTHER)
            told[(quoted, said), STOP] = ((quoted, False), STOP)
            if quoted or said:
                told[(quoted, said), INSULT] = told[(quoted, said), negated] = ((quoted, said), reported)
                told[(quoted, said), THREAT] = ((quoted, said), OTHER)
    report = Transducer((False, False), told)
    threat = Transducer(False, {(False, THREAT): (True, OTHER), (True, THREAT): (True, OTHER), (True, STOP): (False, ("stop", "threat"))})
    # The strongest insult of the clause, and whether it names a target, before or after.
    rank = {INSULT: 3, negated: 2, reported: 1}
    name = {3: "insult", 2: "negated", 1: "reported"}
    ends = {}
    for found in range(4):
        for target in (False, True):
            for symbol, r in rank.items():
                ends[(found, target), symbol] = ((max(found, r), target), OTHER)
            ends[(found, target), TARGET] = ((found, True), OTHER)
            kind = name[found] + ("@" if target else "") if found else "none"
            ends[(found, target), STOP] = ((0, False), kind)
            ends[(found, target), ("stop", "threat")] = ((0, False), kind if found == 3 else "threat@" if target else kind)
    start, arcs = composed([negation, report, threat, Transducer((0, False), ends)], range(8))
    number = {s: i for i, s in enumerate(dict.fromkeys([start, *(s for s, _ in arcs)]))}
    table: dict[int, list] = {i: [None] * 8 for i in number.values()}
    for (s, symbol), (to, out) in arcs.items():
        table[number[s]][symbol] = (number[to], out if symbol == STOP else None)
    return number[start], table


START, TABLE = grammar()


@dataclass(frozen=True)
class Model:
    """states: beginning -> (toxic, clean) documents with such a word; totals of the sample; coefficients of `features`."""

    states: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    coefficients: tuple[float, ...]


def weight(t: int, c: int, toxic: int, clean: int) -> float:
    """Log odds of a state's toxic documents, less two standard errors."""
    return log((t + 0.5) / (toxic + 1)) - log((c + 0.5) / (clean + 1)) - 2 * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


class Reader:
    """The insult acceptor and the composed machine of a model, at work on texts."""

    def __init__(self, states: dict[str, tuple[int, int]], toxic: int, clean: int, most: int = 200_000):
        self.states, self.toxic, self.clean, self.most = states, toxic, clean, most
        self.known: dict[str, tuple[int, float, tuple | None]] = {}

    def _read(self, token: str) -> tuple[int, float, tuple | None]:
        """(class, weight, counts) of a token."""
        if not token[0].isalpha():
            return (QUOTE if token[0] in "\"“”„«»" else STOP), 0.0, None
        counts = None
        whole = token + END
        for k in range(SHORTEST, min(len(whole), LONGEST) + 1):
            counts = self.states.get(whole[:k], counts)
        w = weight(*counts, self.toxic, self.clean) if counts else -inf
        if w >= LEAST:
            return INSULT, w, counts
        plain = token.replace("’", "'")
        kind = THREAT if plain in THREATS else NEGATION if plain in NEGATIONS else REPORT if plain in REPORTS else TARGET if plain in TARGETS else OTHER
        return kind, 0.0, None

    def features(self, text: str | None, label: int | None = None) -> list[float]:
        """By kind, the weight of its clauses; the heaviest clause; the weight that stands, for each hundred words. With a label, the document itself is not counted."""
        known, read = self.known, self._read
        if len(known) > self.most:
            known = self.known = {}
        total, heaviest, words = Counter(), 0.0, 0
        state, clause, found = START, 0.0, False
        for token in TOKEN.findall((text or "").lower()):
            hit = known.get(token)
            if hit is None:
                hit = known[token] = read(token)
            kind, w, counts = hit
            words += 1
            if kind == OTHER or (kind == STOP and not found):
                continue
            if kind == INSULT and label is not None:
                w = weight(max(counts[0] - label, 0), max(counts[1] - (1 - label), 0), self.toxic - label, self.clean - (1 - label))
                if w < LEAST:
                    continue
            found = True
            state, out = TABLE[state][kind]
            clause += w
            if kind == STOP:
                found = False
                if out != "none":
                    total[out] += max(clause, 1.0)
                    heaviest = max(heaviest, clause if out[0] == "i" else 0)
                clause = 0.0
        state, out = TABLE[state][STOP]
        if out != "none":
            total[out] += max(clause, 1.0)
            heaviest = max(heaviest, clause if out[0] == "i" else 0)
        stands = total["insult"] + total["insult@"]
        return [1.0, *(log1p(total[k]) for k in KINDS[1:]), heaviest / 5, log1p(100 * stands / max(words, 1))]


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method; all but the first coefficient are drawn to zero."""
    b = np.zeros(x.shape[1])
    pull = np.full(len(b), ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (weights * (y - p)) - pull * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def beginnings(text: str | None) -> set[str]:
    out = set()
    for word in {w for w in TOKEN.findall((text or "").lower()) if w[0].isalpha()}:
        whole = word + END
        out.update(whole[:k] for k in range(SHORTEST, min(len(whole), LONGEST) + 1))
    return out


def _counted(sample: DataFrame) -> DataFrame:
    """(state, t, c): in how many toxic and clean documents of the sample a word begins so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[toxic].update(beginnings(text))
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield told(counts)
                counts = (Counter(), Counter())
        yield told(counts)

    def told(counts) -> pa.RecordBatch:
        states = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(states, pa.string()), *[pa.array([counts[k][s] for s in states], pa.int64()) for k in (1, 0)]], names=["state", "t", "c"])

    return sample.select("text", "toxic").mapInArrow(run, "state string, t long, c long").groupBy("state").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def _most(rows: DataFrame, by: str, most: int) -> list:
    """Of rows the greatest by a number, as many steps of a quarter of it as hold no more than `most`."""
    steps = rows.groupBy(F.floor(F.col(by) * 4).alias("s")).count().collect()  # a row per step
    total, least = 0, None
    for r in sorted(steps, key=lambda r: -r["s"]):
        total += r["count"]
        if total > most:
            break
        least = r["s"] / 4
    return [] if least is None else rows.filter(F.col(by) >= least).collect()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """The model of the labelled documents that are not held out. labels: doc_id, toxic (0 or 1; others are no labels)."""
    small_batches(docs.sparkSession, 500)
    told = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in told.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return Model({}, 0, 0, ())
    # A document is in the sample if its hash is below the share that gives about `sample` of its class.
    share = F.when(F.col("toxic") == 1, min(1.0, sample / size[1])).otherwise(min(1.0, sample / size[0]))
    chosen = told.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)) < share)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = materialise(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")), "labelled")
    counted = materialise(_counted(rows), "beginnings")
    got = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = got.get(1, 0), got.get(0, 0)
    if not toxic or not clean:
        return Model({}, 0, 0, ())
    se = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    weighed = counted.withColumn("weight", F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1)) - 2 * se)
    heavy = _most(weighed.filter((F.col("t") >= SUPPORT) & (F.col("weight") >= LEAST)), "weight", terms)
    states = {r["state"]: (r["t"], r["c"]) for r in heavy}
    # Below a heavy beginning, those that do not weigh: words that only begin like an insult.
    if states:
        spark = docs.sparkSession
        above = F.broadcast(spark.createDataFrame([(s,) for s in states if not s.endswith(END)] or [("",)], "above string"))
        light = weighed.filter((F.col("t") + F.col("c") >= 2 * SUPPORT) & (F.col("weight") < LEAST) & (F.length("state") > SHORTEST)).withColumn("sure", F.log("c"))
        light = light.withColumn("above", F.explode(F.transform(F.sequence(F.lit(SHORTEST), F.length("state") - 1), lambda n: F.substring("state", F.lit(1), n)))).join(above, "above", "left_semi").dropDuplicates(["state"])
        states |= {r["state"]: (r["t"], r["c"]) for r in _most(light.filter("c > 0"), "sure", terms)}

    def run(b: pa.RecordBatch) -> dict:
        reader = Reader(states, toxic, clean)
        return {"x": [reader.features(t, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], "toxic": b.column(1)}

    fitted = by_batch(rows.select("text", "toxic"), run, "x array<double>, toxic int").collect()  # a dozen numbers for each document of the sample
    x, y = np.array([r["x"] for r in fitted]), np.array([r["toxic"] for r in fitted], float)
    weights = np.where(y == 1, size[1] / toxic, size[0] / clean)
    return Model(states, toxic, clean, tuple(_logistic(x, y, weights / weights.mean()).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its whole text."""
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * TERMS states

    def run(b: pa.RecordBatch) -> dict:
        m = shared.value
        if not m.coefficients:
            scores = [0.0] * b.num_rows
        else:
            reader = _reader(m)
            z = np.array([reader.features(t) for t in b.column(1).to_pylist()]) @ np.array(m.coefficients)
            scores = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
        return {"doc_id": b.column(0), "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    rows = by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run, "doc_id long, score double, predicted int")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


_KEPT: dict[int, Reader] = {}


def _reader(model: Model) -> Reader:
    """A worker keeps the reader, and the words it has read, of the model it used last."""
    if id(model) not in _KEPT:
        _KEPT.clear()
        _KEPT[id(model)] = Reader(model.states, model.toxic, model.clean)
    return _KEPT[id(model)]
