"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are frequencies of hashed byte 1- to 4-grams of the whole lower-cased text, signs and
digits as spaces. Both steps vote among one-versus-one linear SVMs, fitted by dual coordinate
descent on a bounded sample of labelled rows (PER_LANGUAGE documents of each language, whole).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, small_batches

PER_LANGUAGE, BITS, SCALE = 500, 15, 40.0
UNKNOWN = "und"

#: Family of a language code. A code that is not here is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def slots(text: str):
    """Feature numbers of all n-grams of the text, in pieces of bounded size that overlap so that none is lost."""
    b = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    for at in range(0, len(b), _PIECE):
        a = np.frombuffer(b[max(0, at - 3) : at + _PIECE], np.uint8).astype(np.uint32)
        new, code, out = min(at, 3), np.zeros(len(a), np.uint32), []
        for n in range(1, 5):
            code = (code[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :]
            some = code[max(0, new - n + 1) :]
            out.append(((some + np.uint32(n * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
            code = code[: len(a) - n]
        yield np.concatenate(out)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, their scaled frequencies) of a text."""
    counts = np.zeros(1 << BITS, np.int64)
    for s in slots(text):
        counts += np.bincount(s, minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (SCALE * counts[at] / max(1, counts.sum())).astype(np.float32)


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, epochs: int = 12) -> tuple[np.ndarray, float, float]:
    """(weights, bias, steepness of the logistic curve) of a linear SVM with hinge loss; y is -1 or 1, classes weigh alike."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    most = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + bias) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            if a != alpha[i]:
                w[at] += (d := (a - alpha[i]) * y[i]) * v
                bias += d
                alpha[i] = a
    margins = np.array([y[i] * (w[at] @ v + bias) for i, (at, v) in enumerate(rows)])
    a = 1.0
    for _ in range(50):  # the logistic curve through 1/2 at margin 0 that fits the sample best
        p = 1 / (1 + np.exp(-np.clip(a * margins, -30, 30)))
        a = min(max(a + ((1 - p) @ margins - 0.01 * a) / ((p * (1 - p)) @ margins**2 + 0.01), 0.1), 20.0)
    return w, bias, a


class Model:
    """Pairs of classes with their SVMs: among families, and among the languages of each family."""

    def __init__(self, languages: list[str], families: dict[str, str]):
        self.languages = sorted(languages)
        self.family = {x: families.get(x, x) for x in self.languages}
        self.groups = {"": sorted(set(self.family.values()))} | {f"in {f}": [x for x in self.languages if self.family[x] == f] for f in set(self.family.values())}
        self.pairs = [(g, *p) for g, of in sorted(self.groups.items()) for p in combinations(of, 2)]
        self.weights, self.bias, self.steep = np.zeros((1 << BITS, len(self.pairs)), np.float32), np.zeros(len(self.pairs)), np.ones(len(self.pairs))

    def fit(self, sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
        for k, (group, a, b) in enumerate(self.pairs):
            of = (lambda x: self.family[x]) if not group else (lambda x: x)
            some = [(at, v, 1 if of(x) == a else -1) for x, at, v in sample if of(x) in (a, b)]
            self.weights[:, k], self.bias[k], self.steep[k] = fit_svm([s[:2] for s in some], np.array([s[2] for s in some]))
        return self

    def _choose(self, group: str, margins: np.ndarray) -> tuple[str, float]:
        """Most votes, then the greatest sum of margins, then the first name; its least chance in a pair."""
        of = self.groups[group]
        tally = {x: [0, 0.0, 1.0] for x in of}
        for k, (g, a, b) in enumerate(self.pairs):
            if g == group:
                p = 1 / (1 + np.exp(-np.clip(self.steep[k] * margins[k], -30, 30)))
                for x, m, q in ((a, margins[k], p), (b, -margins[k], 1 - p)):
                    tally[x] = [tally[x][0] + (m > 0), tally[x][1] + m, min(tally[x][2], q)]
        best = min(of, key=lambda x: (-tally[x][0], -tally[x][1], x))
        return best, float(tally[best][2])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.pairs)), 0
        for s in slots(text):
            total += self.weights[s].sum(0, dtype=np.float64)
            n += len(s)
        margins = SCALE * total / max(1, n) + self.bias
        family, p = self._choose("", margins)
        language, q = self._choose(f"in {family}", margins)
        return language, min(1.0, max(0.0, p * q))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", families: dict[str, str] | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows whose crc32 of the id as text, mod 4, is not 2.

    Of each language, a fraction by a hash of the id that gives about `per_language` rows; rows
    without text, letters, label or id teach nothing.
    """
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(label).alias("l"), F.col(text).alias("t")).filter("l IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL AND crc32(CAST(k AS BINARY)) % 4 <> 2")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}  # a row per language
    if not counts:
        return Model([], FAMILIES)
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, float(min(1.0, per_language / n)))])
    chosen = rows.filter((F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1_000_000)) / 1e6 < share[F.col("l")]))

    def run(b: pa.RecordBatch) -> dict:
        made = [(l, *features(t)) for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
        return {"l": [m[0] for m in made], "at": [m[1].astype("<i4").tobytes() for m in made], "v": [m[2].astype("<f4").tobytes() for m in made]}

    got = by_batch(chosen.select("l", "t"), run, "l string, at binary, v binary").collect()  # about per_language rows a language
    sample = sorted((r["l"], bytes(r["at"]), bytes(r["v"])) for r in got)
    return Model(sorted({s[0] for s in sample}), FAMILIES if families is None else families).fit([(l, np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(np.float64)) for l, a, v in sample])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text alone.

    A text that is null or has no letter is `und` at score 0, and so is every text if no language
    was learnt. Repeated rows each come out. An empty table gives no rows.
    """
    small_batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of languages

    def run(b: pa.RecordBatch) -> dict:
        made = [shared.value.predict(t) for t in b.column(2).to_pylist()]
        return {"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return by_batch(docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("t")), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.0) -> DataFrame:
    """`docs` without the rows of no language (null text, no letter) or a score under `least`; no row moves.

    A model that has learnt no language rejects only texts without a letter. An empty table gives no rows.
    """
    small_batches(docs.sparkSession, 500)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for b in batches:
            texts, known = b.column(at).to_pylist(), shared.value
            found = [known.predict(t) for t in texts] if known.languages else [("", least) if has_letter(t) else (UNKNOWN, 0.0) for t in texts]
            yield b.filter(pa.array([x != UNKNOWN and s >= least for x, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
