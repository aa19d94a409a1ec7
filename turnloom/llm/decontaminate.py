"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit check.

Texts and items are sequences of lower-case words (runs of letters and digits). An item of m words
is in a text if some span of words is within t = floor(0.2 m) word edits of it.

Which windows of m words are embedded: within t edits, a span keeps at least m - w + 1 - wt of the
item's w-word shingles, and each lies within t words of the span's own alignment. Windows that
keep fewer cannot match, so only windows aligned by a kept shingle of a text that keeps enough are
embedded; this drops none that matches. w is three, or less for items so short that the edits
allowed may leave none of three words: two for items of two and five, one for those of one word. Each repetition walks item and window by the same random
bits, which maps edit to Hamming distance, and samples positions of the walk; windows that agree
with the item in all sampled positions of some repetition go on to the exact check.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, materialise, small_batches

SIMILARITY, SAMPLED, REPEATS, WIDTH = 0.8, 3, 48, 3
BLOCK_BYTES = 32 << 20  # items are taken in blocks of about this size, a pass over the texts for each

_TO_SPACE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_UNICODE_SIGNS = re.compile(rb"\xe2[\x80\x81].|\xc2[\x80-\xbf]|\xe3\x80[\x80-\xbf]", re.S)


def words(text: str | None) -> list[bytes]:
    """Lower-case runs of letters and digits; ASCII signs and the Unicode blocks of Latin-1 and general signs part them."""
    b = (text or "").lower().encode()
    if not b.isascii():
        b = _UNICODE_SIGNS.sub(b" ", b)
    return b.translate(_TO_SPACE).split()


def edits_allowed(m: int, similarity: float = SIMILARITY) -> int:
    """Of an item of m words: one edit from five words on, two from ten, and so on."""
    return int(m * (1 - similarity) + 1e-9)


def kept_shingles(m: int, most: int) -> tuple[int, int]:
    """(words of a shingle, how many of the item's shingles a span within `most` edits keeps at least)."""
    return next((w, n) for w in range(WIDTH, 0, -1) if (n := m - w + 1 - w * most) > 0)


def best_span(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the span of `text` nearest to `item`, the first of the shortest; None beyond `most` edits."""
    row = [(i, 0) for i in range(len(item) + 1)]  # (edits, begin) of item[:i] against spans that end here
    best = None
    for end in range(1, len(text) + 1):
        new, x = [(0, end)], text[end - 1]
        for i, y in enumerate(item, 1):
            a, b, c = row[i - 1], row[i], new[i - 1]
            new.append(min((a[0] + (x != y), a[1]), (b[0] + 1, b[1]), (c[0] + 1, c[1]), key=lambda z: (z[0], -z[1])))
        row = new
        if row[-1][0] <= most and (best is None or row[-1][0] < best[0]):
            best = (row[-1][0], row[-1][1], end)
            if not best[0]:
                break
    return best


class Seeds:
    """The shingles of `width` words of some items, ready to be looked up."""

    def __init__(self, width: int, base: int, grams: dict[tuple, list[tuple[int, int]]]):
        self.width, self.base = width, base
        codes = {self.code(np.array(g)[:, None])[0]: at for g, at in grams.items()}
        self.codes = np.array(sorted(codes), np.uint64)
        self.sources = [codes[c] for c in self.codes.tolist()]  # (item, offset in it) of each
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.codes & np.uint64((1 << 20) - 1)] = True

    def code(self, grams: np.ndarray) -> np.ndarray:
        x = np.zeros(grams.shape[1], np.uint64)
        for g in grams:
            x = x * np.uint64(self.base) + g.astype(np.uint64)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)  # one to one while base ** 3 < 2 ** 64

    def places(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in `doc` a shingle of an item is, which one)."""
        known = doc > 0
        n = len(doc) - self.width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.flatnonzero(np.logical_and.reduce([known[i : i + n] for i in range(self.width)]))
        code = self.code(np.stack([doc[near + i] for i in range(self.width)]))
        hit = self.sieve[code & np.uint64((1 << 20) - 1)]
        near, code = near[hit], code[hit]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        return near[hit], at[hit]


class Items:
    """A block of items, ready to be searched for in texts."""

    def __init__(self, items: list[tuple], similarity: float = SIMILARITY):
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.items, self.most, self.need = [], [], [], []
        grams: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for key, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words(text)]
            if not w:
                continue
            k = len(self.items)
            self.ids.append(key)
            self.items.append(np.array(w, np.int64))
            self.most.append(edits_allowed(len(w), similarity))
            width, need = kept_shingles(len(w), self.most[-1])
            self.need.append(need)
            for o in range(len(w) - width + 1):
                grams[width][tuple(w[o : o + width])].append((k, o))
        self.seeds = [Seeds(width, len(self.vocabulary) + 1, of) for width, of in sorted(grams.items())]
        self.walks: dict[int, tuple] = {}
        self.signatures: dict[int, np.ndarray] = {}

    def _signatures(self, windows: np.ndarray) -> np.ndarray:
        """Sampled positions of the walks of each window: repetitions x windows x SAMPLED."""
        n, m = windows.shape
        if m not in self.walks:
            rng = np.random.default_rng(m)
            at = np.sort(np.stack([rng.choice(2 * m, min(SAMPLED, 2 * m), replace=False) for _ in range(REPEATS)]), axis=1)
            self.walks[m] = at, rng.integers(1, 1 << 62, (2 * m, REPEATS), dtype=np.int64) | 1
        at, mult = self.walks[m]
        padded = np.concatenate([windows, np.full((n, 1), -1)], axis=1)
        place, out = np.zeros((REPEATS, n), np.int64), np.empty((REPEATS, n, at.shape[1]), np.int64)
        columns = np.arange(n)[None, :]
        for j in range(int(at.max()) + 1):
            now = padded[columns, place]
            r, k = np.nonzero(at == j)
            out[r, :, k] = now[r]
            step = ((now + 7) * mult[j][:, None] >> 40) & 1
            place = np.minimum(place + step, m)
        return out

    def find(self, text: str | None) -> list[tuple]:
        """(item id, edits, words of the item, begin and end of the nearest span in words), a row for each item found."""
        get = self.vocabulary.get
        doc, out = np.array([get(x, 0) for x in words(text)], np.int64), []
        for seeds in self.seeds:
            near, at = seeds.places(doc)
            places: dict[int, list] = defaultdict(list)
            for g in np.unique(at).tolist():
                for k, o in seeds.sources[g]:
                    places[k].append((o, g))
            for k, of in places.items():
                if len(of) >= self.need[k]:
                    pos = [near[at == g] for _, g in of]
                    begins = np.concatenate([p - o for (o, _), p in zip(of, pos, strict=True)])
                    offsets = np.concatenate([np.full(len(p), o) for (o, _), p in zip(of, pos, strict=True)])
                    if found := self._nearest(k, doc, self._crowded(begins, offsets, self.need[k], self.most[k])):
                        out.append(found)
        return out

    def _nearest(self, k: int, doc: np.ndarray, begins: np.ndarray) -> tuple | None:
        """The nearest span of item k among the windows of `doc` that begin there and agree with it in some repetition."""
        item, most, found = self.items[k], self.most[k], None
        m = len(item)
        for lo in range(0, len(begins), 4096):
            some = begins[lo : lo + 4096]
            windows = np.pad(doc, (m, m))[np.clip(some + m, 0, len(doc) + m)[:, None] + np.arange(m)]
            if k not in self.signatures:
                self.signatures[k] = self._signatures(item[None, :])
            like = some[(self._signatures(windows) == self.signatures[k]).all(2).any(0)]
            for b, e in self._spans(like, m, most, len(doc)):
                if (x := best_span(item.tolist(), doc[b:e].tolist(), most)) and (found is None or x[0] < found[1]):
                    found = (self.ids[k], x[0], m, b + x[1], b + x[2])
                if found and not found[1]:
                    return found
        return found

    @staticmethod
    def _crowded(begins: np.ndarray, offsets: np.ndarray, need: int, most: int) -> np.ndarray:
        """The alignments with `need` different shingles within `most` words of them."""
        order = np.argsort(begins, kind="stable")
        begins, offsets = begins[order], offsets[order]
        starts = np.unique(begins)
        if need == 1:
            return starts
        lo, hi = np.searchsorted(begins, starts - most), np.searchsorted(begins, starts + most, "right")
        ok = hi - lo >= need
        return np.array([s for s, i, j in zip(starts[ok].tolist(), lo[ok], hi[ok], strict=True) if len(np.unique(offsets[i:j])) >= need], np.int64)

    @staticmethod
    def _spans(begins: np.ndarray, m: int, most: int, n: int):
        """Stretches of the text that hold the windows and `most` words around them, those that touch as one."""
        at = None
        for b in begins.tolist():
            b, e = max(0, b - 2 * most), min(n, b + m + 2 * most)
            if at and b <= at[1]:
                at[1] = max(at[1], e)
            else:
                if at:
                    yield at
                at = [b, e]
        if at:
            yield at


def blocks(items: DataFrame, key: str, text: str):
    """The items in blocks of a bounded size, each as a list."""
    items = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    for b in range(n):
        yield [(r["k"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b).distinct().orderBy("k", "t").collect()]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, edits, item_words, begin_word, end_word, similarity: a row for each text and item found in it.

    Null and empty texts and items match nothing. At a similarity of 0.8, items under five words
    must occur without an edit, as one edit is more than a fifth of them. Repeated rows each come out.
    """
    small_batches(docs.sparkSession, 500)
    out = None
    schema = "doc_id long, item_id long, edits int, item_words int, begin_word long, end_word long"
    for block in blocks(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES
        ready: list[Items] = []

        def run(b: pa.RecordBatch, shared=shared, ready=ready) -> dict:
            if not ready:
                ready.append(Items(shared.value, similarity))
            rows = [(k, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in ready[0].find(t)]
            return {c.split()[0]: [r[i] for r in rows] for i, c in enumerate(schema.split(", "))}

        found = by_batch(docs.select(F.col(key).cast("long"), F.col(text)), run, schema)
        out = found if out is None else out.union(found)
    return out.withColumn("similarity", 1 - F.col("edits") / F.col("item_words"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the rows that hold an item; no row moves. What one block of items leaves is written before the next, so a task holds one block's index."""
    small_batches(docs.sparkSession, 500)
    for nth, block in enumerate(blocks(items, item_key, item_text)):
        if nth:
            docs = materialise(docs, "clean")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        ready: list[Items] = []
        at = docs.columns.index(text)

        def run(batches, shared=shared, ready=ready, at=at):
            ready.append(Items(shared.value, similarity))
            for b in batches:
                yield b.filter(pa.array([not ready[0].find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
