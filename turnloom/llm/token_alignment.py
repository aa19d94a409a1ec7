"""Alignment of the tokens of two tokenizers, as a monoid of fragments.

Both vocabularies encode " " + text. Byte offsets at which a token of each ends cut the tokens into
groups. A byte range of a text yields a fragment: an open prefix (tokens up to the first such offset
in the range), closed groups, and an open suffix (tokens beyond the last). Fragments compose: a
suffix and the next prefix close one group. That is associative, so ranges of very long texts are
encoded in tasks of their own and composed in a tree, a step of FAN to one after another; other
texts are one range. A text has no tokens if it is null or empty, or if the tokens of either
vocabulary do not spell " " + text.

A range is encoded from the last place before it to the first after it at which neither vocabulary
has a token across: before a space after a printable ASCII character or a Latin letter, before a
comma or full stop between a letter and white space, and before a line feed between a letter, comma
or full stop and a letter. The parts between such places are encoded once per worker.

Repeated rows are rows of their own; the number of documents of a pair counts each of them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, materialise, new_path, small_batches
from .tokens import _KIND, _LETTER, _SPACE, Ids, _edges

CHUNK = 1 << 16  # bytes of a range
FAN = 16  # fragments that are composed at once
HEAD = 1 << 21  # pairs that every task may look up by itself (24 MB); the links of rarer ones are counted in a shuffle
PARTS = 150_000  # parts that a worker keeps, twice
LARGE = 1 << 16  # links of a group from which they are counted by distinct ids

ALIGNED = "row long, doc_id long, a binary, b binary, na binary, nb binary"
FRAGMENT = f"{ALIGNED}, chunk long, ok boolean, cut boolean, pre_a binary, pre_b binary, suf_a binary, suf_b binary"


def cuts(a: np.ndarray) -> np.ndarray:
    """Whether each byte begins a part."""
    kind = _KIND[a]
    begins = _edges(kind, True)
    if len(a) > 1:
        before = np.r_[np.uint8(32), a[:-1]]
        lead = np.r_[np.uint8(32), np.uint8(32), a[:-2]] if len(a) > 2 else np.full(len(a), 32, np.uint8)
        begins |= (kind & _SPACE != 0) & (((before > 32) & (before < 127)) | ((before > 127) & (lead == 0xC3)))
    return begins


def _bytes_of_level() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Ids of parts by both vocabularies: part -> (ids, ids, whether both spell it)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = Ids(a_path, True, PARTS)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, []
        level = _bytes_of_level()
        vocabulary = self.a.tokenizer.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for x, i in vocabulary.items():
            self.a_bytes[i] = bytes(level[c] for c in x) if all(c in level for c in x) else x.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.feed = self.b.piece_to_id("<0x0A>")
        if any((b"\n" in x and x != b"\n") or any(cuts(np.frombuffer(b"a" + x + after, np.uint8))[2 : len(x) + 1].any() for after in (b"a", b" ", b"\n")) for x in self.b_bytes):
            raise ValueError("a piece of the second vocabulary stands across a place where texts are cut")
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.now: dict[bytes, tuple[bytes, bytes, bool]] = {}
        self.old: dict[bytes, tuple[bytes, bytes, bool]] = {}

    def _second(self, parts: list[bytes]) -> list[np.ndarray]:
        """The second vocabulary's ids; many parts to a line, as no piece holds a line feed."""
        lines = [p for p in parts if b"\n" not in p]
        out = {}
        if lines:
            ids = np.array(self.b.encode("\n" + "\n".join(p.decode() for p in lines), num_threads=1), "<u4")
            out = dict(zip(lines, np.split(ids, np.flatnonzero(ids == self.feed)[1:]), strict=True))
            out = {p: x[1:] for p, x in out.items()}
            out[lines[0]] = out[lines[0]][1:]  # the prefix that stands before the first line feed
        return [out[p] if p in out else np.array(self.b.encode("\n" + p.decode(), num_threads=1)[2:], "<u4") for p in parts]

    def of(self, parts: list[bytes]) -> list[tuple[bytes, bytes, bool]]:
        if len(self.now) + len(parts) > PARTS:
            self.now, self.old = {}, self.now
        new = []
        for p in parts:
            if p not in self.now:
                if (x := self.old.get(p)) is None:
                    new.append(p)
                else:
                    self.now[p] = x
        for at in range(0, len(new), 5_000):
            some = new[at : at + 5_000]
            firsts, seconds = self.a.of(some), [x.tobytes() for x in self._second(some)]
            spelt = [x and y for x, y in zip(_spelt(some, firsts, self.a_bytes), _spelt(some, seconds, self.b_bytes), strict=True)]
            self.now.update(zip(some, zip(firsts, seconds, spelt, strict=True), strict=True))
        return [self.now[p] for p in parts]

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """Ids of each text by either vocabulary, and whether both spell it (else no ids). No text is empty, and each begins where a part may."""
        firsts = np.cumsum([0, *map(len, texts)])
        a = np.frombuffer(b"".join(texts), np.uint8)
        begins = cuts(a)
        begins[firsts[:-1]] = True
        offsets = np.flatnonzero(begins)
        of_text = np.searchsorted(offsets, firsts)
        offsets = np.append(offsets, len(a)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(a)])
        coded = parts.dictionary_encode()
        code, each = coded.indices.to_numpy(), self.of(coded.dictionary.to_pylist())
        spelt = np.array([x[2] for x in each])[code]
        ok = np.logical_and.reduceat(spelt, of_text[:-1])
        kept = np.repeat(ok, np.diff(of_text))
        out = []
        for k in (0, 1):
            size = np.fromiter((len(x[k]) for x in each), np.int64, len(each)) // 4
            every, place = np.frombuffer(b"".join([x[k] for x in each]), "<u4"), np.r_[0, np.cumsum(size)]
            n = size[code] * kept
            end = np.r_[0, np.cumsum(n)]
            ids = every[np.repeat(place[code] - end[:-1], n) + np.arange(end[-1])]
            out.append(np.split(ids, end[of_text[1:-1]]))
        return out[0], out[1], ok.tolist()


def _spelt(parts: list[bytes], ids: list[bytes], spelling: list[bytes]) -> list[bool]:
    """Whether the ids of each part spell it: all parts at once, and one by one only if some do not."""
    every = [spelling[i] for i in np.frombuffer(b"".join(ids), "<u4").tolist()]
    end = np.cumsum([0, *(len(x) // 4 for x in ids)])
    size = np.r_[0, np.cumsum([len(x) for x in every])]
    if b"".join(every) == b"".join(parts) and (np.diff(size[end]) == [len(p) for p in parts]).all():
        return [True] * len(parts)
    return [b"".join(every[i:j]) == p for p, i, j in zip(parts, end[:-1].tolist(), end[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def fragment(pair: Pair, a: np.ndarray, b: np.ndarray, lo: int, hi: int) -> dict:
    """The fragment of the tokens that end in (lo, hi], offsets counted from where the ids begin."""
    ends_a, ends_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    is_a, is_b = np.zeros((2, int(ends_a[-1]) + 1 if len(a) else 1), bool)
    is_a[ends_a], is_b[ends_b] = True, True
    met_a, met_b = is_b[ends_a], is_a[ends_b]
    if lo > 0 or (len(ends_a) and hi < ends_a[-1]):
        in_a, in_b = (ends_a > lo) & (ends_a <= hi), (ends_b > lo) & (ends_b <= hi)
        a, b, met_a, met_b = a[in_a], b[in_b], met_a[in_a], met_b[in_b]
    at_a, at_b = np.flatnonzero(met_a) + 1, np.flatnonzero(met_b) + 1
    if not len(at_a):
        none = np.zeros(0, "<u4")
        return {"cut": False, "pre_a": a, "pre_b": b, "a": none, "b": none, "na": none, "nb": none, "suf_a": none, "suf_b": none}
    return {
        "cut": True, "pre_a": a[: at_a[0]], "pre_b": b[: at_b[0]], "a": a[at_a[0] : at_a[-1]], "b": b[at_b[0] : at_b[-1]], "na": np.diff(at_a), "nb": np.diff(at_b), "suf_a": a[at_a[-1] :], "suf_b": b[at_b[-1] :],
    }


def compose(fragments: list[dict]) -> dict:
    """Fragments of neighbouring ranges as one. Whatever the grouping, the result is the same."""
    parts = {k: [] for k in ("pre_a", "pre_b", "a", "b", "na", "nb", "suf_a", "suf_b")}
    cut = False
    for f in fragments:
        if not cut:
            for k in ("pre_a", "pre_b"):
                parts[k].append(f[k])
            if f["cut"]:
                cut = True
                for k in ("a", "b", "na", "nb", "suf_a", "suf_b"):
                    parts[k].append(f[k])
        elif not f["cut"]:
            parts["suf_a"].append(f["pre_a"])
            parts["suf_b"].append(f["pre_b"])
        else:
            for k, n in (("a", "na"), ("b", "nb")):
                closed = [*parts[f"suf_{k}"], f[f"pre_{k}"]]
                parts[k] += [*closed, f[k]]
                parts[n] += [np.array([sum(map(len, closed))]), f[n]]
                parts[f"suf_{k}"] = [f[f"suf_{k}"]]
    return {"cut": cut} | {k: np.concatenate(v) if v else np.zeros(0, "<u4") for k, v in parts.items()}


def closed(f: dict) -> dict:
    """The groups of a whole text: its beginning closes the prefix, and its end is an end of both."""
    if not f["cut"]:
        return {k: f[k] for k in ("a", "b", "na", "nb")}
    return {k: np.concatenate([f[f"pre_{k}"], f[k]]) for k in "ab"} | {f"n{k}": np.concatenate([[len(f[f"pre_{k}"])], f[f"n{k}"]]) for k in "ab"}


def _cells(f: dict, names: tuple[str, ...]) -> dict:
    return {k: np.asarray(f[k]).astype("<u4").tobytes() for k in names}


SHORT, LONG = ("a", "b", "na", "nb"), ("a", "b", "na", "nb", "pre_a", "pre_b", "suf_a", "suf_b")


def _by_rows(df: DataFrame, f, schema: str) -> DataFrame:
    """mapInArrow for a generator from rows of a batch to rows, given on in batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for r in f(batches):
            out.append(r)
            size += sum(len(v) for v in r.values() if isinstance(v, bytes))
            if size > 8 << 20 or len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _aligned_short(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            pair = _pair(a_path, b_path)
            rows, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [b" " + t.encode() if t else None for t in batch.column(2).to_pylist()]
            some = [t for t in texts if t]
            found = zip(*pair.encode(some), some, strict=True) if some else iter(())
            for row, key, t in zip(rows, keys, texts, strict=True):
                cells = dict.fromkeys(SHORT, b"")
                if t:
                    a, b, ok, _ = next(found)
                    if ok:
                        cells = _cells(closed(fragment(pair, a, b, 0, len(t))), SHORT)
                yield {"row": row, "doc_id": key, **cells}

    return _by_rows(docs, run, ALIGNED)


def _windows(docs: DataFrame, chunk: int) -> DataFrame:
    """(row, doc_id, chunk, window, lo, hi): byte ranges of long texts, each with the bytes from the last cut before to the first after it."""

    def run(batches):
        for batch in batches:
            for row, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = b" " + text.encode()
                at = np.flatnonzero(cuts(np.frombuffer(t, np.uint8)))
                at = np.concatenate([[0], at[at > 0], [len(t)]])
                lo = k = 0
                while lo < len(t):
                    hi = min(lo + chunk, len(t))
                    begin, end = int(at[np.searchsorted(at, lo, "right") - 1]), int(at[np.searchsorted(at, hi)])
                    if end - hi > chunk:  # no place to cut for long: nothing is to be encoded over and over
                        hi = end
                    yield {"row": row, "doc_id": key, "chunk": k, "window": t[begin:end], "lo": lo - begin, "hi": hi - begin}
                    lo, k = hi, k + 1

    return _by_rows(docs, run, "row long, doc_id long, chunk long, window binary, lo long, hi long")


def _fragments(windows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            pair = _pair(a_path, b_path)
            for row, key, chunk, t, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (a,), (b,), (ok,) = pair.encode([t])
                f = fragment(pair, a, b, lo, hi)
                yield {"row": row, "doc_id": key, "chunk": chunk, "ok": ok, "cut": f["cut"], **_cells(f, LONG)}

    return _by_rows(windows, run, FRAGMENT)


def _composed(fragments: DataFrame) -> DataFrame:
    """One step of the tree: FAN neighbours to one."""

    def run(batches):
        def one(group):
            f = compose([{"cut": r["cut"]} | {k: np.frombuffer(r[k], "<u4") for k in LONG} for r in group])
            r = group[0]
            return {"row": r["row"], "doc_id": r["doc_id"], "chunk": r["chunk"] // FAN, "ok": all(x["ok"] for x in group), "cut": f["cut"], **_cells(f, LONG)}

        group: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if group and (group[0]["row"], group[0]["chunk"] // FAN) != (r["row"], r["chunk"] // FAN):
                    yield one(group)
                    group = []
                group.append(r)
        if group:
            yield one(group)

    to = F.floor(F.col("chunk") / FAN)
    return _by_rows(fragments.repartition("row", to).sortWithinPartitions("row", "chunk"), run, FRAGMENT)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A row per document: row (a number of its own), doc_id, the ids a and b, and how many of them each group has (na, nb), as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession, 500, 4 << 20)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = _aligned_short(rows.filter(size < chunk), a_path, b_path)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialise(_fragments(_windows(rows.filter(size >= chunk), chunk).repartition(n, "row", "chunk"), a_path, b_path), "fragments")
    most = parts.agg(F.max("chunk")).first()[0]
    while most is not None and most > 0:
        parts, most = materialise(_composed(parts), "composed"), most // FAN
    if most is None:
        return materialise(short, "aligned")

    def whole(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cells = _cells(closed({"cut": r["cut"]} | {k: np.frombuffer(r[k], "<u4") for k in LONG}), SHORT) if r["ok"] else dict.fromkeys(SHORT, b"")
                yield {"row": r["row"], "doc_id": r["doc_id"], **cells}

    return materialise(short.unionByName(_by_rows(parts, whole, ALIGNED)), "aligned")


def _joined(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column, one after another, and how many each row has."""
    cells = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(cells), "<u4").astype(np.int64), np.array([len(x) // 4 for x in cells], np.int64)


def _links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links): the distinct pairs of each document and how often they are linked. A pair is a << 32 | b; `doc` is each group's document."""
    sa, sb, n = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    large = np.flatnonzero(n > LARGE)
    of_a, of_b = (int(x.max(initial=0)).bit_length() for x in (a, b))
    if not len(large) and int(doc.max(initial=0)).bit_length() + of_a + of_b < 64:  # document, a and b in one number: one sort
        return _sorted_links(a, b, na, nb, doc, of_a, of_b)
    n[large] = 0
    g = np.repeat(np.arange(len(n)), n)
    r = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    docs, pairs, counts = [doc[g]], [a[sa[g] + r // nb[g]] << 32 | b[sb[g] + r % nb[g]]], [np.ones(len(g), np.int64)]
    for k in large.tolist():
        (ua, ca), (ub, cb) = (np.unique(x[s[k] : s[k] + m[k]], return_counts=True) for x, s, m in ((a, sa, na), (b, sb, nb)))
        pairs.append((ua[:, None] << 32 | ub[None, :]).ravel())
        counts.append((ca[:, None] * cb[None, :]).ravel())
        docs.append(np.full(len(pairs[-1]), doc[k]))
    d, p, c = np.concatenate(docs), np.concatenate(pairs), np.concatenate(counts)
    ids, code = np.unique(p, return_inverse=True)
    both, at = np.unique(d * len(ids) + code, return_inverse=True)
    return both // max(len(ids), 1), ids[both % max(len(ids), 1)], np.bincount(at, c, len(both)).astype(np.int64)


def _sorted_links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, doc: np.ndarray, of_a: int, of_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _links gives, for ids of so many bits that document, a and b fit in 63."""
    each = np.repeat(nb, na)  # links of each a
    first = np.repeat(np.cumsum(nb) - nb, na)
    at = np.arange(each.sum()) + np.repeat(first - (np.cumsum(each) - each), each)
    every = np.repeat(np.repeat(doc, na) << (of_a + of_b) | a << of_b, each) | b[at]
    every.sort()
    begins = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    some = every[begins]
    rest = some & ((1 << of_a + of_b) - 1)
    return some >> (of_a + of_b), rest >> of_b << 32 | rest & ((1 << of_b) - 1), np.diff(np.append(begins, len(every)))


def _of_batch(batch: pa.RecordBatch):
    (a, a_each), (b, b_each), (na, groups), (nb, _) = (_joined(batch, k) for k in SHORT)
    return a, b, na, nb, a_each, b_each, groups, _links(a, b, na, nb, np.repeat(np.arange(batch.num_rows), groups))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, n_docs, best): in how many documents each pair of ids is linked, and whether no pair of a_id is linked in more."""
    small_batches(aligned.sparkSession, 500, 4 << 20)

    def merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ids, code = np.unique(np.concatenate(pairs), return_inverse=True)
        return ids, np.bincount(code, np.concatenate(counts), len(ids)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, held = [], [], 0
        for batch in batches:
            *_, (_, p, _) = _of_batch(batch)
            ids, n = np.unique(p, return_counts=True)
            pairs.append(ids)
            counts.append(n)
            held += len(ids)
            if held > 4_000_000:
                ids, n = merged(pairs, counts)
                if len(ids) > 2_000_000:
                    yield told(ids, n)
                    pairs, counts, held = [], [], 0
                else:
                    pairs, counts, held = [ids], [n], len(ids)
        if pairs:
            yield told(*merged(pairs, counts))

    def told(ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids >> 32), pa.array(ids & 0xFFFFFFFF), pa.array(n)], names=["a_id", "b_id", "n"])

    each = aligned.select(*SHORT).mapInArrow(run, "a_id long, b_id long, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n_docs"))
    return materialise(each.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a_id"))), "pairs")


def _text(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` of every group as bytes, and where each group ends."""
    both = na + nb
    base = np.cumsum(both) - both
    at_a = np.repeat(base - (np.cumsum(na) - na), na) + np.arange(len(a))
    at_b = np.repeat(base + na - (np.cumsum(nb) - nb), nb) + np.arange(len(b))
    ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    sep[base + na - 1], sep[base + both - 1] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    for k in range(1, 10):
        digits += ids >= 10**k
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = sep
    for k in range(int(digits.max(initial=0))):
        some = digits > k
        out[end[some] - 2 - k] = 48 + ids[some] // 10**k % 10
    return out, end[base + both - 1]


@lru_cache(maxsize=1)
def _head(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pyarrow.parquet as pq

    fs, at = filesystem(path)
    t = pq.read_table(at, filesystem=fs)
    pair = t["a_id"].to_numpy() << 32 | t["b_id"].to_numpy()
    order = np.argsort(pair)
    return pair[order], t["n_docs"].to_numpy()[order], t["best"].to_numpy()[order]


def _bound(pairs: DataFrame, most: int) -> int:
    """The least number of documents such that no more than `most` pairs have as many."""
    octave = F.floor(F.log2("n_docs") * 4)
    rows = pairs.groupBy(octave.alias("o")).agg(F.count("*").alias("n"), F.min("n_docs").alias("least")).collect()  # at most 256 rows
    total, bound = 0, (1 << 62)
    for r in sorted(rows, key=lambda r: -r["o"]):
        total += r["n"]
        if total > most:
            break
        bound = r["least"]
    return bound


STATS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rest array<struct<a_id: long, b_id: long, n: long>>"


def link_statistics(aligned: DataFrame, pairs: DataFrame, most: int = HEAD) -> DataFrame:
    """Per row of `aligned`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Pairs of many documents (at most `most`) are looked up in the tasks; the links of others meet their pairs in a join.
    """
    small_batches(aligned.sparkSession, 500, 4 << 20)
    bound = _bound(pairs, most)
    pairs.filter(F.col("n_docs") >= bound).write.parquet(head := new_path(aligned.sparkSession, "common-pairs"))

    def run(batches):
        for batch in batches:
            common, n_docs, best = _head(head)
            a, b, na, nb, a_each, b_each, groups, (doc, pair, n) = _of_batch(batch)
            links = np.bincount(doc, n, batch.num_rows).astype(np.int64)
            at = np.searchsorted(common, pair)
            known = np.zeros(len(pair), bool)
            inside = at < len(common)
            known[inside] = common[at[inside]] == pair[inside]
            d, k, m = doc[known], at[known], n[known]
            n_best = np.bincount(d, m * best[k], batch.num_rows).astype(np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, d, m * n_docs[k])
            rest: dict[int, list] = {}
            for x, p, c in zip(doc[~known].tolist(), pair[~known].tolist(), n[~known].tolist(), strict=True):
                rest.setdefault(x, []).append({"a_id": p >> 32, "b_id": p & 0xFFFFFFFF, "n": c})
            text, ends = _text(a, b, na, nb)
            last = np.r_[0, np.cumsum(groups)]
            view = memoryview(text)
            for i, (row, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                begin = int(ends[last[i] - 1]) if last[i] else 0
                sha = hashlib.sha256(view[begin : int(ends[last[i + 1] - 1]) - 1]).hexdigest() if groups[i] else ""
                yield {
                    "row": row, "doc_id": key, "n_a": int(a_each[i]), "n_b": int(b_each[i]), "n_groups": int(groups[i]), "n_links": int(links[i]), "n_best": int(n_best[i]), "count_sum": int(total[i]),
                    "groups_sha256": sha, "rest": rest.get(i, []),
                }

    stats = materialise(_by_rows(aligned.select("row", "doc_id", *SHORT), run, STATS), "links")
    rare = stats.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(pairs.filter(F.col("n_docs") < bound), ["a_id", "b_id"])
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("n_docs")).alias("_sum"))
    out = stats.drop("rest").join(rare, "row", "left")
    return out.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("row", "_best", "_sum")
