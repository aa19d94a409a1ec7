"""Token ids of whole texts with the tokenizers library, each distinct part encoded once per worker.

Both vocabularies cut a text before they merge, and never across the boundaries used here, so
encoding the parts by themselves gives the ids of the whole text:

* words (lower case, white space dropped): at ASCII white space, and before a comma or full stop
  between a letter and white space;
* bytes: before each space, before such a comma or full stop, and before a single line feed
  between a letter, comma or full stop and a letter. Only in runs of spaces, and of spaces and
  no-break spaces, does a cut or a token depend on what follows; texts with such a run are encoded whole.

The texts of a batch are cut, and their ids put together, as arrays; only distinct parts become
Python objects. New ones are encoded many to a line, and the line's ids are cut where a part begins.

The string of an added token, such as <|endoftext|>, gives that token, as the file says. Texts that
hold one in any letter case are encoded whole: only the very string counts, before any lower-casing.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

_LETTER, _STOP, _FEED, _SPACE, _WHITE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[list(b",.")] = _STOP
_KIND[list(b"\t\v\f\r")] = _WHITE
_KIND[10] = _FEED | _WHITE
_KIND[32] = _SPACE | _WHITE


def _edges(kind: np.ndarray, feeds: bool) -> np.ndarray:
    """Whether a part begins at a comma or full stop between a letter and a space or line feed; with `feeds` also at such line feeds."""
    before, at, after = kind[:-2], kind[1:-1], kind[2:]
    here = np.zeros(len(kind), bool)
    if len(kind) > 2:
        here[1:-1] = (before & _LETTER != 0) & (at & _STOP != 0) & (after & (_SPACE | _FEED) != 0)
        if feeds:
            here[1:-1] |= (before & (_LETTER | _STOP) != 0) & (at & _FEED != 0) & (after & _LETTER != 0)
    return here


class Ids:
    """part -> its ids as little-endian unsigned 32-bit integers.

    Parts are kept in two generations of `most` parts each, or of one batch if that has more; what
    a generation does not meet again goes with the next change.
    """

    def __init__(self, path: str, spaced: bool, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.most = Tokenizer.from_file(path), spaced, most
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space, or that end a word
        self.edge[[i for x, i in vocabulary.items() if (x.startswith("Ġ") if spaced else x.endswith("</w>"))]] = True

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def holds_added(self, lowered: bytes) -> bool:
        return any(a in lowered for a in self.added)

    def of(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each of the parts, which are distinct."""
        if len(self.now) + len(parts) > self.most:
            self.now, self.old = {}, self.now
        new = []
        for p in parts:
            if p not in self.now:
                if (x := self.old.get(p)) is None:
                    new.append(p)
                else:
                    self.now[p] = x
        for at in range(0, len(new), 5_000):
            some = self._learn_line(new[at : at + 5_000])
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                self.now[p] = np.array(e.ids, "<u4").tobytes()
        return [self.now[p] for p in parts]

    def _learn_line(self, parts: list[bytes]) -> list[bytes]:
        """Learn those of the parts that can be told apart in a line of them; returns the others.

        Words: parts of letters only, as each ends with the only token that ends a word. Bytes:
        parts that begin with a space, without other white space at their edges, as only their first token does.
        """
        if self.spaced:
            line = [p for p in parts if p[:1] == b" " and p[1:2] > b" " and p[-1:] > b" " and (p.isascii() or len(x := p.decode()) == len(x.strip()) + 1)]
        else:
            line = [p for p in parts if p.decode().isalpha()]
        text = (b"" if self.spaced else b" ").join(line).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.edge[ids])
        ends = np.append(ends[1:], len(ids)) if self.spaced else ends + 1
        if not line or len(ends) != len(line):  # a letter whose lower case is cut in two
            return parts
        every, at = ids.tobytes(), 0
        for p, end in zip(line, (4 * ends).tolist(), strict=True):
            self.now[p] = every[at:end]
            at = end
        return [p for p in parts if p not in self.now]


@lru_cache(maxsize=4)
def kept(path: str, spaced: bool) -> Ids:
    return Ids(path, spaced)


def _encoded(ids: Ids, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text, of the texts cut as one array of bytes."""
    firsts = np.cumsum([0, *map(len, texts)])
    a = np.frombuffer(b"".join(texts), np.uint8)
    kind = _KIND[a]
    begins = _edges(kind, ids.spaced)
    begins[firsts[:-1][firsts[:-1] < len(a)]] = True
    if ids.spaced:
        begins |= kind & _SPACE != 0
    else:  # white space goes, and what follows it begins a part
        white = kind & _WHITE != 0
        begins[1:] |= white[:-1]
        begins, a = begins[~white], a[~white]
        firsts = np.r_[0, np.cumsum(~white)][firsts]
    offsets = np.flatnonzero(begins)
    of_text = np.searchsorted(offsets, firsts)
    offsets = np.append(offsets, len(a))
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(a))])
    coded = parts.dictionary_encode()
    code, each = coded.indices.to_numpy(), ids.of(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    every, place = np.frombuffer(b"".join(each), "<u4"), np.r_[0, np.cumsum(size)]
    n = size[code]
    end = np.r_[0, np.cumsum(n)]
    out = every[np.repeat(place[code] - end[:-1], n) + np.arange(end[-1])]
    return np.split(out, end[of_text[1:-1]]) if len(texts) > 1 else [out]


def _texts(ids: Ids, texts: list[str | None], whole) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text; those that `whole` (of their bytes) says are encoded by themselves."""
    encoded, alone = [], {}
    for k, t in enumerate(texts):
        b = (t or "").encode()
        if whole(b, low := b.lower()) or ids.holds_added(low):
            alone[k] = ids.whole(t)
            b = low = b""
        encoded.append(b if ids.spaced else low)
    if not encoded:
        return []
    out = _encoded(ids, encoded)
    return [alone.get(k, x).tobytes() for k, x in enumerate(out)]


def word_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text (null: none) by a vocabulary that lower-cases and drops white space."""
    return _texts(kept(path, False), texts, lambda b, low: False)


def byte_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """Ids of each text (null: none) by a byte-level vocabulary."""
    return _texts(kept(path, True), texts, lambda b, low: b"  " in b or b" \xc2\xa0" in b)
