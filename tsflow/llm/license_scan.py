"""License scan: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into words; hashes of ``GRAM`` consecutive words are winnowed (the least of each
``WINDOW`` consecutive ones stays) and kept in an inverted index from hash to (template, place).
The index is built on the driver from the templates, a parameter, and broadcast; its size is
that of the templates (at most one entry per template word), whatever the corpus.

Each document's word hashes are computed by array operations over many documents at once and
looked up in the index.  Hits of one template that lie near one diagonal (place in the document
minus place in the template) make a candidate, and the template is aligned locally with the words
around it within a band of the diagonals, so the cost is template words times band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM, WINDOW = 3, 4
CHUNK = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: 0 for bytes that part words; letters (A-Z as a-z), digits and bytes of other letters have a value
_CLASS = np.zeros(256, np.uint64)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _CLASS[_b] = np.random.default_rng(_b).integers(1, 1 << 63)
_CLASS[65:91] = _CLASS[97:123]


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of each word of a byte array."""
    value = _CLASS[buf]
    inside = np.concatenate([[False], value > 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = change[::2], change[1::2]
    powers, back = _powers(len(buf))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers, dtype=np.uint64)])
    h = (sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)
    return begin, end, (h ^ (h >> np.uint64(31))) * _MIX


_TABLE: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLE.get("up", ())) < n:
        for name, b in (("up", _ODD), ("down", np.uint64(pow(int(_ODD), -1, 1 << 64)))):
            steps = np.full(n, b, np.uint64)
            steps[:1] = 1
            _TABLE[name] = np.cumprod(steps, dtype=np.uint64)
    return _TABLE["up"][:n], _TABLE["down"][:n]


def grams(h: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` consecutive words."""
    out = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        out = out * _ODD + h[j:len(h) - GRAM + 1 + j]
    return (out ^ (out >> np.uint64(29))) * _MIX


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]     # word hashes of each template
    hashes: np.ndarray          # sorted fingerprints
    template: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, templates: dict[str, str]) -> Index:
        entries: set[tuple[int, int, int]] = set()
        parts = []
        for t, text in enumerate(templates.values()):
            h = words(np.frombuffer(text.encode(), np.uint8))[2]
            if len(h) < GRAM:
                raise ValueError(f"a template needs at least {GRAM} words: {text!r}")
            parts.append(h)
            g = grams(h)
            for at in range(max(1, len(g) - WINDOW + 1)):
                k = at + int(np.argmin(g[at:at + WINDOW]))
                entries.add((int(g[k]), t, k))
        table = np.array(sorted(entries), np.uint64).reshape(-1, 3)
        return cls(list(templates), parts, table[:, 0], table[:, 1].astype(np.int64), table[:, 2].astype(np.int64))

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in g, template, place in template) of every fingerprint found, by place."""
        lo, hi = np.searchsorted(self.hashes, g), np.searchsorted(self.hashes, g, side="right")
        at = np.flatnonzero(hi > lo)
        n = (hi - lo)[at]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at], n)
        return np.repeat(at, n), self.template[entry], self.place[entry]


def band_of(length: int) -> int:
    """Half width of the band: edits of up to a fifth of the template, four words at least."""
    return max(4, length // 5)


def align(template: list[int], doc: list[int], diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment of a template with a document near a diagonal: (words matched, first and
    last document word matched).  Match +1, mismatch or gap -1.  Cells hold (score, matched, first,
    last) and lie within ``band`` of the diagonal."""
    none = (0, 0, -1, -1)
    best, row, base = none, {}, diagonal - band
    for i, word in enumerate(template):
        new: dict[int, tuple] = {}
        for j in range(max(0, base + i), min(len(doc), base + i + 2 * band + 1)):
            s = row.get(j - 1, none)
            if doc[j] == word:
                cell = (s[0] + 1, s[1] + 1, s[2] if s[0] > 0 else j, j) if s[0] > 0 else (1, 1, j, j)
            else:
                s = max(s, row.get(j, none), new.get(j - 1, none))
                cell = (s[0] - 1, *s[1:]) if s[0] > 1 else none
            if cell[0]:
                new[j] = cell
                if cell[:2] > best[:2]:
                    best = cell
        row = new
    return best[1], best[2], best[3]


def scan_text(index: Index, doc: np.ndarray, hits: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, words matched, first word, last word) of every confirmed place in a document.
    ``hits``: (template, place in document, place in template)."""
    found = []
    for t in sorted({h[0] for h in hits}):
        words_of = index.words[t].tolist()
        band = band_of(len(words_of))
        groups: list[list[int]] = []  # diagonal of the first hit, last place
        for _, at, place in sorted(h for h in hits if h[0] == t):
            for g in reversed(groups):
                if abs(at - place - g[0]) <= band:
                    break
                if at - g[1] > 2 * len(words_of):
                    groups.append([at - place, at])
                    break
            else:
                groups.append([at - place, at])
                continue
            g[1] = at
        spans: list[tuple[int, int, int, int]] = []
        for diagonal, _ in groups:
            begin = max(0, diagonal - band)
            part = doc[begin:diagonal + len(words_of) + band + 1].tolist()
            matched, first, last = align(words_of, part, diagonal - begin, band)
            if matched >= least * len(words_of):
                spans.append((t, matched, begin + first, begin + last))
        kept: list[tuple[int, int, int, int]] = []
        for s in sorted(spans, key=lambda x: (-x[1], x[2])):  # of overlapping places the best stays
            if all(s[3] < k[2] or s[2] > k[3] for k in kept):
                kept.append(s)
        found += sorted(kept, key=lambda x: x[2])
    return found


def scan(docs: DataFrame, templates: dict[str, str], doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """``(doc_id, license, n_words, n_matched, coverage, begin, end)``: one row per place of a document
    where at least ``least`` of a template's words are found in order.

    ``begin`` and ``end`` are offsets in the UTF-8 bytes of the text.  Null, empty and other texts
    without a match give no row; repeated rows give their rows again; null ids stay; texts of any
    length are scanned whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index.build(templates))
    schema = T.StructType([docs.schema[doc_id], *T.StructType.fromDDL(
        "license string, n_words long, n_matched long, coverage double, begin long, end long").fields])

    def part(index: Index, ids: list, texts: list[bytes]) -> list[tuple]:
        sizes = np.array([len(t) + 1 for t in texts])
        ends = np.cumsum(sizes)
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin, end, h = words(buf)
        at, template, place = index.hits(grams(h))
        if not len(at):
            return []
        owner = np.searchsorted(ends, begin[at], side="right")
        last = np.searchsorted(ends, begin[at + GRAM - 1], side="right")
        at, template, place, owner = (x[owner == last] for x in (at, template, place, owner))
        first_word = np.searchsorted(begin, ends - sizes)
        n_words = np.searchsorted(begin, ends) - first_word
        out = []
        for d in np.unique(owner).tolist():
            mine = owner == d
            lo, offset = int(first_word[d]), int(ends[d] - sizes[d])
            hits = list(zip(template[mine].tolist(), (at[mine] - lo).tolist(), place[mine].tolist(), strict=True))
            for t, matched, a, b in scan_text(index, h[lo:lo + n_words[d]], hits, least):
                n = len(index.words[t])
                out.append((ids[d], index.names[t], n, matched, matched / n, int(begin[lo + a]) - offset, int(end[lo + b]) - offset))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at, total = 0, 0
            for k in range(batch.num_rows):
                total += len(texts[k].as_py() or b"")
                if total >= CHUNK or k == batch.num_rows - 1:
                    rows = part(index, list(range(at, k + 1)), [t or b"" for t in texts.slice(at, k + 1 - at).to_pylist()])
                    if rows:
                        row, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row)), *(pa.array(c) for c in rest)], [f.name for f in schema])
                    at, total = k + 1, 0

    return docs.select(doc_id, F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)
