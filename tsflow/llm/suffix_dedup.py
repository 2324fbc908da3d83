"""Removal of repeated passages: every byte inside a string of ``length`` bytes that starts elsewhere too.

The repeats are found by sorting suffixes with deep-shallow sorting; what is built around it makes
that sort a distributed one which no hot passage can overload.

1. Anchors.  Each start of a ``length``-byte string has one anchor: the least hash among the
   ``GRAM``-byte strings inside it (leftmost if tied).  Equal strings have their anchor at the
   same distance, so a string can only repeat among starts with equal anchor grams.  Consecutive
   starts share an anchor, about one per ``(length - GRAM) / 2`` bytes; such a run of starts and
   the bytes it spans is an interval.
2. Only intervals whose anchor gram occurs twice go on (a semi join of hashes).
3. Intervals that are equal as a whole (128-bit hash; counted by partial aggregates) repeat at
   all their starts; copies of documents and of passages end here, whatever their number.
4. What is left lies at the ends of passages and at edits.  These intervals, and one
   representative of each kind from step 3 with the same gram, are cut into blocks of ``BLOCK`` start
   distances.  All strings of a block share a core of ``length - BLOCK + 1`` bytes, whose hash is the
   shuffle key.  So a gram that millions of documents share is split by what surrounds it.
5. Within a key, the suffixes from the anchor and the reversed prefixes before it are put in order
   by deep-shallow sorting.  A start at distance d repeats if another member agrees with it on d
   bytes to the left and length - d to the right, as the common prefixes of the two orders tell.
   A key of over ``GROUP`` members is not held: its starts are streamed on and counted by hash,
   one by one, which is exact as well.

Texts are read whole; matches never cross documents, since intervals are made per document.
Texts are told apart by a 128-bit hash, so copies of a document are worked on once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.llm.common import cut, hash128
from tsflow.llm.deep_shallow import deep_shallow

GRAM = 128
BLOCK = 64
GROUP = 20_000
CHUNK = 1 << 21          # bytes whose anchors are computed at once (a longer text: by itself)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_POWERS: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, b in enumerate((_BASE, inverse)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def intervals(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """For texts of at least ``length`` bytes each: (text number, first start, number of starts,
    anchor distance of the first start, gram hash) per interval."""
    gram = min(GRAM, length)
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    up, down = _powers(len(buf))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buf] * up, dtype=np.uint64)])
    grams = (sums[gram:] - sums[:-gram]) * down[:len(buf) - gram + 1]
    mixed = (grams ^ (grams >> np.uint64(29))) * _MIX
    order = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(mixed), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        order = np.minimum(order[:-have], order[have:])
        have *= 2
    if have < width:
        order = np.minimum(order[:have - width], order[width - have:])
    at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of each start
    change = np.ones(len(at), bool)
    change[1:] = at[1:] != at[:-1]
    change[offsets] = True
    ends = offsets + sizes - length + 1
    change[ends[ends < len(at)]] = True
    first = np.flatnonzero(change)
    n = np.diff(np.append(first, len(at)))
    text = np.searchsorted(offsets, first, side="right") - 1
    ok = first < ends[text]
    first, n, text = first[ok], n[ok], text[ok]
    return text, first - offsets[text], n, at[first] - first, grams[at[first]].view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts) with texts of at least ``length`` bytes; columns: t1, t2, text."""
    keys, texts, total = [], [], 0
    for batch in batches:
        for a, b, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                           batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            if len(t) >= length:
                keys.append((a, b))
                texts.append(t)
                total += len(t)
                if total >= CHUNK:
                    yield keys, texts
                    keys, texts, total = [], [], 0
    if texts:
        yield keys, texts


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _gram_hashes(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _chunks(batches, length):
            yield _batch("gram long", intervals(part, length)[4])
    return texts.mapInArrow(run, "gram long")


INTERVAL = "t1 long, t2 long, start int, n int, lead int, gram long, c1 long, c2 long"


def _intervals(texts: DataFrame, length: int) -> DataFrame:
    """One row per interval; c1 and c2 are the hash of the bytes that it spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for keys, part in _chunks(batches, length):
            text, start, n, lead, gram = intervals(part, length)
            span = _halves([xxh3_128_digest(part[t][s:e]) for t, s, e in
                            zip(text.tolist(), start.tolist(), (start + n + length - 1).tolist(), strict=True)])
            k = np.array(keys, np.int64)[text]
            yield _batch(INTERVAL, k[:, 0], k[:, 1], start, n, lead, gram, span[:, 0], span[:, 1])
    return texts.mapInArrow(run, INTERVAL)


MEMBER = "gram long, block int, k1 long, k2 long, t1 long, t2 long, start int, low int, high int, known boolean, bytes binary"


def _members(open_texts: DataFrame, length: int, size: int) -> DataFrame:
    """Blocks of the open intervals.  ``open_texts``: text, t1, t2, found = [(start, n, lead, gram, known)].
    A member covers the start distances low..high of its block; ``start`` is the position at ``high``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for batch in batches:
            rows, keys = [], []
            for text, t1, t2, found in zip(batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                for x in found:
                    anchor, top, bottom = x["start"] + x["lead"], x["lead"], x["lead"] - x["n"] + 1
                    for block in range(bottom // size, top // size + 1):
                        least, most = block * size, block * size + size - 1
                        low, high = max(bottom, least), min(top, most)
                        keys.append(xxh3_128_digest(text[anchor - least:anchor - most + length]))
                        rows.append((x["gram"], block, t1, t2, anchor - high, low, high, x["known"], text[anchor - high:anchor - low + length]))
                if len(rows) >= 4096:
                    yield _member_batch(rows, keys)
                    rows, keys = [], []
            if rows:
                yield _member_batch(rows, keys)
    return open_texts.mapInArrow(run, MEMBER)


def _member_batch(rows: list[tuple], keys: list[bytes]) -> pa.RecordBatch:
    k = _halves(keys)
    gram, block, *rest = zip(*rows, strict=True)
    return _batch(MEMBER, gram, block, k[:, 0], k[:, 1], *rest)


def _orders(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(common prefixes in sorted order, rank of each string)."""
    order, lcps = deep_shallow(strings)
    rank = [0] * len(order)
    for r, i in enumerate(order):
        rank[i] = r
    return lcps, rank


def repeated_distances(members: list[tuple[int, int, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For each member (low, high, bytes): the ranges of distances at which it agrees with another.

    At distance d members fall into classes that agree on length - d bytes from the anchor on, and
    on d bytes before it.  The classes change only where a common prefix or a member ends, so
    they are compared once per such range of distances.
    """
    right, right_rank = _orders([b[h:] for _, h, b in members])
    left, left_rank = _orders([b[:h][::-1] for _, h, b in members])
    low, high = min(m[0] for m in members), max(m[1] for m in members)
    turns = {low, *(length - x for x in right[1:]), *(x + 1 for x in left[1:]), *(m[0] for m in members), *(m[1] + 1 for m in members)}
    turns = sorted(t for t in turns if low <= t <= high)
    found: list[list[tuple[int, int]]] = [[] for _ in members]
    for d, end in zip(turns, [*turns[1:], high + 1], strict=True):
        inside = [i for i, m in enumerate(members) if m[0] <= d <= m[1]]
        if len(inside) < 2:
            continue
        r = list(accumulate(x < length - d for x in right))
        f = list(accumulate(x < d for x in left))
        keys = [(r[right_rank[i]], f[left_rank[i]]) for i in inside]
        if len(set(keys)) == len(keys):
            continue
        n = Counter(keys)
        for i, k in zip(inside, keys, strict=True):
            if n[k] > 1:
                if found[i] and found[i][-1][1] == d - 1:
                    found[i][-1] = (found[i][-1][0], end - 1)
                else:
                    found[i].append((d, end - 1))
    return found


RESULT = "t1 long, t2 long, start int, n int, h1 long, h2 long"


def _sort_groups(members: DataFrame, length: int, group: int) -> DataFrame:
    """Runs of repeated starts (t1, t2, start, n); members of a key of over ``group`` come out start
    by start with the hash of their string (n = 0), to be counted."""
    def runs(held: list[dict]) -> list[tuple]:
        if len(held) < 2 or all(m["known"] for m in held):
            return []
        hits = repeated_distances([(m["low"], m["high"], m["bytes"]) for m in held], length)
        return [(m["t1"], m["t2"], m["start"] + m["high"] - b, b - a + 1, 0, 0)
                for m, ranges in zip(held, hits, strict=True) if not m["known"] for a, b in ranges]

    def singly(m: dict) -> list[tuple]:
        from xxhash import xxh3_128_digest
        starts = range(m["high"] - m["low"] + 1)
        hashes = _halves([xxh3_128_digest(m["bytes"][i:i + length]) for i in starts]).tolist()
        return [(m["t1"], m["t2"], m["start"] + i, 0, a, b) for i, (a, b) in zip(starts, hashes, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large, out = None, [], False, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            begin = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist()
            for a, b in zip(begin, [*begin[1:], batch.num_rows], strict=True):
                k = tuple(keys[:, a].tolist())
                if k != key:
                    out += runs(held)
                    key, held, large = k, [], False
                    if b - a == 1 and b < batch.num_rows:
                        continue  # alone in its key
                for m in batch.slice(a, b - a).to_pylist():
                    if large:
                        out += singly(m)
                    else:
                        held.append(m)
                        if len(held) > group:
                            out += [x for h in held for x in singly(h)]
                            held, large = [], True
                if len(out) >= 8192:
                    yield _batch(RESULT, *zip(*out, strict=True))
                    out = []
        out += runs(held)
        if out:
            yield _batch(RESULT, *zip(*out, strict=True))

    key = ["gram", "block", "k1", "k2"]
    return members.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, RESULT)


def repeated_starts(docs: DataFrame, text: str = "text", length: int = 400, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``(t1, t2, runs)``: per text (by its hash) the runs (start, n) of starts whose string repeats."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    t1, t2 = hash128(body)
    texts = docs.where(F.octet_length(body) >= length).select(t1.alias("t1"), t2.alias("t2"), body.alias("text"))
    # what is joined to a side that may be skewed is stored first: only joins of plain shuffles are split
    again = cut(_gram_hashes(texts, length).groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("gram"))
    found = cut(_intervals(texts, length).join(again, "gram", "left_semi"))
    kind = ["gram", "lead", "n", "c1", "c2"]
    kinds = cut(found.groupBy(*kind).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("t1", "t2", "start")).alias("one")))
    whole = found.join(kinds.where("copies > 1").select(*kind), kind, "left_semi").select("t1", "t2", "start", "n")

    mixed = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("copies") == 1).alias("open")).where("k > 1 AND open")
    open_kinds = kinds.join(cut(mixed.select("gram")), "gram", "left_semi").select(
        "one.t1", "one.t2", F.struct("one.start", "n", "lead", "gram", (F.col("copies") > 1).alias("known")).alias("x"))
    by_text = cut(open_kinds.groupBy("t1", "t2").agg(F.collect_list("x").alias("found")))
    # copies of a text are dropped before the shuffle
    open_texts = texts.dropDuplicates(["t1", "t2"]).join(by_text, ["t1", "t2"]).select("text", "t1", "t2", "found")
    parts = cut(_sort_groups(_members(open_texts, length, block), length, group))
    singles = parts.where("n = 0")
    same = singles.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h1", "h2")
    ends = parts.where("n > 0").select("t1", "t2", "start", "n").union(
        singles.join(same, ["h1", "h2"], "left_semi").select("t1", "t2", "start", F.lit(1).alias("n")))
    return whole.union(ends).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def removed_spans(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the strings of the runs."""
    out: list[tuple[int, int]] = []
    for start, n in sorted((r["start"], r["n"]) for r in runs):
        end = start + n - 1 + length
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without_repeats(docs: DataFrame, text: str = "text", length: int = 400, **options) -> DataFrame:
    """``(t1, t2, spans, kept binary)`` for the texts that lose bytes: their removed spans
    (begin, end) and the bytes that stay."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    t1, t2 = hash128(body)
    texts = docs.where(F.octet_length(body) >= length).select(t1.alias("t1"), t2.alias("t2"), body.alias("text"))
    hit = texts.dropDuplicates(["t1", "t2"]).join(cut(repeated_starts(docs, text, length, **options)), ["t1", "t2"])
    schema = "t1 long, t2 long, spans array<struct<begin: int, end: int>>, kept binary"
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for t, runs in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = removed_spans(runs, length)
                spans.append([{"begin": a, "end": b} for a, b in found])
                kept.append(b"".join(t[a:b] for a, b in zip([0, *(b for _, b in found)], [*(a for a, _ in found), len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
                                             ["t1", "t2", "spans", "kept"])

    return hit.select("t1", "t2", "text", "runs").mapInArrow(run, schema)


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 400, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row.

    A null text is empty.  Repeated rows are copies of each other: with at least ``length`` bytes
    they lose all of them.  Offsets are bytes; null ids stay.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    t1, t2 = hash128(body)
    own = docs.select(F.col(f"`{doc_id}`").alias("__id"), t1.alias("t1"), t2.alias("t2"), F.octet_length(body).cast("long").alias("n_bytes"),
                      F.sha2(F.encode(body, "UTF-8"), 256).alias("whole"))
    hit = cut(without_repeats(docs, text, length, **options).select(
        "t1", "t2", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("gone"),
        F.size("spans").cast("long").alias("cuts"), F.sha2("kept", 256).alias("kept")))
    return own.join(hit, ["t1", "t2"], "left").select(
        F.col("__id").alias(doc_id), "n_bytes", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cuts", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
