"""N-gram Jaccard join, size-aware: subsets for small sets, inverted lists for large ones.

A document's set holds a 64-bit hash per distinct word shingle.  Two sets of a and b shingles are
linked if they share at least ``need(a, b)`` of them (the Jaccard threshold, in integers).

* Small sets (fewer than ``boundary`` shingles): for every partner size b each set names all its subsets of
  ``need(a, b)`` shingles.  Two sets that name the same subset are linked for certain, so the sets under a
  subset are tied to one of them; no pair is compared and none is listed.
* Large sets: inverted lists.  Shingles are ordered by their rarity in a counting sketch of the corpus
  (a fixed number of cells), and a set stands in the lists of its first shingles only, as many as any partner
  must share one of.  First each set is compared with one pivot of each of its lists (drawn anew for each list, so that a family of near
  copies, which shares many lists, has many pivots), and components are built.
  Then the lists are joined with themselves, and only sets of different components meet there, where their lists
  first cross, under conditions on size, position and a parity bitmap (its distance is never more than the
  symmetric difference).
  What is left is verified on the whole sets.  A set is in the lists too if it is small but has large partners.

The boundary is where the subsets to name cost less than the lists to scan, from the sizes of the
corpus and the sketch.  No filter loses a link: each is a bound on the intersection.  Copies are one set
throughout.  Shuffled are hashes, and the sets of candidates.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.llm.common import cut
from tsflow.llm.simhash_dedup import components

CELLS = 1 << 18              # of the sketch, whatever the corpus
PART = 1 << 14               # cells in one row while sketches are added up
SMALLEST_LARGE = 40          # no set above is small: its subsets would be too many at any cost
NARROW = 8                   # 64-bit words of every set's parity bitmap
WIDE = 1024                  # sets from this size on also have a wide bitmap
SEEN = 100_000               # sets that a task remembers, so that copies are sent once
FILTER_BITS = 1 << 23        # of the bitmap that tells which sets are verified


def need(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of a and b shingles."""
    return -(-percent * (a + b) // (100 + percent))


def first(n: int, percent: int) -> int:
    """How many of its n shingles a set must name so that every partner shares one."""
    return n - -(-percent * n // 100) + 1


def partners(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def n_subsets(n: int, boundary: int, percent: int) -> int:
    """Subsets that a small set names."""
    return sum(comb(n, need(n, b, percent)) for b in partners(n, percent) if b < boundary)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes (``bytes`` methods lower-case A-Z and split at ASCII blanks only)."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - shingle + 1
    got = np.full(n, shingle, np.uint64)
    for k in range(shingle):
        got = _mix(got + h[k:k + n])
    return np.unique(got)


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % CELLS


def _parity(tokens: np.ndarray, words: int) -> np.ndarray:
    """Bitmap of 64-bit words in which each token turns one bit over."""
    bit = (tokens & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _key(tokens: np.ndarray) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _short(key: Column) -> Column:
    """The first eight bytes of a set's key as a long: sets are listed under it, and told apart by the key later."""
    return F.conv(F.hex(F.substring(key, 1, 7)), 16, 10).cast("long")


def _short_of(key: bytes) -> int:
    return int.from_bytes(key[:7], "big")


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string")).alias("t")


def scan(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """One pass: a row ``(id, t, s, n, small, f, wide)`` per document, and rows ``(part, cells)`` of the tasks' sketches."""
    fields = [T.StructField("id", docs.schema[doc_id].dataType)] + [T.StructField(n, t) for n, t in (
        ("t", T.LongType()), ("s", T.BinaryType()), ("n", T.IntegerType()), ("small", T.ArrayType(T.LongType())), ("f", T.ArrayType(T.LongType())),
        ("wide", T.ArrayType(T.LongType())), ("part", T.IntegerType()), ("cells", T.BinaryType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.int64)
        longs = pa.list_(pa.int64())
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = [shingles(t, shingle) for t in some.column(1).to_pylist()]
                sketch += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
                k = len(sets)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(2), pa.array([_key(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32()),
                    pa.array([x.view(np.int64) if 0 < len(x) <= SMALLEST_LARGE else None for x in sets], longs),
                    pa.array([_parity(x, NARROW) for x in sets], longs),
                    pa.array([_parity(x, 64) if len(x) >= WIDE else None for x in sets], longs),
                    pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], [f.name for f in fields])
        if kind is not None:
            parts = [p for p in range(CELLS // PART) if sketch[p * PART:(p + 1) * PART].any()]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), *(pa.nulls(k, longs) for _ in range(3)), pa.array(parts, pa.int32()),
                pa.array([zlib.compress(sketch[p * PART:(p + 1) * PART].tobytes(), 1) for p in parts], pa.binary())], [f.name for f in fields])

    return docs.select(doc_id, F.col(text).cast("string"), _text_hash(text)).mapInArrow(run, T.StructType(fields))


def sketch_of(scanned: DataFrame) -> np.ndarray:
    """The corpus' counts per cell: partial sums in groups of tasks, then ``CELLS`` numbers to the driver."""
    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PART, np.int64)
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                total += np.frombuffer(zlib.decompress(cells), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["part", "cells"])

    rows = scanned.where("part IS NOT NULL").select("part", "cells", F.pmod(F.xxhash64("cells"), F.lit(64)).alias("salt"))
    some = rows.groupBy("part", "salt").applyInArrow(add, "part int, cells binary")
    done = some.groupBy("part").applyInArrow(add, "part int, cells binary")
    counts = np.zeros(CELLS, np.int64)
    for r in done.toLocalIterator():
        counts[r.part * PART:(r.part + 1) * PART] = np.frombuffer(zlib.decompress(r.cells), np.int64)
    return counts


def _by_rarity(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return tokens[np.argsort(counts[_cell(tokens)], kind="stable")]  # sorted tokens: ties in their order


def choose_boundary(nodes: DataFrame, counts: np.ndarray, percent: int) -> int:
    """The size from which sets are large: least number of subsets named, list entries written and list entries
    met there, over the distinct sets of at most ``SMALLEST_LARGE`` shingles."""
    usual = int(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_sets, met = np.zeros(SMALLEST_LARGE + 1, np.int64), np.zeros(SMALLEST_LARGE + 1, np.int64)
        for batch in batches:
            for small in batch.column(0).to_pylist():
                x = np.array(small, np.int64).view(np.uint64)
                lists = np.maximum(counts[_cell(_by_rarity(x, counts)[:first(len(x), percent)])] - usual, 1)
                n_sets[len(x)] += 1
                met[len(x)] += int(lists.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SMALLEST_LARGE + 1)), pa.array(n_sets), pa.array(met)], ["n", "sets", "met"])

    seen = nodes.where("small IS NOT NULL").select("small").mapInArrow(run, "n long, sets long, met long")
    rows = seen.groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("met").alias("met")).collect()  # SMALLEST_LARGE rows
    n_sets, met = {r.n: r.sets for r in rows}, {r.n: r.met for r in rows}

    def cost(boundary: int) -> int:
        named = sum(n_sets.get(n, 0) * n_subsets(n, boundary, percent) for n in range(1, boundary))
        listed = range(-(-percent * boundary // 100), SMALLEST_LARGE + 1)
        return named + sum(n_sets.get(n, 0) * first(n, percent) + (met.get(n, 0) if n >= boundary else 0) for n in listed)
    return min(range(1, SMALLEST_LARGE + 2), key=cost)


def small_links(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """``(u, v)`` that tie all linked sets below the boundary together.

    A subset's key holds the two sizes that it is for.  Sets of either size under one key are all linked with those of the
    other, so each is tied to the least of the other size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, sets, lesser, greater = [], [], [], []
                for s, small in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    for b in partners(len(small), percent):
                        c = need(len(small), b, percent)
                        if b >= boundary or (b == len(small) == c):  # equal sets are one already
                            continue
                        sizes = b"%d %d " % (min(b, len(small)), max(b, len(small)))
                        for subset in combinations(small, c):
                            keys.append(xxhash.xxh3_128_digest(sizes + np.array(subset, np.int64).tobytes()))
                            sets.append(s)
                            lesser.append(len(small) <= b)
                            greater.append(len(small) >= b)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary()), pa.array(lesser, pa.bool_()),
                                                  pa.array(greater, pa.bool_())], ["key", "s", "lesser", "greater"])

    named = nodes.where(F.col("small").isNotNull() & (F.col("n") < boundary)).select("s", "small")
    named = cut(named.mapInArrow(run, "key binary, s binary, lesser boolean, greater boolean"))
    ends = named.groupBy("key").agg(F.min(F.when(F.col("lesser"), F.col("s"))).alias("one"), F.min(F.when(F.col("greater"), F.col("s"))).alias("other"),
                                    F.min("s").alias("least"), F.max("s").alias("most"))
    ends = cut(ends.where("one IS NOT NULL AND other IS NOT NULL AND least != most").select("key", "one", "other"))
    tied = named.join(ends, "key").select(F.explode(F.array(
        F.when(F.col("lesser"), F.struct(F.col("s").alias("u"), F.col("other").alias("v"))),
        F.when(F.col("greater"), F.struct(F.col("s").alias("u"), F.col("one").alias("v"))))).alias("e"))
    return tied.where("e IS NOT NULL AND e.u != e.v").select("e.u", "e.v").distinct()


def list_entries(docs: DataFrame, text: str, shingle: int, counts: np.ndarray, smallest: int, percent: int) -> DataFrame:
    """``(token, a, np, before)``: the first shingles of every set of at least ``smallest``; ``np`` packs its size and the
    place, ``before`` is the shingle at the place before (null at the first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                tokens, keys, places = [np.empty(0, np.uint64)], [], []
                for t in batch.column(0).slice(at, 512).to_pylist():
                    x = shingles(t, shingle)
                    if len(x) < max(smallest, 1) or (a := _short_of(_key(x))) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(a)
                    k = first(len(x), percent)
                    tokens.append(_by_rarity(x, counts)[:k])
                    keys.append(np.full(k, a, np.int64))
                    places.append(np.arange(k, dtype=np.int64) | (len(x) << 32))
                if keys:
                    token, place = np.concatenate(tokens).view(np.int64), np.concatenate(places)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.concatenate(keys)), pa.array(place),
                                                      pa.array(np.roll(token, 1), mask=(place & 0xFFFFFFFF) == 0)], ["token", "a", "np", "before"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "token long, a long, np long, before long").distinct()


def _close(percent: int, boundary: int) -> Column:
    """Whether list entries ``n, p`` and ``m, q`` may belong to linked sets, by size and place."""
    least = F.expr(f"ceil({percent}L * (n + m) / {100 + percent})")
    size = F.expr(f"100L * least(n, m) >= {percent}L * greatest(n, m) AND greatest(n, m) >= {boundary}")
    return size & (F.expr("least(n - p, m - q)") >= least)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str, shingle: int, percent: int) -> DataFrame:
    """``(u, v)`` of the candidate pairs ``(a, b)`` that are linked, counted on the whole sets."""
    own = nodes.select("a", "s", "t", "n", "f", "wide")
    both = pairs.join(own.toDF("a", "u", "t_u", "n", "f", "wide"), "a").join(own.toDF("b", "v", "t_v", "m", "g", "wide_v"), "b")

    def apart(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda t, i: t + i)
    allowed = F.expr(f"n + m - 2 * ceil({percent}L * (n + m) / {100 + percent})")
    near = (apart("f", "g") <= allowed) & (F.coalesce(apart("wide", "wide_v"), F.lit(0)) <= allowed)
    todo = cut(both.where(near).select("u", "v", "n", "m", "t_u", "t_v"))
    # a bitmap of fixed size, over the hash of one text of each set, keeps most texts that no pair names from being read
    # as shingles and their sets out of the shuffle; it only ever lets too much through
    ends = todo.select(F.col("t_u").alias("t")).union(todo.select("t_v")).select((F.pmod("t", F.lit(FILTER_BITS)) + 1).alias("bit"))
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ends.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect():
        held[(r.k - 1) * 4096:r.k * 4096] = np.frombuffer(r.bits, np.uint8)  # FILTER_BITS bits in all

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            bit = batch.column(1).to_numpy(zero_copy_only=False) % FILTER_BITS
            texts = batch.column(0).filter(pa.array((held[bit >> 3] >> (bit & 7) & 1).astype(bool)))
            for at in range(0, len(texts), 256):
                found = []
                for t in texts.slice(at, 256).to_pylist():
                    x = shingles(t, shingle)
                    key = _key(x)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        found.append((key, x.view(np.int64)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()),
                                                      pa.array([x for _, x in found], pa.list_(pa.int64()))], ["s", "tokens"])

    if not held.any():
        return todo.select("u", "v")
    sets = docs.select(F.col(text).cast("string"), _text_hash(text)).mapInArrow(wanted, "s binary, tokens array<long>")
    sets = cut(sets.groupBy("s").agg(F.first("tokens").alias("tokens")))
    both = todo.join(sets.toDF("u", "x"), "u").join(sets.toDF("v", "y"), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return cut(both.where(F.expr(f"{100 + percent}L") * shared >= F.expr(f"{percent}L * (n + m)")).select("u", "v"))


def meetings(entries: DataFrame, boundary: int, percent: int) -> DataFrame:
    """``(a, b)``, a < b: sets of different components that meet in the list of a shingle.  Two sets whose shingle before is the
    same one have met in its list, so they pass here; they do meet at the first shingle that they share, where the
    places leave most to be shared too.  ``entries``: token, a, n, p, before, root, f."""
    there = entries.toDF("token", "b", "m", "q", "before_b", "root_b", "g")
    allowed = F.expr(f"n + m - 2 * ceil({percent}L * (n + m) / {100 + percent})")
    apart = F.expr("+".join(f"bit_count(f[{k}] ^ g[{k}])" for k in range(NARROW)))
    new = F.expr("a < b AND root != root_b AND (before != before_b OR before IS NULL OR before_b IS NULL)")
    return entries.join(there, (entries.token == there.token) & new & _close(percent, boundary) & (apart <= allowed)).select("a", "b")


def large_links(docs: DataFrame, text: str, shingle: int, nodes: DataFrame, sure: DataFrame, counts: np.ndarray, boundary: int, percent: int) -> DataFrame:
    """``(u, v)`` that, with ``sure``, tie all linked sets together of which one at least is not below the boundary."""
    entries = cut(list_entries(docs, text, shingle, counts, -(-percent * boundary // 100), percent))
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("a", "np"), F.xxhash64("a", "token")).alias("pivot"))
    live = cut(entries.join(lists.where("k > 1").select("token", "pivot"), "token").select(
        "token", "a", "before", "pivot", F.expr("CAST(shiftright(np, 32) AS INT)").alias("n"), F.expr("CAST(np & 4294967295L AS INT)").alias("p")))
    at_pivot = live.where("a != pivot.a").select("a", F.col("pivot.a").alias("b"), "n", "p", F.expr("CAST(shiftright(pivot.np, 32) AS INT)").alias("m"),
                                                 F.expr("CAST(pivot.np & 4294967295L AS INT)").alias("q"))
    pairs = cut(at_pivot.where(_close(percent, boundary)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = sure.union(_verified(pairs, nodes, docs, text, shingle, percent))
    roots = components(found)
    known = cut(nodes.join(roots, nodes.s == roots.node, "left").select("a", F.coalesce("root", "s").alias("root"), "f"))
    here = cut(live.join(known, "a").select("token", "a", "n", "p", "before", "root", "f"))
    rest = cut(meetings(here, boundary, percent).distinct())
    return found.union(_verified(rest, nodes, docs, text, shingle, percent))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row; two documents link at a Jaccard similarity of ``percent`` or more.

    A text of fewer words than ``shingle`` is one shingle.  Null, empty and blank texts have none and link with
    nothing, so each is its own component.  Repeated rows stay, one class.  A null id is never a component's id
    unless all ids of the component are null.  Texts are read whole.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    scanned = cut(scan(docs, doc_id, text, shingle))
    rows = scanned.where("part IS NULL")
    counts = sketch_of(scanned)
    nodes = rows.where("n > 0").groupBy("s").agg(F.min("id").alias("least"), F.min("n").alias("n"), *(F.any_value(c).alias(c) for c in ("t", "small", "f", "wide")))
    nodes = cut(nodes.withColumn("a", _short(F.col("s"))))
    boundary = choose_boundary(nodes, counts, percent)
    edges = large_links(docs, text, shingle, nodes, cut(small_links(nodes, boundary, percent)), counts, boundary, percent)
    roots = components(edges)
    linked = nodes.join(roots, nodes.s == roots.node, "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(linked.join(least, "root").select("s", "component_id"))
    held = rows.select(F.col("id"), "s", F.col("n").cast("long").alias("n_shingles"))
    return held.join(classes, "s", "left").select(
        F.col("id").alias(doc_id), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
