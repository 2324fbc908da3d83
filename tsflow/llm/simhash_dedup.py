"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint holds, per bit, the majority over the hashes of all word shingles.  Two
documents are linked if their fingerprints differ in at most two bits.

Anchors are the codewords of a covering code: the product of two binary Golay codes (23 bits,
4,096 codewords, covering radius 3, perfect) on bits 0-22 and 23-45; bits 46-63 are not coded.
Each distinct fingerprint has one home, the anchor within radius 3 of it in both blocks, and is
replicated to every anchor within radius 3 + d1 in the first block and 3 + d2 in the second,
d1 + d2 <= threshold.  If two fingerprints differ in d1 + d2 coded bits, the home of the one is
such an anchor of the other, so they meet there; they are compared only there, by an equality
join on the anchor whose condition is the bit distance.  A fingerprint has about 61 anchors of
16.8 million, so work per anchor stays small; copies count once, since fingerprints are distinct.
Distinct fingerprints have at most 2,080 others within two bits, so links are bounded as well.

Components come from label propagation with pointer jumping over the links; every step is a
join, lineage is cut by checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.llm.common import cut

BLOCK, RADIUS = 23, 3
GENERATOR = 0b101011100011   # generator polynomial of the Golay code (a fixed value)
SEED = 42
PART = 1 << 16               # shingles summed at once


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned fingerprint.  ``bytes`` methods lower-case A-Z and split at ASCII blanks only."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        part = np.fromiter((h(b" ".join(words[i:i + shingle]), SEED) for i in range(at, min(at + PART, n))), "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)`` per row; a text without words has fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [doc_id, "fp"])

    out = T.StructType([docs.schema[doc_id], T.StructField("fp", T.LongType())])
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, out)


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(BLOCK - 1, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def patterns(extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight up to radius + extra, grouped by syndrome: their weights over
    the radius (0 for those within it), the patterns, and where each syndrome begins."""
    found = [sum(1 << b for b in bits) for w in range(RADIUS + extra + 1) for bits in combinations(range(BLOCK), w)]
    p = np.array(found, np.int64)
    order = np.argsort(syndromes(p), kind="stable")
    p = p[order]
    over = np.maximum(np.bitwise_count(p).astype(np.int64) - RADIUS, 0)
    return over, p, np.searchsorted(syndromes(p), np.arange(2049))


def near_anchors(block: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of one block: (index of the word, codeword, needed part of the threshold)."""
    over, p, begin = patterns(threshold)
    s = syndromes(block)
    n = begin[s + 1] - begin[s]
    index = np.repeat(np.arange(len(block)), n)
    at = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[s], n)
    return index, block[index] ^ p[at], over[at]


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, is home) of every anchor of each fingerprint."""
    u = fps.astype(np.uint64)
    low = (u & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    high = ((u >> np.uint64(BLOCK)) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    i1, a1, o1 = near_anchors(low, threshold)
    i2, a2, o2 = near_anchors(high, threshold)
    begin, end = np.searchsorted(i2, i1), np.searchsorted(i2, i1, side="right")
    n = end - begin
    left = np.repeat(np.arange(len(i1)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    need = o1[left] + o2[right]
    keep = need <= threshold
    left, right, need = left[keep], right[keep], need[keep]
    return i1[left], (a1[left] << BLOCK) | a2[right], need == 0


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """``(u, v)``, u < v as signed longs: all pairs of distinct fingerprints within the threshold.
    ``fps`` is ``(fp long)``, distinct."""
    if not 0 <= threshold <= 4:
        raise ValueError("the anchor tables are made for thresholds up to 4")

    def spread(homes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = batch.column(0).to_numpy(zero_copy_only=False)
                for at in range(0, len(f), 4096):
                    part = f[at:at + 4096]
                    index, anchor, home = anchors(part.view(np.uint64), threshold)
                    if homes:
                        index, anchor = index[home], anchor[home]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[index])], ["anchor", "fp"])
        return run

    home = fps.mapInArrow(spread(True), "anchor long, fp long").select("anchor", F.col("fp").alias("u"))
    near = fps.mapInArrow(spread(False), "anchor long, fp long").select("anchor", F.col("fp").alias("v"))
    close = F.expr(f"u < v AND bit_count(u ^ v) <= {int(threshold)}")
    return home.join(near, (home.anchor == near.anchor) & close).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``(u, v)``: the smallest node reachable."""
    both = cut(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v"))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("root")))
    while True:
        seen = (both.join(labels.select(F.col("node").alias("v"), "root"), "v")
                .groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near")))
        # stored, so that the join below is between plain shuffles and a hot root can be split
        step = cut(labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        new = cut(step.join(up, "root").select("node", "was", F.least("root", "jump").alias("root")))
        moved = new.where("root != was").limit(1).count()
        labels = new.select("node", "root")
        if not moved:
            return labels


def with_components(marked: DataFrame, doc_id: str, threshold: int = 2) -> DataFrame:
    """``(fp, component_id, keeper)`` per distinct fingerprint of ``marked`` = ``(doc_id, fp)``.

    ``component_id`` is the smallest id of the component, nulls last; ``keeper`` tells whether
    a row of this fingerprint holds it (of fingerprints that share that id, the smallest).
    """
    nodes = cut(marked.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = components(links(nodes.select("fp"), threshold))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(cut(roots.select("root").distinct()), "root", "left_semi")
    best = cut(linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("b")))
    done = rooted.join(best, "root", "left")
    return done.select("fp", F.coalesce(F.col("b.least"), F.col("least")).alias("component_id"),
                       F.coalesce(F.col("b.fp") == F.col("fp"), F.lit(True)).alias("keeper"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row.

    Null, empty and blank texts have fingerprint zero and are linked like any other.  Repeated
    rows stay and share a component.  A null id is never a component's id unless all are null.
    Texts are read whole, in parts of bounded size.
    """
    marked = cut(fingerprints(docs, doc_id, text, shingle))
    groups = with_components(marked, doc_id, threshold)
    return marked.join(groups, "fp").select(
        doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """The rows of ``docs`` of which one stays per component: the one with the smallest id
    (one of them if rows repeat it; any one if all ids are null).  All columns are kept."""
    marked = cut(fingerprints(docs, doc_id, text, shingle))
    groups = with_components(marked, doc_id, threshold)
    keepers = groups.where("keeper").select("fp", F.col("component_id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text)).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*(f.name for f in plain), "__fp"])

    names = docs.columns
    plain = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)]
    rows = docs.toDF(*(f.name for f in plain)).mapInArrow(run, T.StructType([*plain, T.StructField("__fp", T.LongType())]))
    own = f"c{names.index(doc_id)}"
    kept = rows.join(keepers, (rows.__fp == keepers.fp) & rows[own].eqNullSafe(keepers.id), "left_semi")
    return kept.dropDuplicates(["__fp", own]).select(*(f.name for f in plain)).toDF(*names)
