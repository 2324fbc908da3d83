"""Spelling variant grouping by reduced-alphabet generation.

Letters are hashed to a few symbols.  Each word names the full one-edit neighbourhood of its reduced form and meets
the vocabulary's reduced words there; pairs are verified on the original strings.  One edit leaves the first two
or the last two letters of a word alone, so the letters at that end are part of the key: words that only look
alike when reduced rarely meet.  Shuffled are hashes and words of the vocabulary; no row is emitted per occurrence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsflow.llm.common import cut

SYMBOLS = 8
END = 2                      # letters of the end that an edit leaves alone; 2 * END + 1 letters are the least
HELD = 200_000               # words that a task counts before it hands them on
SHORT = 40                   # letters of a word that is sent itself beside its keys
LETTERS = 1 << 15            # of the words that get their keys together
PLACES = 1 << 16             # of a word that are edited at a time
BASE = np.uint64(0x9E3779B97F4A7C15)  # of the hash of reduced words, odd
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
FILTER_BITS = 1 << 26        # of the bitmap of the vocabulary's keys: 8 MB
FILTER_SHIFT = np.uint64(64 - 26)
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
REDUCED = np.zeros(0x100, np.uint64)
for _c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)):
    REDUCED[_c] = 1 + zlib.crc32(chr(_c).encode()) % SYMBOLS


def damaged(run: str, prefix_crc: int, every: int) -> str:
    """``run`` without one code point if ``every`` divides the crc32 of id, colon and run."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, doc_id: str, text: str, every: int, min_chars: int, min_count: int) -> DataFrame:
    """``(word, n)`` of the corpus; tasks add up their words first, a bounded number at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "k"])
        held: Counter[str] = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not value:
                    continue
                crc = zlib.crc32(f"{key}:".encode())
                lower = value.encode().lower().decode()  # bytes: A-Z only
                for word, k in Counter(_RUN.findall(lower)).items():
                    if len(word) >= min_chars:
                        word = damaged(word, crc, every)
                        if len(word) >= min_chars:
                            held[word] += k
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    source = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("t"))
    counted = source.mapInArrow(run, "word string, k long").groupBy("word").agg(F.sum("k").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _ends(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letters at the start and at the end of each word."""
    def digest(some: np.ndarray, which: int) -> np.ndarray:
        h = np.full(len(some), which, np.uint64)
        for k in range(END):
            h = _mix(h * np.uint64(0x110000) + some[:, k])
        return h
    return digest(letters[:, :END], 1), digest(letters[:, -END:], 2)


def _powers(n: int) -> np.ndarray:
    p = np.full(n + 1, BASE, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)  # modulo 2^64


def neighbourhood(letters: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of all reduced words one edit away from each word, a row per word, each with the letters of the end that the
    edit leaves alone; 0 stands where another edit at the same end gives the same reduced word.

    The hash of a reduced word is a polynomial, so that of a neighbour is put together from sums over its parts.
    Columns come in slices of a bounded number of places."""
    r, (head, tail), (k, n) = REDUCED[letters], _ends(letters), letters.shape
    power = _powers(n)
    sums = np.zeros((k, n + 1), np.uint64)
    np.cumsum(r * power[:n], axis=1, out=sums[:, 1:])
    total = sums[:, -1:]
    yield np.stack([_mix(total[:, 0] + head), _mix(total[:, 0] + tail)], axis=1)  # a letter of the same symbol in its place
    for lo in range(0, n + 1, PLACES):
        at, inner = np.arange(lo, min(lo + PLACES, n + 1)), np.arange(lo, min(lo + PLACES, n))
        end = np.where(at >= END, head[:, None], tail[:, None])
        own = r[:, inner]
        after = np.zeros((k, len(at)), np.uint64)  # the symbol behind the place, 0 at the end of the word
        after[:, :len(inner)] = own
        after[:, at == END - 1] = 0  # there the other end is left alone, so the next edit has another key
        for s in np.arange(1, SYMBOLS + 1, dtype=np.uint64):
            whole = sums[:, at] + s * power[at] + BASE * (total - sums[:, at])
            yield np.where(after == s, np.uint64(0), _mix(whole + end))
            whole = total + (s - own) * power[inner]
            yield np.where(own == s, np.uint64(0), _mix(whole + end[:, :len(inner)]))
        follows = np.zeros_like(own)
        inside = inner[inner < n - 1]
        follows[:, :len(inside)] = r[:, inside + 1]
        follows[:, inner == END - 1] = 0
        whole = sums[:, inner] + BASE_INVERSE * (total - sums[:, inner + 1])
        yield np.where(follows == own, np.uint64(0), _mix(whole + end[:, :len(inner)]))


def listed(letters: np.ndarray) -> Iterator[np.ndarray]:
    """The two keys under which each word of the vocabulary is found."""
    r = REDUCED[letters]
    total = (r * _powers(r.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)
    yield np.stack([_mix(total + end) for end in _ends(letters)], axis=1)


def handle(word: str) -> str:
    """What stands for a word beside its keys: itself if short, else a digest (no word starts with a digit)."""
    if len(word) <= SHORT:
        return word
    import xxhash
    return "0" + xxhash.xxh3_128_hexdigest(word)


def _keys(words: DataFrame, of, name: str, bits: np.ndarray | None = None) -> DataFrame:
    """``(key, word's handle, n)`` for each key that ``of`` gives a word and that ``bits`` do not rule out; keys are
    hashes, as pairs are verified anyway."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                whole = np.flatnonzero(lengths == length)
                step = max(1, LETTERS // length)
                for lo in range(0, len(whole), step):
                    some = batch.take(pa.array(whole[lo:lo + step]))
                    texts = some.column(0).to_pylist()
                    handles = some.column(0) if length <= SHORT else pa.array([handle(w) for w in texts], pa.string())
                    for keys in of(_letters(texts)):
                        live = keys != 0
                        if bits is not None:
                            bit = (keys >> FILTER_SHIFT).astype(np.int64)
                            live &= (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                        at, place = np.nonzero(live)
                        if len(at):
                            rows = pa.array(at)
                            yield pa.RecordBatch.from_arrays([pa.array(keys[at, place].view(np.int64)), handles.take(rows), some.column(1).take(rows)], ["key", name, "n"])
    return words.select("word", "n").mapInArrow(run, f"key long, {name} string, n long")


def _bits(keys: DataFrame) -> np.ndarray:
    """Bitmap of the keys' leading bits, of one size whatever the vocabulary: it only ever lets too much through."""
    where = keys.select((F.shiftrightunsigned("key", int(FILTER_SHIFT)) + 1).alias("bit"))
    where = where.select(F.bitmap_bucket_number("bit").alias("k"), F.bitmap_bit_position("bit").alias("at")).repartition("k")
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in where.groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():  # FILTER_BITS bits in all
        held[(row.k - 1) * 4096:row.k * 4096] = np.frombuffer(row.bits, np.uint8)
    return held


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` for each ordered pair of words exactly one edit apart.

    A bitmap of the vocabulary's keys drops most neighbours that no word has before the shuffle."""
    vocabulary = _keys(words, listed, "near").withColumnRenamed("n", "near_n")
    met = _keys(words, neighbourhood, "word", _bits(vocabulary)).drop("n").join(vocabulary, "key").where("word != near")
    close = F.levenshtein("word", "near", 1) == 1
    digest = F.col("word").startswith("0") | F.col("near").startswith("0")
    # stored, so that the keys are written once for both kinds of pairs
    met = cut(met.select("word", "near", "near_n").where(digest | ((F.abs(F.length("word") - F.length("near")) <= 1) & close)).distinct())
    short = met.where(~digest)
    long = words.where(F.length("word") >= SHORT).select("word")  # a digest may meet a word one letter shorter

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([handle(w) for w in batch.column(0).to_pylist()], pa.string()), batch.column(0)], ["name", "whole"])
    names = long.mapInArrow(named, "name string, whole string")
    rest = met.where(digest).join(names.toDF("word", "w"), "word").join(names.toDF("near", "v"), "near")
    rest = rest.select(F.col("w").alias("word"), F.col("v").alias("near"), "near_n").where(close)
    return short.union(rest)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: the last form of each chain, by doubling the distance in every round.

    A form has a greater count than its word, so there is no cycle."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        state = cut(state.join(ahead, state.root == ahead["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")
        state = state.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 97, min_chars: int = 5,
                      min_count: int = 3, ratio: int = 2) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` per word of the corpus.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (ties: the smallest) if it is
    at least ``ratio`` (2 or more) times as frequent, else null; ``root`` is the last of the chain of forms.
    One in ``every`` pairs of document and word loses a letter first.  Null and empty texts have no words; a null
    id counts as the empty text.  Repeated rows count each.  An empty table gives no row.
    """
    if min_chars < 2 * END + 1:
        raise ValueError(f"min_chars must be {2 * END + 1} or more")
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = cut(count_words(docs, doc_id, text, every, min_chars, min_count))
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = cut(words.join(best, "word", "left").select("word", "n", "n_near", F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(
        F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f")))
    linked = best.where("f IS NOT NULL").select("word", "f.form")
    return best.join(roots(linked), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("f.form").alias("form"),
        F.col("f.form_n").alias("form_n"), F.coalesce("root", "word").alias("root"))
