"""BPE encoding and decoding with a contiguous rank array.

A word holds its part boundaries in one list and the rank of each adjacent pair in another.
The smallest rank is found by a scan, its boundary deleted, and the two neighbouring ranks
refreshed, until no pair has a rank.  Words are short, so the scan beats a heap; a word of
over ``SHORT`` symbols goes through a heap with the same merge order, so that a very long
word costs n log n.

Each white-space-delimited piece is normalised and split by the tokenizer's own normaliser and
pre-tokenizer (no token crosses white space), merged here, and kept in a bounded worker cache.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.llm.common import read_text, special_splitter, white_words

BITS = 32                # of a token id in a pair
SHORT = 256              # symbols
ROWS = 256               # handed back at once
LONGEST_CACHED = 64      # characters of a piece
NO_RANK = sys.maxsize
_WORKER: dict = {}
#: visible ASCII and the letters of Latin-1, and the pre-tokenizer's pattern on these in lower case
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: the symbols of a letter's UTF-8 bytes, which are Latin-1 letters but for 0x80-0xA0 and 0xAD
_BYTES = {c: "".join(chr(0x143) if b == 0xAD else chr(b) if b > 0xA0 else chr(0x122 + b - 0x80)
                     for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class Recent(dict):
    """A bounded cache of ``make``: when ``limit`` entries are new, older ones unused since go."""

    def __init__(self, make, limit: int) -> None:
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    """Merges of one tokenizer file; ``ignore_merges``, dropout and unknown tokens are not used."""

    def __init__(self, definition: str, cache: int = 1 << 17) -> None:
        from tokenizers import Tokenizer
        spec = json.loads(definition)
        model = spec["model"]
        self.library = Tokenizer.from_str(definition)
        self.ids: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {self.ids[a] << BITS | self.ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.splitter = special_splitter(list(self.specials))
        self.joiner = " " if spec.get("decoder") is None else None
        self.words, self.pieces = Recent(self.word, cache), Recent(self.piece, cache)

    def symbols(self, word: str) -> list[int]:
        """Ids of the single symbols of a pre-token, the last with the word end."""
        return [*map(self.ids.__getitem__, word[:-1]), self.ids[word[-1] + self.suffix]]

    def merge(self, parts: list[int]) -> list[int]:
        """Merge in place.  ``parts[i]`` is the id of the part between boundaries i and i + 1,
        ``ranks[i]`` the rank of merging across boundary i + 1."""
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank_of, merged = self.ranks.get, self.merged
        ranks = [rank_of(a << BITS | b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i] = part = merged[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(part << BITS | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << BITS | part, NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.ranks.get
        parts: list = list(parts)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of(parts[i] << BITS | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or rank_of(parts[i] << BITS | parts[j]) != r:
                continue
            parts[i], parts[j], right[i] = self.merged[r], None, right[j]
            if right[i] < n:
                left[right[i]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] < n and (r := rank_of(parts[a] << BITS | parts[right[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p is not None]

    def word(self, word: str) -> bytes:
        """Token ids of one pre-token (in byte symbols), as little-endian 32-bit integers."""
        ids = array("I", self.merge(self.symbols(word)))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def piece(self, piece: str) -> bytes:
        """Token ids of a piece without white space."""
        if _LATIN.fullmatch(piece):  # normalising is lower-casing there
            words = [w.translate(_BYTES) for w in _LATIN_WORDS.findall(piece.lower())]
        else:
            normalised = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normalised)]
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str) -> bytes:
        pieces = self.splitter.split(text) if self.splitter and self.splitter.search(text) else [text]
        out = []
        for i, part in enumerate(pieces):
            if i % 2:
                out.append(self.specials[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.pieces.__getitem__, white_words(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The library's decode with special tokens kept.  Without a decoder in the file the
        tokens are joined by spaces; other decoders are the library's."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        if self.joiner is None:
            return self.library.decode(list(numbers), skip_special_tokens=False)
        return self.joiner.join(map(self.tokens.__getitem__, numbers))


def _held(definition: str) -> Bpe:
    key = hash(definition)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Bpe(definition)
    return _WORKER[key]


def _check(definition: str) -> None:
    spec = json.loads(definition)
    model = spec["model"]
    normalizer = json.dumps(spec.get("normalizer"))
    if spec.get("post_processor") or model.get("ignore_merges") or model.get("dropout") or "\\\\s+" not in normalizer:
        raise ValueError("only BPE files that drop white space between words are read here")


def encode(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids binary)`` per row: token ids as little-endian unsigned 32-bit integers.

    Null, empty or all-white text: no ids.  Strings of special tokens in a text become these
    tokens (the library's default).  Rows are independent: repeated rows, null ids and very
    long texts need no care, nothing is truncated.
    """
    definition = read_text(tokenizer_file)
    _check(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _held(shared.value)
        for batch in batches:
            ids = pa.array((bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [doc_id, "ids"])

    out = T.StructType([docs.schema[doc_id], T.StructField("ids", T.BinaryType())])
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, out)


def decode(encoded: DataFrame, tokenizer_file: str, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ids (null ids: empty text).
    A column of that name in the input is replaced."""
    definition = read_text(tokenizer_file)
    shared = encoded.sparkSession.sparkContext.broadcast(definition)
    keep = [c for c in encoded.columns if c != "decoded"]
    at = keep.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _held(shared.value)
        for batch in batches:
            texts = pa.array((bpe.decode(b) if b else "" for b in batch.column(at).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*keep, "decoded"])

    out = T.StructType([*(encoded.schema[c] for c in keep), T.StructField("decoded", T.StringType())])
    return encoded.select(*keep).mapInArrow(run, out)


def round_trip(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: ``decode(encode(docs))`` in one pass over the rows."""
    definition = read_text(tokenizer_file)
    _check(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _held(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                ids = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
                texts = pa.array((bpe.decode(b) for b in ids), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), texts], [doc_id, "ids", "decoded"])

    out = T.StructType([docs.schema[doc_id], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(run, out)


def digests(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode, and digest the results."""
    done = round_trip(docs, tokenizer_file, doc_id, text)
    return done.select(doc_id, F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
