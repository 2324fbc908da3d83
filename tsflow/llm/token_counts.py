"""Token counts by a two-tier map-side lookup.

Tier one is a broadcast hash table from frequent pre-token runs to their token counts.  Tier
two is a cache in each Python worker that is filled by encoding what tier one lacks.  A
pre-token run is a white-space-delimited piece with its leading space; the tokenizer never
joins tokens across such runs, so counts add up.  No pre-token is ever shuffled: the frequent
runs come from one map-side pass over all documents in which each task keeps a bounded
Misra-Gries summary, and only these summaries meet.

The table only decides what is fast, never what is counted.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.llm.common import cut, read_text, special_splitter, white_runs

LONGEST_CACHED = 64      # characters; longer runs are encoded and not kept
_WORKER: dict = {}       # one tokenizer and cache per worker process and vocabulary


class _Lengths(dict):
    """Tier one; ``__missing__`` is tier two."""

    def __init__(self, frequent: dict[str, int], tokenizer, limit: int) -> None:
        super().__init__(frequent)
        self.tokenizer, self.limit, self.cache = tokenizer, limit, {}

    def __missing__(self, run: str) -> int:
        n = self.cache.get(run)
        if n is None:
            n = len(self.tokenizer.encode(run, add_special_tokens=False))
            if len(run) <= LONGEST_CACHED:
                if len(self.cache) >= self.limit:
                    self.cache.clear()
                self.cache[run] = n
        return n


def _trim(counts: Counter, slots: int) -> Counter:
    """Misra-Gries merge step: subtract the count of rank ``slots`` and drop what is left empty."""
    if len(counts) <= slots:
        return counts
    floor = sorted(counts.values(), reverse=True)[slots]
    return Counter({k: v - floor for k, v in counts.items() if v > floor})


def frequent_runs(docs: DataFrame, text: str = "text", slots: int = 16384, keep: int = 65536) -> list[str]:
    """The most frequent runs of the whole corpus, at most ``keep`` of at most 64 characters: all
    that are counted as often as the least power of two that leaves no more."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    counts.update(white_runs(value))
                    if len(counts) > 8 * slots:
                        counts = _trim(counts, slots)
        kept = [(k, v) for k, v in _trim(counts, slots).items() if len(k) <= LONGEST_CACHED]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()),
                                          pa.array([v for _, v in kept], pa.int64())], ["run", "n"])

    summaries = docs.select(F.col(text).cast("string")).mapInArrow(summarise, "run string, n long")
    counts = cut(summaries.groupBy("run").agg(F.sum("n").alias("n")))
    # the table of counts by power of two (at most 64 rows) tells from which count on at most ``keep`` runs are left
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("runs")).collect()
    least, room = None, keep
    for r in sorted(sizes, reverse=True):
        room -= r.runs
        if room < 0:
            break
        least = 2 ** r.power
    return [] if least is None else [r.run for r in counts.where(F.col("n") >= least).select("run").collect()]


def token_counts(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text",
                 slots: int = 16384, keep: int = 65536, cache: int = 1 << 18) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` per row, in input order of rows.

    Null or empty text: 0 bytes, 0 tokens.  Repeated rows are counted row by row; a null id
    stays null.  Strings of special tokens inside a text count as one token each (the
    library's default); nothing is truncated.  Very long texts are counted run by run.
    """
    from tokenizers import Tokenizer
    sc = docs.sparkSession.sparkContext
    definition = read_text(tokenizer_file)
    library = Tokenizer.from_str(definition)
    specials = [t["content"] for t in json.loads(definition)["added_tokens"]]
    runs = frequent_runs(docs, text, slots, keep)
    frequent = {r: len(library.encode(r, add_special_tokens=False)) for r in runs
                if not any(s in r for s in specials)}
    shared = sc.broadcast((definition, frequent))
    key = uuid.uuid4().hex  # of this call: another call has another table

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        definition, frequent = shared.value
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = _Lengths(frequent, Tokenizer.from_str(definition), cache)
        lookup = _WORKER[key].__getitem__
        splitter = special_splitter(specials)

        def tokens(value: str) -> int:
            if splitter is None or not splitter.search(value):
                return sum(map(lookup, white_runs(value)))
            parts = splitter.split(value)  # text, special, text, ...
            return len(parts) // 2 + sum(sum(map(lookup, white_runs(p))) for p in parts[::2])

        for batch in batches:
            texts = batch.column(1)
            n_tokens = pa.array((tokens(t) if t else 0 for t in texts.to_pylist()), pa.int64())
            n_bytes = pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], [doc_id, "n_bytes", "n_tokens"])

    out = T.StructType([docs.schema[doc_id], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(doc_id, F.col(text).cast("string")).mapInArrow(count, out)
