import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from tsflow.llm import bpe, token_counts
from tsflow.llm.common import tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def fuzz(n):
    r = random.Random(5)
    chars = "ab Z'st 0,.!\n\t\r\x0b\x1c\x1d\x85  ́éßΣİ漢½🙂<|>"
    return ["".join(r.choice(chars) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_counts_match_the_library(spark, texts):
    lib = Tokenizer.from_file(tokenizer_path(BYTE))
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(fuzz(800))], "doc_id long, text string")
    rows = texts.union(extra).collect()
    got = token_counts.token_counts(texts.union(extra), tokenizer_path(BYTE), slots=50, keep=40, cache=64).collect()
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens) for r in got) == sorted(
        ((r.doc_id or -1), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)


def test_bpe_matches_the_library_and_round_trips(spark, texts):
    lib = Tokenizer.from_file(tokenizer_path(WORD))
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(fuzz(800))], "doc_id long, text string")
    both = texts.union(extra)
    want = []
    for r in both.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(both, tokenizer_path(WORD)).collect()]
    assert sorted(got) == sorted(want)


def test_long_words_merge_in_the_same_order():
    m = bpe.Bpe(open(tokenizer_path(WORD), encoding="utf-8").read())
    r = random.Random(1)
    for _ in range(200):
        w = "".join(r.choice("abcdetinosr") for _ in range(r.randint(1, 60)))
        assert m.merge(m.symbols(w)) == m._merge_long(m.symbols(w))


def test_latin_letters_go_the_short_way():
    lib = Tokenizer.from_file(tokenizer_path(WORD))
    m = bpe.Bpe(open(tokenizer_path(WORD), encoding="utf-8").read())
    for c in map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]):
        for piece in (c, f"a{c}b", f"{c}'s1{c}{c}", f"É{c}!"):
            assert m.encode(piece) == struct.pack(f"<{len(lib.encode(piece, add_special_tokens=False).ids)}I", *lib.encode(piece, add_special_tokens=False).ids)


@pytest.mark.parametrize("schema", ["doc_id long, text string", "doc_id string, text string, n_tokens string, ids string, decoded int"])
def test_empty_tables_and_clashing_columns(spark, schema):
    none = spark.createDataFrame([], schema)
    assert token_counts.token_counts(none, tokenizer_path(BYTE)).count() == 0
    assert bpe.digests(none, tokenizer_path(WORD)).count() == 0


def test_other_files_are_refused(spark, texts):
    with pytest.raises(ValueError):
        bpe.encode(texts, tokenizer_path(BYTE))
