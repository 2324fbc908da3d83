"""Small helpers shared by the operators: shared folder, text splitting, tokenizer files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsflow.session import checkpoint_dir

#: str.isspace() holds four separators that the Unicode White_Space property does not
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
_RUNS_EXACT = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_NOT_WHITE = re.compile(rf"[^{_WHITE}]+")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder, removed when unused."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def white_runs(text: str) -> list[str]:
    """Split before every single space that starts a word and around other white space.

    The pieces are unions of whole pre-tokens of a byte-level BPE pre-tokenizer, so each
    piece can be encoded by itself.
    """
    return (_RUNS_EXACT if _SEPARATORS.search(text) else _RUNS).findall(text)


def white_words(text: str) -> list[str]:
    """Maximal pieces without Unicode white space."""
    return _NOT_WHITE.findall(text) if _SEPARATORS.search(text) else text.split()


def special_splitter(specials: list[str]):
    """Pattern that splits a text at special tokens and keeps them (None without any)."""
    if not specials:
        return None
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def field(df: DataFrame, name: str):
    return df.schema[name]


# ---- Column helpers (DataFrame functions only) ----

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else (``lower`` does just that where all bytes are ASCII)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, A_Z, a_z))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes of the same columns under different seeds."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]
