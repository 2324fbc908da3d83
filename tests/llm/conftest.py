import pytest

TEXTS = [
    None, "", " ", "\n\n", "plain words here", "  two  spaces\tand tab\r\n end ", "it's we'll DON'T he'd I've",
    "Ünïcödé façade ﬁn İstanbul ΣΑΣ ǅ x́ ́a", "数字１２３ 漢字かな交じり文", "emoji 👩‍👩‍👧‍👦 ok", "a\x1cb \x1f c\x85d e f　g",
    "<|endoftext|>", "x <|endoftext|> y<|startoftext|>z <|endof", "1234567890 12,345.67 ½ Ⅳ ٣", "word " * 5000, "x" * 30000, "ab" * 5000 + "!" * 700,
    "tail   ", "​zero﻿width", "à̖b Å Å 가", "mixed space   run",
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(3, "repeated id"), (None, "null id")],
                                 "doc_id long, text string").repartition(3)
