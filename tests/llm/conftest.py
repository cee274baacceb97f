import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

D = "/root/testdata/sf0.001"
#: Texts that break naive cutting: null, empty, blank, long, odd white space, special strings, many scripts.
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "A b", "  two  spaces ", "<|endoftext|> in a text", "line\nbreak\r\nand\ttab", "x" * 5000, "word " * 3000,
    "Grüße, naïve café! ¿Qué?", "中文字 mixed \U0001f600 text", "a b c", "it's we'll I'd 12345 3.14, (x)", "\x00nul\x1cfs", "tail space ", "e.g. a.b.c!!! ???", "A|B:C;D", "İstanbul ǅ ẞ",
]


@pytest.fixture
def odd(spark):
    """The odd texts with ids, a null id, repeated rows, and extra columns whose names clash with results'."""
    rows = [(i, t, i, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", 7, "y"), (4, "a", 4, "x"), (4, "a", 4, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, kept string")


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
