import public_tokenizers
import pytest

#: Texts with every oddity that an operator must take.
ODD = [None, "", " \n\t", "a", "Don't we'll '' 's", "x" * 5000, "the same text", "the same text", "MiXeD Case ÉÀ 12 ½ ٣", "<|endoftext|>mid<|endoftext|>",
       "  lead and trail  \n\n", "Σίσυφος ς İ ǅ é", "\x00nul\x1csep", "word " * 3000]


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated ids, null ids, repeated rows, and columns whose names operators use themselves."""
    rows = [(k if k % 5 else None, t, f"s{k % 3}", k) for k, t in enumerate(ODD)]
    rows += [rows[3], rows[6], (4, "another text under one id", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, row long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")
