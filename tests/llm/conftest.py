from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, key string"


@pytest.fixture
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", None, None, "clash", "clash") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and very long texts, repeated rows, and white space of all kinds."""
    long = "the long word list goes on and on with some more words " * 3000
    texts = ["plain text, with words.", None, "", " ", "a", "two  spaces\n\nand\tlines\x0b.", long, "ünïcödé ñ 日本語 text", "x" * 5000, "plain text, with words.", "plain text, with words.", "null id"]
    ids = [5, 1, 2, 3, 4, 0, 6, 7, 8, 9, 9, None]
    return texts, ids
