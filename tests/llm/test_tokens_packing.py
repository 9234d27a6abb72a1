from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from mosaiq.llm import packing, token_counts, token_orc
from mosaiq.llm.common import new_path
from mosaiq.llm.tokens import TextEncoder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path, awkward):
    encode = TextEncoder(path).encode
    extra = ["\n", "a\n\nb", "It's 12345 <|endoftext|>", "a\x1cb", "ΑΣ ΑΣ", "a\u0085b", "don't DON'T", "x\r\ny z\r\n", "²³ ½ µ ÿ İ ı", "_a_b __", "é ́x"]
    rng = random.Random(3)
    extra += ["".join(rng.choice("ab \n\t.'é1") for _ in range(40)) for _ in range(200)]
    for text in [t or "" for t in awkward[0]] + extra:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(path, text), repr(text[:60])


def test_unknown_plain_words_do_not_go_through_the_pattern():
    encoder, seen = TextEncoder(BYTE), []

    class Counted:
        def __init__(self, pattern):
            self.findall = lambda t: seen.append(t) or pattern.findall(t)

    encoder.pattern = Counted(encoder.pattern)
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(12)) + rng.choice(["", ",", "."]) for _ in range(300))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(BYTE, text) and len(seen) <= 3


def test_packing_places_every_id_once(make_docs, awkward):
    texts, ids = awkward
    texts = texts + [" ".join(f"w{k % 7}" for k in range(n)) for n in range(0, 900, 13)]
    ids = ids + list(range(100, 100 + len(texts) - len(ids)))
    rows = packing.pack_documents(make_docs(texts, ids), BYTE, windows=3).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in zip(ids, texts, strict=True):
        whole = np.array([*ids_of(BYTE, text), 0], "<u4").tobytes()
        copies = ids.count(doc_id)
        assert sum(r.length for r in by_doc[doc_id]) == copies * len(whole) // 4
        for r in by_doc[doc_id]:
            assert bytes(r.ids) == whole[4 * r.start : 4 * (r.start + r.length)] and r.doc_tokens == len(whole) // 4
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_packing_of_nothing(make_docs):
    assert packing.pack_documents(make_docs([]), BYTE).count() == 0


def test_packer_is_bounded_and_cuts_to_fill():
    packer = packing._Packer(0, 8, 2)
    for k, n in enumerate((5, 5, 5, 3, 20)):
        packer.add(k, bytes(4 * n))
        assert len(packer.open) <= 2
    packer.finish()
    assert sum(p[2] for p in packer.out) == 38
    full = defaultdict(int)
    for p in packer.out:
        full[p[4]] += p[2]
    assert sorted(full.values()) == [6, 8, 8, 8, 8]


def test_orc_round_trip_in_order(spark, make_docs, awkward):
    texts, ids = awkward
    path = new_path(spark, "test-orc")
    token_orc.write_token_orc(make_docs(texts, ids), path, WORD)
    rows = token_orc.ids_crc32(token_orc.read_token_orc(spark, path)).orderBy("start").collect()
    order = sorted(zip(ids, texts, strict=True), key=lambda p: (p[0] is not None, p[0]))
    at = 0
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    for r, (_, text) in zip(rows, order, strict=True):
        want = [*ids_of(WORD, text), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(want, "<u4")))
        at += len(want)


def test_orc_reads_some_documents_with_their_starts(spark, make_docs):
    path = new_path(spark, "test-orc")
    token_orc.write_token_orc(make_docs([f"text {k} " * k for k in range(200)]), path, WORD)
    whole = {r.doc_id: (r.start, list(r.ids)) for r in token_orc.read_token_orc(spark, path).collect()}
    from pyspark.sql import functions as F

    some = token_orc.read_token_orc(spark, path, F.col("doc_id").isin(17, 150))
    assert re.search(r"PushedFilters: \[[^\]]*In\(doc_id", some._jdf.queryExecution().executedPlan().toString())
    assert {r.doc_id: (r.start, list(r.ids)) for r in some.collect()} == {k: whole[k] for k in (17, 150)}


def test_orc_of_nothing(spark, make_docs):
    path = new_path(spark, "test-orc")
    token_orc.write_token_orc(make_docs([]), path, WORD)
    assert token_orc.read_token_orc(spark, path).count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_token_counts_stitch_blocks(spark, make_docs, awkward, block):
    texts = awkward[0]
    path = new_path(spark, "test-flat")
    token_counts.write_flat_tokens(make_docs(texts if block > 6 else [t for t in texts if len(t or "") < 100]).coalesce(1), path, BYTE, 50256)
    rows = token_counts.count_tokens(spark, path, 50256, block).orderBy("doc_no").collect()
    used = texts if block > 6 else [t for t in texts if len(t or "") < 100]
    assert sorted(r.n_tokens for r in rows) == sorted(len(ids_of(BYTE, t)) for t in used)
    assert [r.doc_no for r in rows] == list(range(len(used))) and all(r.terminated for r in rows)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens + 1


def test_token_counts_of_an_open_end_and_an_empty_file(spark, tmp_path):
    (tmp_path / "a").write_bytes(np.array([7, 8, 9, 50256, 50256, 1, 2], "<u2").tobytes() + b"x")
    (tmp_path / "b").write_bytes(b"")
    for block in (2, 4, 100):
        rows = token_counts.count_tokens(spark, str(tmp_path), 50256, block).orderBy("doc_no").collect()
        assert [(r.doc_no, r.start, r.n_tokens, r.terminated) for r in rows] == [(0, 0, 3, True), (1, 4, 0, True), (2, 5, 2, False)]
