from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mosaiq.llm import substring_dedup, topk
from mosaiq.llm.common import materialise, new_path
from mosaiq.llm.queries import ORACLE_SQL, QUERIES
from mosaiq.llm.shards import ConcurrentCommit, ShardStore


def test_store_keeps_rows_and_merges_small_shards(spark, make_docs, awkward):
    texts, ids = awkward
    store = ShardStore(spark, new_path(spark, "test-shards"), target_bytes=1 << 20, least_bytes=1 << 10)
    docs = make_docs(texts, ids)
    for _ in range(3):
        store.append(docs)
    before = store.entries().count()
    assert store.version() == 3 and before >= 6
    store.compact()
    assert store.version() > 3 and store.entries().count() < before
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.read()) == key(docs.unionByName(docs).unionByName(docs))
    assert key(store.read(1)) == key(docs)
    again = store.version()
    assert store.compact() == again
    store.vacuum(0)
    assert key(store.read()) == key(docs.unionByName(docs).unionByName(docs))


def test_commits_are_atomic_and_never_overwrite(spark, make_docs):
    store = ShardStore(spark, new_path(spark, "test-shards"))
    assert store.version() == 0 and store.entries().count() == 0
    store.append(make_docs(["a"]))
    with pytest.raises(ConcurrentCommit):
        store._commit(0, store.entries(1))
    assert store.version() == 1 and store.read().count() == 1
    with pytest.raises(ValueError, match="columns"):
        store.append(make_docs(["a"]).drop("lang"))


def test_arrivals_of_one_pass_are_versions_of_their_own(spark, make_docs):
    store = ShardStore(spark, new_path(spark, "test-shards"))
    docs = make_docs(["a", "b", None, "d", "e"], [0, 1, 2, 3, None]).withColumn("arrival_no", F.lit("clash"))
    assert store.append_each(docs, F.pmod("doc_id", F.lit(2))) == 3
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.read()) == key(docs) and store.read(1).count() < store.read(2).count() < 5
    assert store.append_each(docs.limit(0), F.lit(1)) == 3


def test_other_writers_lose_nothing(spark, make_docs, monkeypatch):
    store = ShardStore(spark, new_path(spark, "test-shards"), target_bytes=1 << 20, least_bytes=1 << 10)
    docs = make_docs([f"text {k}" for k in range(12)])
    for _ in range(3):
        store.append(docs)
    merge = store._merge

    def overtaken(files):
        run = merge(files)
        if store.version() == 3:
            other = ShardStore(spark, store.path)
            other.append(make_docs(["late"]))
            other.vacuum()  # the merged run is not committed yet
        return run

    monkeypatch.setattr(store, "_merge", overtaken)
    store.compact()
    assert store.read().count() == 37 and store.version() == 5
    base = store.version()
    files = [r.file for r in store.entries(base).select("file").collect()]
    assert not store._replaced([*files, "gone"], store.entries(base), base, 3) and store.version() == base


def test_a_tier_without_gain_does_not_end_compaction(spark, make_docs, monkeypatch):
    store = ShardStore(spark, new_path(spark, "test-shards"), target_bytes=1 << 20, least_bytes=1 << 10)
    docs = make_docs([f"text {k}" for k in range(12)]).repartition(4)
    store.append(docs)
    big = make_docs([random.Random(k).randbytes(8000).hex() for k in range(8)]).repartitionByRange(4, "doc_id")
    store.append(big)
    tiers = {r.tier for r in store.entries().select("tier").distinct().collect()}
    merge, seen = store._merge, []

    def split(files):  # the smallest tier comes out of its merge as it went in
        seen.append(len(files))
        if len(seen) > 1:
            return merge(files)
        run = "merged-same"
        spark.read.parquet(*files).repartition(len(files)).write.parquet(f"{store.path}/data/{run}")
        return run

    monkeypatch.setattr(store, "_merge", split)
    store.compact()
    assert len(tiers) == 2 and len(seen) == 2 and store.version() == 3 and store.read().count() == 20


def test_an_empty_arrival_is_a_version(spark, make_docs):
    store = ShardStore(spark, new_path(spark, "test-shards"))
    store.append(make_docs([]))
    assert store.version() == 1 and store.read().count() == 0 and store.compact() == 1


def brute_top(rows, k=5):
    sound = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in sound:
        if i % 50 == 0:
            scores = sorted((-int((v[: min(len(v), len(u))] * u[: min(len(v), len(u))]).sum()), j) for j, u in sound if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["spread", "clustered", "tiny"])
def test_topk_equals_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 8))
    rows = []
    for i in range(0 if kind == "tiny" else 400):
        v = rng.normal(0, 0.3, 8) if kind == "spread" else centres[i % 6] * rng.uniform(0.2, 3) + rng.normal(0, 0.05, 8)
        rows.append((i, v.astype(np.float32).tolist()))
    rows += [(1000 + k, [1.0] * 8) for k in range(50)] + [(1100, None), (1101, [None] * 8), (1150, [float("nan")] * 8), (1151, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1200, [0.0] * 8), (1250, [-0.5, 2.0])]
    monkeypatch.setattr(topk, "BUCKET", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CHUNK", 3)
    rows += rows[50:53]  # repeated rows are rows
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id bigint, embedding array<float>, score string").repartition(3)
    got = topk.top_products(frame, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows)


def test_coordinates_prune_and_lose_nothing():
    rng = np.random.default_rng(7)
    data = np.floor(256 * (rng.normal(0, 1, (4, 8))[rng.integers(0, 4, 300)] + rng.normal(0, 0.05, (300, 8)))).astype(np.int64)
    bucket = topk._Bucket(300, 8, np.arange(300).tobytes(), data.tobytes())
    queries = topk._Bucket(5, 8, np.arange(5).tobytes(), data[:5].tobytes())
    scores = queries.data @ bucket.data.T
    floors = np.sort(scores, axis=1)[:, -6].astype(np.float64)
    seen = 0
    for q, candidates in topk._candidates(queries, floors, bucket):
        for one in np.atleast_1d(q):
            assert set(np.flatnonzero(scores[one] >= floors[one])) <= set(candidates.tolist())
            seen += len(candidates)
    assert seen < 5 * 300


def test_blocks_of_queries_meet_the_first_chunks_only(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(topk, "BUCKET", 4)
    monkeypatch.setattr(topk, "CHUNK", 2)
    monkeypatch.setattr(topk, "MOST_CHUNKS", 20)
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=3) * (k % 23)).tolist()) for k in range(300)]
    whole = topk._whole(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding", 256.0)
    buckets = topk.materialise(topk._pack(whole, topk.BUCKET), "buckets")
    dealt, reach = topk._chunks(buckets)
    found = dealt.orderBy("chunk").collect()
    n = len(found)
    size = max(2, -(-n // 20))
    assert len(reach) == -(-n // size) <= 20 and reach == sorted(reach, reverse=True)
    assert sorted(r.bucket for r in found) == sorted(r.bucket for r in buckets.collect())
    for r in found:
        assert r.longest <= reach[r.chunk] and (r.chunk + 1 == len(reach) or r.longest >= reach[r.chunk + 1] * (1 - 1e-9))
    # two blocks: one needs a prefix of the chunks, the other none
    blocks = topk.materialise(spark.createDataFrame([(0, 3, float(reach[2])), (1, 0, float("inf"))], "block bigint, last bigint, need double"), "blocks")
    met = topk._meetings(blocks, buckets, dealt).collect()
    assert {r.bucket for r in met} == {r.bucket for r in found if r.longest * (1 + 1e-9) >= reach[2]} and {r.block for r in met} == {0}
    assert {r.chunk for r in met} <= {0, 1, 2}


def test_queries_of_one_id_are_rows_each(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (2, [0.5, 1.0])]
    found = topk.top_products(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2).collect()
    plain = []
    for i, q in rows[:2]:
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i)[:2]
        plain += [(i, k, j, -s) for k, (s, j) in enumerate(scores, 1)]
    assert sorted(map(tuple, found)) == sorted(plain)


def test_topk_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_products(frame, F.col("vec_id") % 50 == 0).count() == 0


def test_spans_are_cut_at_whole_characters():
    data = np.frombuffer("aé日b".encode(), np.uint8)  # a, 2 bytes, 3 bytes, b

    def left(*spans):
        gone = np.zeros(len(data), bool)
        for a, b in spans:
            gone[a:b] = True
        return data[~substring_dedup._at_characters(gone, data)].tobytes().decode()

    assert left((1, 3)) == "a日b" and left((2, 6)) == "aéb" and left((4, 5)) == "aé日b" and left((0, 1), (6, 7)) == "é日" and left() == "aé日b"


def brute_stages(spark, docs, sf_dir):
    """Rows after each filtering stage but the first, which is a network."""
    words = lambda t: (t or "").lower().split()
    rows = [tuple(r) for r in docs.collect()]
    sets = [frozenset(tuple(words(r[1])[k : k + 5]) for k in range(max(1, len(words(r[1])) - 4))) for r in rows]
    kept = []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    groups: list[list[int]] = []
    for i in order:
        near = [g for g in groups if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in g)]
        groups = [g for g in groups if g not in near] + [[j for g in near for j in g] + [i]]
    kept = [rows[min(g, key=order.index)] for g in groups]
    return sorted(kept, key=str)


def test_stages_judge_rows_by_their_own_text(spark, make_docs, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two, three, four, item = text(60), text(60), text(60), text(60), text(24)
    passage = text(30)
    texts = [one, two, one, one + " " + text(2), None, None, three, f"{four} {item}", four, f"{passage} {text(9)}", f"{text(9)} {passage} {text(9)}"]
    ids = [1, 1, 2, 2, 3, None, None, 5, 5, 6, 6]
    docs = make_docs(texts, ids)
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = materialise(corpus_pipeline.near_duplicates(spark, docs, ""), "test-near")
    found = [r for r in near.collect()]
    want = brute_stages(spark, docs.select(*corpus_pipeline.COLUMNS), "")
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in found if r.text is not None) == sorted((r[0] is None, r[0], r[1]) for r in want if r[1] is not None)
    assert [r.doc_id for r in found if r.text is None] == [3] and len(found) == len(want)
    cut = materialise(corpus_pipeline.substring_dedup(spark, near, ""), "test-cut")
    assert cut.count() == near.count()
    rows = {(r.doc_id, r.text) for r in cut.collect()}
    # equal ids are one document, so the passage within id 6 stays; three has no id and stays whole
    assert {(None, three), (3, None), (1, one), (1, two)} <= rows and {(r.doc_id, r.text) for r in near.collect() if r.doc_id == 6} <= rows
    clean = corpus_pipeline.decontamination(spark, cut, str(tmp_path))
    assert {(r.doc_id, r.text) for r in clean.collect()} == {(i, t) for i, t in rows if item not in (t or "")} and clean.count() == cut.count() - 1


def test_stages_take_an_empty_table(spark, make_docs, sf_dir):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_stages_keep_the_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns, name
        kept[name] = docs.count()
        assert docs.filter("n_chars <> length(text)").count() == 0 or name in ("toxicity", "near_duplicates")
    assert kept["toxicity"] >= kept["near_duplicates"] == kept["substring_dedup"] >= kept["decontamination"] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept["decontamination"]


def test_duplicates_stage_leaves_one_of_each_group(spark, make_docs):
    text = "one two three four five six seven eight nine ten " * 20
    docs = make_docs([text, text, text.title(), "something else entirely here now", None, "no id"], [3, 1, 2, 9, 4, None])
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "4", "9", "None"]


def test_duplicates_stage_sorts_no_texts(spark, make_docs):
    texts = [f"some text of number {k} " * 9 for k in range(30)]
    got = corpus_pipeline.near_duplicates(spark, make_docs(texts), "")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan and got.count() == 30
    docs = make_docs([*texts, *texts[:4], texts[0], None, None], [*range(30), *range(4), 0, None, None])
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in got) == [*((False, k, t) for k, t in enumerate(texts)), (True, None, None)]


def test_other_tasks_let_encoders_go():
    from mosaiq.llm.common import trim_memory
    from mosaiq.llm.tokens import encoder, tokenizer_path

    encoder(tokenizer_path("byte_bpe_50k.json")).encode("some words")
    trim_memory()
    assert encoder.cache_info().currsize == 0


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_cut_lineages_can_be_cleared(spark, make_docs):
    from pathlib import Path

    from mosaiq.llm import common

    kept = common._WRITTEN[:]
    del common._WRITTEN[:]
    materialise(make_docs(["a"]), "test-clear")
    (path,) = common._WRITTEN
    assert Path(path.removeprefix("file:")).exists()
    common.clear_shared(spark)
    assert not Path(path.removeprefix("file:")).exists() and common._WRITTEN == []
    common._WRITTEN.extend(kept)
