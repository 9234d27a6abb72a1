from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.llm import decontamination, simhash, substring_dedup


def brute_spans(rows, length):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if i is not None and (s not in first or i < first[s]):
                first[s] = i
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1) if i is not None else ():
            if first[data[p : p + length]] < i:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2)
        out.append((i, len(data), tuple(map(tuple, edges.tolist())), bytes(np.frombuffer(data, np.uint8)[~gone])))
    return sorted(out, key=str)


def found_spans(df):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.first, s.stop) for s in r.spans), bytes(r.kept)) for r in df.collect()), key=str)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_substring_dedup_equals_brute_force(make_docs, awkward, block_bytes):
    rng = random.Random(5)
    texts, ids = list(awkward[0]), list(awkward[1])
    texts[6], texts[8] = "the long word list goes on and on " * 40, "x" * 300
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    for k in range(40):
        own = lambda n: "".join(rng.choice("abcd ") for _ in range(rng.randrange(n)))
        texts.append(own(80) + passage[rng.randrange(20) : 60 + rng.randrange(30)] + own(80))
        ids.append(rng.randrange(20, 50))
    rows = list(zip(ids, texts, strict=True))
    assert found_spans(substring_dedup.remove_repeats(make_docs(texts, ids), block_bytes=block_bytes, group_bytes=500)) == brute_spans(rows, 50)


def test_substring_dedup_of_nothing(make_docs):
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0
    assert substring_dedup.remove_repeats(make_docs(["", None])).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=12), st.integers(5, 20), st.booleans())
def test_bucket_pointer_refinement_sorts(strings, depth, packed):
    text = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.repeat(np.cumsum([len(s) for s in strings]), [len(s) for s in strings])
    before = substring_dedup.PACKED_POSITIONS
    try:
        substring_dedup.PACKED_POSITIONS = before if packed else 0
        order = substring_dedup.sort_suffixes(text, ends, depth)
    finally:
        substring_dedup.PACKED_POSITIONS = before
    cut = [text[p : min(ends[p], p + depth)].tobytes() for p in order]
    assert sorted(order.tolist()) == list(range(len(text))) and cut == sorted(cut)


def brute_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < width else [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """Smallest index reachable by links of at most two bits."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 2).tolist():
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, make_docs, awkward, sf_dir):
    texts, ids = list(awkward[0]), list(awkward[1])
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(120).collect()
    texts, ids = [*texts, *[r.text for r in rows]], [*ids, *[1000 + r.doc_id for r in rows]]
    order = sorted((i, t) for i, t in zip(ids, texts, strict=True) if i is not None for t in [t or ""])
    fps = [brute_fingerprint(t) for _, t in order]
    want = {i: (fp, order[c][0]) for (i, _), fp, c in zip(order, fps, brute_components(fps), strict=True)}
    got = simhash.near_duplicates(make_docs(texts, ids)).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.fp % 2**64 == brute_fingerprint("null id")
        else:
            assert (r.fp % 2**64, r.component_id) == want[r.doc_id]


def test_simhash_of_nothing(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize("pair_bucket", [2, 24])
def test_dense_fingerprints_keep_their_components(spark, pair_bucket):
    rng = np.random.default_rng(1)
    values = set()
    for k in range(4):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(80):
            v = base
            for _ in range(rng.integers(0, 6)):
                v ^= 1 << int(rng.integers(0, 12 if k % 2 else 64))
            values.add(v)
    values = sorted(values)
    want = brute_components(values)
    frame = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp bigint")
    roots = {r.node % 2**64: r.root for r in simhash.connected_components(simhash.link_fingerprints(frame, 2, pair_bucket)).collect()}
    groups = lambda keys: sorted(sorted(values[i] for i in range(len(values)) if keys[i] == k) for k in set(keys))
    assert groups(want) == groups([roots.get(v, ("alone", v)) for v in values])


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 2**23 - 1), st.integers(0, 22), st.integers(0, 22))
def test_golay_keys_of_words_two_bits_apart_meet(word, i, j):
    keys = simhash.golay_keys(np.array([word, word ^ (1 << i) ^ (1 << j), word ^ (1 << i)], np.int64))
    assert len(set(keys[0]) & set(keys[1])) > 0 and len(set(keys[0]) & set(keys[2])) > 0
    assert len(set(keys[0].tolist())) in (1, 6)


def test_similar_texts_are_grouped_and_others_are_not(make_docs):
    rng = random.Random(6)
    texts, ids, want = [], [], {}
    for g in range(12):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
        for k in range(4):
            mine = list(words)
            for _ in range(2 * k):  # each changes five shingles: a similarity of 0.8 and more
                mine[rng.randrange(300)] = "changed"
            texts.append(" ".join(mine))
            ids.append(10 * g + k + 1)
            want[ids[-1]] = 10 * g + 1
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(texts, ids)).collect()}
    assert all(got[i] // 10 == i // 10 for i in got)
    assert sum(got[i] == want[i] for i in got) >= 46


def test_crowded_keys_stay_connected(make_docs):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = []
    for _ in range(120):
        mine = list(words)
        mine[rng.randrange(300)] = "".join(rng.choice("ijkl") for _ in range(6))
        texts.append(" ".join(mine))
    assert {r.component_id for r in simhash.similar_groups(make_docs(texts)).collect()} == {0}


def random_words(rng, n, letters="abcdefgh"):
    return ["".join(rng.choice(letters) for _ in range(6)) for _ in range(n)]


def brute_similar(texts, similarity=0.8, width=5):
    sets = []
    for t in texts:
        words = t.lower().split()
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))})
    roots = list(range(len(texts)))
    find = lambda i: i if roots[i] == i else find(roots[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-9:
                low, high = sorted((find(i), find(j)))
                roots[high] = low
    return [find(i) for i in range(len(texts))]


def test_every_similar_pair_is_found_among_strangers(make_docs):
    rng = random.Random(11)
    texts = []
    for _ in range(150):  # pairs of a similarity of about 0.86
        words = random_words(rng, 400)
        other = list(words)
        for at in range(20, 400, 65):
            other[at] = "other"
        texts += [" ".join(words), " ".join(other)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(texts)).collect()}
    assert [got[i] for i in range(300)] == [i - i % 2 for i in range(300)]


@pytest.mark.parametrize("most", [0, 7, 1 << 20])
def test_listed_shingles_are_the_most_frequent(make_docs, monkeypatch, most):
    monkeypatch.setattr(simhash, "FREQUENT", most)
    texts = [f"{'all of these words open every text ' * 2} {'some of them go on like this' if k < 4 else 'x'} own{k}" for k in range(9)]
    sets = [simhash.shingle_set(t.encode().split(), 5).tolist() for t in texts]
    have = Counter(s for one in sets for s in one)
    listed, counts = simhash._frequent(make_docs(texts), 5)
    assert listed.tolist() == sorted(listed.tolist()) and len(listed) <= most
    assert all(have[s] == n >= simhash.OFTEN for s, n in zip(listed.tolist(), counts.tolist(), strict=True))
    if most > 100:
        assert set(listed.tolist()) == {s for s, n in have.items() if n >= simhash.OFTEN}
    elif len(listed):
        assert min(counts) > 4


@pytest.mark.parametrize("often", [3, 10**9])
def test_crowded_keys_of_unlike_texts_are_searched_whole(make_docs, monkeypatch, often):
    monkeypatch.setattr(simhash, "OFTEN", often)
    rng = random.Random(13)
    line, texts = random_words(rng, 60), []
    for _ in range(50):  # one line opens all; the ends make pairs, some of them just similar enough
        end = random_words(rng, 60)
        for k in range(2):
            mine = list(end)
            for _ in range(k * rng.randrange(8)):
                mine[rng.randrange(60)] = rng.choice("uvw")
            texts.append(" ".join(line + mine))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(texts)).collect()}
    want = brute_similar(texts)
    assert [got[i] for i in range(100)] == want and len(set(want)) < 90


@pytest.mark.parametrize(("changed", "linked"), [(8, True), (10, False)])
def test_texts_near_the_threshold_are_told_apart(make_docs, changed, linked):
    rng, texts = random.Random(17), []
    for _ in range(40):  # a change is of five shingles of 396: similarities of 356 / 436 and 346 / 446
        words = random_words(rng, 400)
        other = list(words)
        for k in range(changed):
            other[20 + 38 * k] = "other"
        texts += [" ".join(words), " ".join(other)]
    want = brute_similar(texts)
    assert (want == [i - i % 2 for i in range(80)]) is linked and (want == list(range(80))) is not linked
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(texts)).collect()}
    assert [got[i] for i in range(80)] == want


def test_a_repeated_line_does_not_make_texts_similar(make_docs):
    rng = random.Random(19)
    line = random_words(rng, 9)
    texts = [" ".join(line * 40 + random_words(rng, 150)) for _ in range(6)]
    got = simhash.similar_groups(make_docs(texts)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len({r.fp for r in got}) == 6


@pytest.mark.parametrize("easy", [0, 10**9])
def test_rounds_of_stars_change_no_result(make_docs, monkeypatch, easy):
    monkeypatch.setattr(simhash, "EASY", easy)
    rng, texts = random.Random(23), []
    line = random_words(rng, 40)
    for _ in range(8):
        base = random_words(rng, 60)
        for _ in range(6):
            mine = list(base)
            for _ in range(rng.randrange(5)):
                mine[rng.randrange(60)] = rng.choice("uvw")
            texts.append(" ".join(line + mine))
    got = {r.doc_id: r for r in simhash.similar_groups(make_docs(texts)).collect()}
    assert [got[i].component_id for i in range(48)] == brute_similar(texts)
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.values())


def test_pairs_that_meet_hold_every_similar_one(make_docs):
    rng, texts = random.Random(29), []
    words = random_words(rng, 120)
    for _ in range(40):  # copies with up to four changes, which spread over both sides of the threshold
        mine = list(words)
        for _ in range(rng.randrange(1, 5)):
            mine[rng.randrange(120)] = "".join(rng.choice("ijkl") for _ in range(6))
        texts.append(" ".join(mine))
    found = simhash._sets_with_keys(make_docs(texts), 5, 0.8).drop("doc_id", "sim")
    told = simhash.materialise(found.select("*", F.col("fp").alias("root"), F.posexplode("keys").alias("place", "key")), "told")
    met = [(r.a, r.b) for r in simhash._meeting(told, told, 0.8, F.col("x.fp") < F.col("y.fp")).collect()]
    plain = told.alias("x").join(told.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & simhash._may_be_similar(0.8)).count()
    sets = {int(np.uint64(fp).view(np.int64)): set(one.tolist()) for one, fp in (simhash._of_text(t, 5) for t in texts)}
    similar = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    assert similar and similar <= set(met) and 2 * len(met) < plain


def test_similar_groups_take_awkward_texts(make_docs, awkward):
    texts, ids = awkward
    got = simhash.similar_groups(make_docs(texts, ids)).collect()
    assert len(got) == len(texts) and {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (5, 9)} == {5} and [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.similar_groups(make_docs([])).count() == 0


def brute_hits(docs, items, window):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        words = split(text)
        n = min(window, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(item))
    out = []
    for i, text in docs:
        words, hit, found = split(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        out.append((i, len(words), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block_bytes", "slice_bytes"), [(100, 1 << 20), (1 << 20, 150)])
def test_decontamination_equals_brute_force(spark, make_docs, awkward, block_bytes, slice_bytes):
    rng = random.Random(2)
    texts, ids = list(awkward[0]), list(awkward[1])
    items = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "one two, THREE"), (2, ""), (3, None), (4, "plain text"), (None, "two"), (11, "one two three one two three one two three one two three")]
    for k in range(30):
        texts.append(" ".join(rng.choice(["one two three", "four five six seven eight nine ten", "eleven twelve", "plain-text", "zzz"]) for _ in range(12)))
        ids.append(100 + k)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    index = decontamination.build_index(make_docs(texts, ids), block_bytes)
    got = decontamination.search_index(index, bench, 10, slice_bytes=slice_bytes)
    rows = sorted(((r.doc_id, r.n_words, sum(s.stop - s.first for s in r.spans), tuple(r["items"])) for r in got.collect()), key=str)
    assert rows == brute_hits(zip(ids, texts, strict=True), [x for x in items if x[0] is not None], 10)


def test_proximity_stays_within_documents(spark, make_docs):
    docs = make_docs(["alpha x x beta", "alpha", "beta", "beta alpha x x x x x x beta"])
    bench = spark.createDataFrame([(1, "alpha beta")], "item_id bigint, text string")
    index = decontamination.build_index(docs)
    hits = {r.doc_id: r["items"] for r in decontamination.search_index(index, bench, None, slop=3).collect()}
    assert hits == {0: ["1"], 1: [], 2: [], 3: ["1"]}
    assert not any(r["items"] for r in decontamination.search_index(index, bench, None).collect() if r.doc_id < 3)


def test_decontamination_of_nothing(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.decontaminate(make_docs([]), none).count() == 0
    assert [r.n_hit for r in decontamination.decontaminate(make_docs(["a b"]), none).collect()] == [0]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_runs_do_not_depend_on_the_chunk(monkeypatch, chunk):
    docs = [b"", b"x" * 90, b"the quick brown fox jumps over the lazy dog again and again " * 3, b"short", b"the quick brown fox jumps over the lazy dog again and again " * 2, b"x" * 50]
    ids = [4, 1, 2, None, 3, 9]
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    runs = substring_dedup._Runs(b"".join(docs), [len(d) for d in docs], ids, 50, 24)
    at = np.repeat(runs.start, runs.size) + np.arange(runs.size.sum()) - np.repeat(np.cumsum(runs.size) - runs.size, runs.size)
    begins = np.cumsum([0, *map(len, docs)])
    wanted = [begins[k] + p for k, d in enumerate(docs) if ids[k] is not None for p in range(len(d) - 49)]
    assert at.tolist() == wanted
    data, keys = b"".join(docs), {}
    for start, size, key in zip(runs.start.tolist(), runs.size.tolist(), runs.key.tolist(), strict=True):
        for p in range(start, start + size):
            assert keys.setdefault(data[p : p + 50], key) == key
