from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mosaiq.llm import lm_scoring, toxicity


@pytest.fixture(scope="module")
def scored(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.collect(), lm_scoring.score_documents(docs, classes=128, head=500).collect()


def test_counts_and_base_are_exact(scored):
    docs, rows = scored
    tokens = {d.doc_id: lm_scoring.tokens_of(d.text) for d in docs}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(t for i, ts in tokens.items() if not out[i] for t in ts)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        mine = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(mine), sum(counts[t] > 0 for t in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in mine), rel_tol=1e-9)


def test_trained_model_beats_the_base_on_held_out_texts(scored):
    rows = [r for r in scored[1] if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    noise = np.array([0.5, 0.2, 0.2, 0.1])
    model = lm_scoring.LogBilinear.start(noise, width=6)
    constants = model.constants()
    for a in range(4):
        for b in range(4):
            scores = model.predict(np.array([[a, b]])) @ model.params["target"].T + model.params["bias"]
            assert math.isclose(np.exp(scores - constants[a, b]).sum(), 1, rel_tol=1e-4)


def test_noise_contrastive_estimation_finds_conditionals():
    rng = np.random.default_rng(0)
    walk = [0]
    for _ in range(40_000):
        walk.append((walk[-1] + 1) % 4 if rng.random() < 0.9 else int(rng.integers(4)))
    classes = np.array(walk, np.int32)
    noise = np.bincount(classes) / len(classes)
    model = lm_scoring.LogBilinear.start(noise, width=8)
    before = lm_scoring._contexts(classes, np.array([0]), 0)
    model.train([(classes[k : k + 256], before[k : k + 256]) for k in range(0, len(classes), 256)], noise, 1)
    scores = model.predict(np.array([[1, 0]])) @ model.params["target"].T + model.params["bias"]
    chances = np.exp(scores - model.constants()[1, 0])[0]
    assert chances[2] > 0.75


def test_contexts_do_not_cross_texts():
    got = lm_scoring._contexts(np.array([5, 6, 9, 7, 9], np.int32), np.array([0, 3]), 9)
    assert got.tolist() == [[9, 9], [5, 9], [6, 5], [9, 9], [7, 9]]


def test_model_survives_its_dump():
    model = lm_scoring.LogBilinear.start(np.array([0.5, 0.5]))
    again = lm_scoring.LogBilinear.load(model.dump(), 2)
    assert all((again.params[k] == v).all() for k, v in model.params.items())


def test_lm_takes_awkward_texts(make_docs, awkward):
    texts, ids = awkward
    rows = lm_scoring.score_documents(make_docs(texts, ids), classes=16, head=4).collect()
    assert len(rows) == len(texts) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert not next(r for r in rows if r.doc_id is None).held_out


def test_lm_of_nothing(make_docs):
    assert lm_scoring.score_documents(make_docs([]), classes=8).count() == 0


BAD = ["grubble", "snarkvex", "zornwick"]


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for k in range(n):
        words = [f"w{int(x)}".replace("0", "a").replace("1", "b").replace("2", "c").replace("3", "d") for x in rng.integers(0, 4, rng.integers(5, 150))]
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in words]
        if k % 3 == 0:
            for bad in rng.choice(BAD, 2):
                words[rng.integers(len(words))] = str(bad)
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_network_tells_held_out_texts():
    network = toxicity.train_network(*_texts(400, 1))
    texts, labels = _texts(150, 2)
    windows = toxicity._Windows([toxicity.words_of(t) for t in texts])
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, windows.owner, windows.logits(network))
    right = (1 / (1 + np.exp(-worst)) >= toxicity.THRESHOLD) == np.array(labels)
    assert right.mean() > 0.95


def test_gradients_are_those_of_the_loss():
    windows = toxicity._Windows([[b"ab", b"cde", b"f"] * 30, [b"zz", b"ab"]])
    words, index, mask = windows.cut(np.arange(len(windows.owner)))
    inputs = toxicity.Inputs(words)
    network = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity.Network.start(1).p.items()})
    labels = np.arange(len(windows.owner)) % 2

    def loss():
        _, projected = network.project(inputs)
        logit = network.pool(network.states(projected, index, mask), mask)[3]
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)

    for name, g in network.gradients(inputs, index, mask, labels).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept = network.p[name][at]
        network.p[name][at] = kept + 1e-3
        high = loss()
        network.p[name][at] = kept - 1e-3
        low = loss()
        network.p[name][at] = kept
        assert math.isclose((high - low) / 2e-3, g[at], rel_tol=0.02, abs_tol=1e-6), name


def test_scores_equal_a_plain_forward_pass(make_docs):
    network, (texts, _) = toxicity.Network.start(5), _texts(12, 6)
    p, h = {k: v.astype(np.float64) for k, v in network.p.items()}, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    mix = lambda x: ((x ^ x >> 15) * 0x2C1B3C6D) % 2**32
    rolled = lambda data: sum(b * pow(0x01000193, k + 1, 2**32) for k, b in enumerate(data)) % 2**32

    def vector(word):
        data = b"<" + word + b">"
        grams = []
        for n in (3, 4):
            for k in range(len(data) - n + 1):
                code = 0
                for b in data[k : k + n]:
                    code = (code * 0x01000193 + b) % 2**32
                grams.append(p["grams"][mix((code + n) % 2**32) % toxicity.GRAM_BUCKETS])
        heads = [p["heads"][mix(rolled(data[: n + 1])) % toxicity.HEAD_BUCKETS] for n in toxicity.HEADS]
        return np.concatenate((p["words"][mix(rolled(data)) % toxicity.WORD_BUCKETS], np.mean(heads, axis=0), np.mean(grams, axis=0)))

    def window(words):
        vectors, sides = [vector(w) for w in words], {}
        for side in "fb":
            state, seen = np.zeros(h), []
            for x in vectors if side == "f" else vectors[::-1]:
                given, told = x @ p[f"in_{side}"] + p[f"bias_{side}"], state @ p[f"state_{side}"]
                z, r = sigmoid(given[:h] + told[:h]), sigmoid(given[h : 2 * h] + told[h : 2 * h])
                state = (1 - z) * np.tanh(given[2 * h :] + r * told[2 * h :]) + z * state
                seen.append(state)
            sides[side] = seen if side == "f" else seen[::-1]
        states = [np.concatenate(x) for x in zip(sides["f"], sides["b"], strict=True)]
        weight = np.exp([np.tanh(s @ p["look"] + p["look_bias"]) @ p["weigh"] for s in states])
        return sum(w * s for w, s in zip(weight / weight.sum(), states, strict=True)) @ p["out"] + p["out_bias"][0]

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(make_docs(texts), network).collect()}
    for k, text in enumerate(texts):
        words = text.encode().split()
        n = max(1, len(words) - toxicity.WINDOW + 1)
        starts = sorted({*range(0, n, toxicity.STRIDE), n - 1})
        assert math.isclose(got[k], max(sigmoid(window(words[a : a + toxicity.WINDOW])) for a in starts), rel_tol=1e-4)


def test_digits_and_signs_within_words_are_characters():
    assert toxicity.words_of("You 1D10T, $h*t! (x-y) a.b\x00c") == [b"you", b"1d10t", b"$h*t", b"x-y", b"a", b"b", b"c"]


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 80, 81, 500])
def test_windows_overlap_and_cover(n):
    starts = toxicity.window_starts(n)
    assert {k for s in starts for k in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
    assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_takes_awkward_texts(spark, make_docs, awkward):
    texts, ids = awkward
    docs = make_docs(texts, ids)
    labels = spark.createDataFrame([(5, 0, 1, "clash"), (5, 0, 0, "clash"), (6, None, None, "clash"), (None, 1, 1, "clash"), (9, 1, 0, "clash")], "doc_id bigint, quality int, toxic int, text string")
    sample = toxicity.training_sample(docs, labels)
    assert all(x in (0, 1) for x in sample[1])
    rows = toxicity.score_toxicity(docs, toxicity.train_network(*sample)).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert {(r.score, r.n_windows, r.worst_word) for r in rows if r.doc_id in (1, 2, 3)} == {(0.0, 0, None)}
    assert len({r.score for r in rows if r.doc_id == 9}) == 1


def test_blocks_do_not_change_scores(make_docs, monkeypatch):
    network, (texts, _) = toxicity.Network.start(3), _texts(40, 4)
    whole = {r.doc_id: r.score for r in toxicity.score_toxicity(make_docs(texts), network).collect()}
    windows = toxicity._Windows([toxicity.words_of(t) for t in texts])
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, windows.owner, windows.logits(network))
    assert all(math.isclose(whole[k], 1 / (1 + math.exp(-worst[k])), rel_tol=1e-4) for k in whole)


def test_equal_texts_have_equal_scores_in_any_company():
    network, (texts, _) = toxicity.Network.start(3), _texts(700, 9)
    docs = [toxicity.words_of(t) for t in [*texts, " ".join(texts)]]

    def logits(some):
        windows = toxicity._Windows([docs[k] for k in some])
        found = windows.logits(network)
        return {(some[d], s): v for d, s, v in zip(windows.owner.tolist(), windows.start.tolist(), found.tolist(), strict=True)}

    want = logits(range(len(docs)))
    for some in (range(300, 301), range(0, 700, 7), [*range(650, 200, -1)], [700, 3]):
        got = logits(some)
        assert got and got == {k: want[k] for k in got}


def test_a_word_is_worked_out_once(monkeypatch):
    network, seen, real = toxicity.Network.start(3), Counter(), toxicity.Inputs

    def counted(words):
        seen.update(words)
        return real(words)

    monkeypatch.setattr(toxicity, "Inputs", counted)
    windows = toxicity._Windows([[b"w%d" % (k % 100) for k in range(3 * toxicity.WINDOWS_AT_ONCE * toxicity.STRIDE)]])
    windows.logits(network)
    assert len(seen) == 100 and set(seen.values()) == {1}


def test_what_is_kept_of_words_does_not_change_scores(monkeypatch):
    network, (texts, _) = toxicity.Network.start(3), _texts(90, 4)
    docs = [toxicity.words_of(t) for t in [*texts, *texts[:30]]]
    want = toxicity._Windows(docs).logits(network).tolist()
    for kept in (1, 900, 1 << 17):
        monkeypatch.setattr(toxicity, "KEPT_WORDS", kept)
        reader = toxicity.Reader(network)
        assert [x for k in range(0, 120, 8) for x in reader.logits(reader.windows(docs[k : k + 8])).tolist()] == want
        assert reader.gates.shape[1] < 2 * kept + 1


def test_toxicity_of_nothing(spark, make_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    network = toxicity.train_network(*toxicity.training_sample(make_docs([]), none))
    assert toxicity.score_toxicity(make_docs([]), network).count() == 0


def test_toxicity_learns_from_texts_beyond_the_sample(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", (1, 1))
    texts, marks = _texts(600, 8)
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(600)]
    docs, labels = make_docs(texts), spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    known = toxicity.training_sample(docs, labels, sample=60)
    assert len(known[0]) == 120
    # what makes texts toxic outside the sample stands in none of its texts
    new = [t if t in known[0] or not m else re.sub("|".join(BAD), "plimmet", t) for t, m in zip(texts, marks, strict=True)]
    docs = make_docs([" ".join([t] * 200) if k == 4 else t for k, t in enumerate(new)])  # one text is too long for the sample
    taught = [k for k in range(600) if not held[k]]
    windows = toxicity._Windows([toxicity.words_of(" ".join([new[k]] * 200) if k == 4 else new[k]) for k in taught])
    want = toxicity._tally(windows, np.array([marks[k] for k in taught]))
    got = toxicity.tally_texts(toxicity.training_texts(docs, labels))
    assert all((x == y).all() for x, y in zip(got, want, strict=True)) and got[0].sum() == len(taught)
    networks = toxicity.learn_toxicity(docs, labels, sample=60), toxicity.train_network(*known)
    scores = [{r.doc_id: r.score for r in toxicity.score_toxicity(docs, n).collect() if held[r.doc_id]} for n in networks]
    right, of_sample = [np.mean([(s >= toxicity.THRESHOLD) == marks[k] for k, s in one.items()]) for one in scores]
    assert right > 0.85 and of_sample < 0.75


def test_the_start_is_learnt_by_a_task(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", (1, 1))
    texts, marks = _texts(60, 5)
    docs, labels = make_docs(texts), spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    tally = toxicity.tally_texts(toxicity.training_texts(docs, labels))
    want = toxicity.train_network(*toxicity.training_sample(docs, labels), tally=tally)
    driver, real = os.getpid(), toxicity.train_network

    def elsewhere(*args, **more):
        assert os.getpid() != driver, "the driver holds what learning needs"
        return real(*args, **more)

    monkeypatch.setattr(toxicity, "train_network", elsewhere)
    got = toxicity.learn_toxicity(docs, labels)
    assert all(np.allclose(got.p[k], v, rtol=1e-4, atol=1e-6) for k, v in want.p.items())


def test_the_driver_gives_memory_back(spark):
    from mosaiq.llm.common import release_shuffles

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Pss_Anon:\s+(\d+)", f.read())[1]) // 1024

    cells = [np.zeros(4000, np.uint8) for _ in range(25_000)]  # small enough to stay with the C library
    for cell in cells:
        cell[:] = 1
    kept, before = cells[::100], held()
    del cells, cell
    release_shuffles(spark)
    assert held() < before - 60 and len(kept) == 250
