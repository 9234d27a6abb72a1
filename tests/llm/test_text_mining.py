"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, term string, block string, shard string, own string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, None, "clash", "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# operator 11

ROWS = [
    (1, "The cat and the dog, the END.", "en", "a"),
    (2, "the cat sat; THE mat", "en", "b"),
    (2, "the cat sat; THE mat", "en", "b"),
    (3, "dog dog dog cat été ÉTÉ", "en", None),
    (4, None, "en", "empty"),
    (5, "", None, None),
    (6, "le chat et le chien", "fr", "a"),
    (7, "le chien 12 34", "fr", "b"),
    (8, "x " * 40_000 + "the", "en", "c"),
    (9, "the x cat dog", "en", "d"),
    (None, "cat\x00cat the", "en", "d"),
    (10, "only one here", "de", "z"),
]


def _plain_divergence(rows, least_docs, most_terms):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lower(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p = share(counts[lang, source])
        whole = share(sum((c for (of, _), c in counts.items() if of == lang), Counter()))
        pairs = [(-sum(abs(p[t] - q[t]) for t in kept), s) for (of, s), q in ((k, share(c)) for k, c in counts.items()) if of == lang and s != source]
        terms = [(whole[t] - p[t], t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:most_terms])):
            out |= {(lang, source, part, item, -value, k) for k, (value, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("least_docs", "most_terms", "terms", "groups"), [(2, 50, 1024, 256), (1, 2, 2, 2), (100, 50, 1024, 256)])
def test_divergence_equals_plain_sums(spark, monkeypatch, least_docs, most_terms, terms, groups):
    from mosaiq.llm import divergence

    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "GROUPS", groups)
    monkeypatch.setattr(divergence, "BROADCAST_LANGS", groups - 2)
    found = divergence.source_divergence(_docs(spark, ROWS), least_docs, most_terms).collect()
    got = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == _plain_divergence(ROWS, least_docs, most_terms)


def test_divergence_of_no_rows(spark):
    from mosaiq.llm.divergence import source_divergence

    assert source_divergence(_docs(spark, [])).collect() == []


def test_shares_are_exact_where_products_pass_64_bits():
    import numpy as np

    from mosaiq.llm.divergence import shares

    counts, total = [0, 7, 10**13, 4 * 10**15], 9 * 10**15
    assert shares(np.array(counts), np.array(total)).tolist() == [1 + 10**9 * (c + 5) // total for c in counts]


def test_op11_on_a_folder(spark, tmp_path):
    from mosaiq.llm.queries import op11_source_divergence

    rows = [(k, f"the word{k % 3} and word{k % 7}", "en" if k % 4 else None, f"s{k % 5}") for k in range(160)]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_source_divergence(spark, str(tmp_path))
    assert set(map(tuple, found.select("lang", "source", "part", "item", "value", "rank").collect())) == _plain_divergence(rows, 30, 50)


# operator 12


def _plain_collocations(rows, longest, least, share, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in held.items():
            if any(len(q) > len(p) and 100 * b >= share * a and inside(p, q) for q, b in held.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (*x[:2], x[2].encode()))
        out |= {(lang, k, p, -a, le, r, n[lang], -s) for k, (s, a, p, le, r) in enumerate(found[:most], 1)}
    return out


PHRASES = [
    *[(k, "New York City is in New York.\nNew york city, york new new new new!", "en", None) for k in range(6)],
    (7, None, "en", None),
    (8, "", None, None),
    (9, "a b\tc  d e f\x0ba b c d e a\x00b . b", None, "s"),
    (9, "a b\tc  d e f\x0ba b c d e a\x00b . b", None, "s"),
    (10, "a b c d e " * 3000, "und", "s"),
    (11, "été ÉTÉ été. ünï ünï; " * 40, "fr", "s"),
    (None, "new york new york", "en", "s"),
]


@pytest.mark.parametrize(("least", "share", "most", "words"), [(2, 100, 2000, 1 << 20), (3, 60, 5, 16), (100, 100, 2000, 500)])
def test_collocations_equal_plain_counts(spark, monkeypatch, least, share, most, words):
    from mosaiq.llm import collocations

    monkeypatch.setattr(collocations, "SHARD_WORDS", words)
    found = collocations.collocations(_docs(spark, PHRASES), 5, least, share, most).collect()
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found]
    assert len(got) == len(set(got))
    assert set(got) == _plain_collocations(PHRASES, 5, least, share, most)


def test_op12_on_a_folder(spark, tmp_path):
    from mosaiq.llm.queries import op12_collocations

    rows = [(k, "one two three, four five six seven. one two! " + "alpha beta gamma delta epsilon zeta " * (k % 3), "en" if k % 5 else None, "s") for k in range(150)]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_collocations(spark, str(tmp_path)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert set(map(tuple, found.collect())) == _plain_collocations(rows, 5, 100, 100, 2000)


def test_collocations_of_no_rows(spark):
    from mosaiq.llm.collocations import collocations

    assert collocations(_docs(spark, [])).collect() == []


def test_bitmaps_follow_phrases_over_blocks_and_not_over_pieces(monkeypatch):
    import random

    import pyarrow as pa

    from mosaiq.llm import collocations as c

    monkeypatch.setattr(c, "COMPARED", 7)
    rng = random.Random(5)
    pieces = [[rng.choice("abcd") for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    positions, at = {w: [] for w in "abcd"}, 0
    for piece in pieces:
        for w in piece:
            positions[w].append(at)
            at += 1
        at += 1
    ordered = [p for w in "abcd" for p in positions[w]]
    import numpy as np

    steps = np.diff(np.array(ordered, np.uint32), prepend=np.uint32(0))
    shard = pa.table({"no": [3], "counts": pa.array([[len(positions[w]) for w in "abcd"]], pa.list_(pa.int32())), "positions": [c._squeezed(steps)]})
    made = c._bitmaps(shard, pa.table({"code": pa.array([0, 1, 2, 3], pa.int32()), "id": [40, 10, 30, 20]}))
    ids = dict(zip("abcd", (40, 10, 30, 20), strict=True))
    bitmaps = c.Bitmaps(made)
    plain = Counter(tuple(ids[w] for w in p[i : i + m]) for p in pieces for m in range(1, 6) for i in range(len(p) - m + 1))

    def counted(trie, longest):
        out = Counter()
        for phrases, n in c._count(bitmaps, trie, longest):
            for p, k in zip(bitmaps.ids[phrases].tolist(), n.tolist(), strict=True):
                out[tuple(p)] += k
        return out

    assert counted(c.Phrases(bitmaps, bitmaps.ids[:, None]), 2) == {k: n for k, n in plain.items() if len(k) == 2}
    # of the phrases of two and three words some are listed; longer ones need all their runs to be
    for depth, longest in ((2, 3), (3, 5)):
        listed = [k for k in plain if len(k) == depth and plain[k] > 2]
        expected = {k: n for k, n in plain.items() if depth < len(k) <= longest and all(k[i : i + depth] in listed for i in range(len(k) - depth + 1))}
        assert counted(c.Phrases(bitmaps, np.array(listed)), longest) == expected and len(expected) > 15


# operator 13


def _plain_choices(text, k, w):
    import xxhash

    def roll(units):
        seed = 42
        for u in units:
            seed = xxhash.xxh64_intdigest(u.to_bytes(8, "little"), seed)
        return seed & 0x7FFFFFFF

    units = [xxhash.xxh64_intdigest(u.encode(), 42) for u in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text.lower())]
    grams = [roll(units[i : i + k]) for i in range(max(1, len(units) - k + 1))] if units else []
    out = []
    for j in range(max(1, len(grams) - w + 1) if grams else 0):
        hash_, at = min((h, -i) for i, h in enumerate(grams[j : j + w], j))
        if (hash_, -at) not in out:
            out.append((hash_, -at))
    return out


def _plain_edits(rows, k, w):
    """By (doc_id, text): all that the query gives."""
    import hashlib

    distinct = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for at, (doc_id, text) in enumerate(distinct):
        after = distinct[(at + 1) % len(distinct)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, following = (_plain_choices(t, k, w) for t in (text, edited, after))
        like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        spelt = lambda x: ".".join(f"{h:x}" for h, _ in x)
        first = lambda x: [h for h, _ in x]
        out[doc_id, text] = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), spelt(own), spelt(other), like(first(own), first(other)), like(first(own), first(following)))
    return out


def test_fingerprints_equal_plain_windows(spark, tmp_path, awkward):
    from mosaiq.llm.queries import op13_fingerprints

    texts, ids = awkward
    rows = [(i, t, "en", None) for i, t in zip(ids, texts, strict=True)]
    rows += [(100 + k, " ".join(f"w{(k * j) % 11}" for j in range(k)), "en", None) for k in range(30)]
    rows.append((103, "w0 w3 w6", "en", None))
    rows = [r for r in rows if r[:2] != (9, None)]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_fingerprints(spark, str(tmp_path))
    got = sorted(map(tuple, found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=repr)
    plain = _plain_edits(rows, 2, 4)
    assert got == sorted((plain[r[0], r[1] or ""] for r in rows), key=repr)


@pytest.mark.parametrize(("k", "w"), [(1, 1), (3, 5), (4, 2)])
def test_fingerprints_keep_positions(spark, k, w):
    from mosaiq.llm.fingerprints import fingerprints

    texts = ["a b a b a b a b c d e f g", "", "one", "a-very-long-word-of-more-than-sixteen " * 5, "ünï cödé 日本語"]
    found = {r["doc_id"]: [tuple(x) for x in r["fingerprint"]] for r in fingerprints(_docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), k, w).collect()}
    assert found == {i: _plain_choices(t, k, w) for i, t in enumerate(texts)}


def test_fingerprints_find_every_long_match(spark):
    import random

    from mosaiq.llm.fingerprints import K, W, fingerprints

    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefgh") + rng.choice("abcdefgh") for _ in range(n)]
    pairs = []
    for _ in range(40):
        shared = words(K + W - 1)
        pairs.append([" ".join(words(rng.randrange(20)) + shared + words(rng.randrange(20))) for _ in range(2)])
    found = {r["doc_id"]: {x["hash"] for x in r["fingerprint"]} for r in fingerprints(_docs(spark, [(2 * i + j, t, None, None) for i, p in enumerate(pairs) for j, t in enumerate(p)])).collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(len(pairs)))


def test_fingerprints_of_no_rows_and_of_one(spark):
    from mosaiq.llm.fingerprints import edited_likeness

    assert edited_likeness(_docs(spark, [])).collect() == []
    (one,) = edited_likeness(_docs(spark, [(4, "abcdef", None, None)])).collect()
    assert (one["edited"], one["near_next"]) == ("abcdab", 1.0)


def test_fingerprints_run_no_python(spark, sf_dir):
    from mosaiq.llm.queries import op13_fingerprints

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = op13_fingerprints(spark, sf_dir)
        plan.write.format("noop").mode("overwrite").save()
        said = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search("Python|Pandas|Arrow", said)
