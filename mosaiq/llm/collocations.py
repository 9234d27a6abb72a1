"""Operator 12: phrases whose words stand together more often than their parts let expect.

Pieces of texts go to shards of one language each. A shard is a run of positions with one left
free after each piece, so nothing that shifts by one crosses a piece. Each word that is frequent in the whole
language has a position bitmap there, of 16-position blocks of which only those with a bit
are kept. A phrase's bitmap marks where it ends: shifted by one and ANDed with the bitmaps of
the words in the same block it gives all its extensions, whose counts are popcounts. Spark sums them
over the shards; a phrase of k words is looked for only where both its parts of k - 1 words are frequent,
and each shard is told only of frequent phrases that it holds. Within a shard the phrases under some first words are followed to the end
before the next ones are begun, so memory is bounded. Nothing is sent to all executors.

Phrases are arrays of word ids, so equal keys are equal phrases. Languages and words can be as skewed as
they like: shards are cut by size, and what is summed is one row a phrase and shard.

Null text is empty and null lang is ``und``. Repeated rows count as often as they stand there.
No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, remove_path, settle_shuffles, trim_memory

SPACES, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
SLICE_BYTES, SHARD_WORDS = 4 << 20, 1 << 19
#: Positions of a block, and bit pairs of one comparison.
BLOCK, COMPARED = 16, 1 << 19

SHARD = "shard bigint, lang string, n_words bigint, words array<string>, counts array<int>, positions binary"
BITMAPS = "shard bigint, ids array<bigint>, sizes array<int>, blocks binary, masks binary"


def _found_schema(words: int) -> str:
    return "shard bigint, " + ", ".join(f"w{k} bigint" for k in range(1, words + 1)) + ", n bigint"


def _cut(words, fresh, most: int):
    """Ends of runs of about ``most`` words, each where a piece ends."""
    import numpy as np

    begins = np.append(np.flatnonzero(fresh), len(words))
    at, ends = 0, []
    while at < len(words):
        k = np.searchsorted(begins, at + most, "right") - 1
        at = int(begins[k] if begins[k] > at else begins[k + 1])
        ends.append(at)
    return ends


def cut_shards(docs: DataFrame) -> DataFrame:
    """``SHARD``: words of a shard with their numbers and positions, the latter as steps."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from mosaiq.llm.words import byte_kinds, slices, split_words

        kinds, number = byte_kinds(SPACES, STOPS), TaskContext.get().partitionId() << 32
        waiting: dict[str, list] = {}

        def shards(lang, held, whole: bool):
            nonlocal number
            words = pa.concat_arrays([w for w, _ in held])
            fresh = np.concatenate([f for _, f in held])
            begin = 0
            for end in _cut(words, fresh, SHARD_WORDS):
                if not whole and len(words) - begin < SHARD_WORDS:
                    break
                coded = words[begin:end].dictionary_encode()
                codes = coded.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                positions = (np.arange(len(codes)) + np.cumsum(fresh[begin:end]))[order].astype(np.uint32)
                counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int32)
                cells = [number, lang, len(codes), coded.dictionary, counts, _squeezed(np.diff(positions, prepend=np.uint32(0)).astype(np.uint32))]
                kinds_of = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds_of, strict=True)], [x.split()[0] for x in SHARD.split(", ")])
                number, begin = number + 1, end
            waiting[lang] = [(words[begin:], fresh[begin:])] if begin < len(words) else []

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                for lang in part["lang"].unique().to_pylist():
                    words, _, piece = split_words(part.filter(pc.equal(part["lang"], lang))["text"], kinds)
                    if len(words):
                        held = waiting.setdefault(lang, [])
                        held.append((words, np.concatenate(([True], piece[1:] != piece[:-1]))))
                        if sum(len(w) for w, _ in held) >= SHARD_WORDS:
                            yield from shards(lang, held, whole=False)
                if sum(len(w) for held in waiting.values() for w, _ in held) >= 4 * SHARD_WORDS:
                    for lang in [x for x in waiting if waiting[x]]:
                        yield from shards(lang, waiting[lang], whole=True)
        for lang in [x for x in waiting if waiting[x]]:
            yield from shards(lang, waiting[lang], whole=True)
        trim_memory()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, SHARD)


def _bitmaps(shard, listed):
    """Of one shard and the (code, id) of its frequent words: one row of ``BITMAPS``, words by id."""
    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in BITMAPS.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    if not shard.num_rows or not listed.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names)
    counts = shard["counts"].combine_chunks().values.to_numpy().astype(np.int64)
    positions = np.cumsum(_restored(shard["positions"][0].as_py(), int(counts.sum()), np.uint32), dtype=np.uint32).astype(np.int64)
    listed = listed.sort_by("id")
    codes = listed["code"].to_numpy()
    ends = np.cumsum(counts)
    runs = counts[codes]
    of = np.repeat(np.arange(len(codes)), runs)
    at = positions[np.repeat(ends[codes] - runs - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())]
    block, bit = at // BLOCK, np.left_shift(1, at % BLOCK)
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (block[1:] != block[:-1]))))
    masks = np.add.reduceat(bit, first).astype(np.uint16)
    cells = [shard["no"][0].as_py(), listed["id"].to_numpy(), np.bincount(of[first], minlength=len(codes)).astype(np.int32), _squeezed(np.diff(block[first].astype(np.uint32), prepend=np.uint32(0))), _squeezed(masks)]
    trim_memory()
    return pa.table([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names)


def _squeezed(values) -> bytes:
    """Steps of whole numbers, low bytes first and high ones after, compressed."""
    import numpy as np
    import pyarrow as pa

    return pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _restored(data: bytes, n: int, kind):
    import numpy as np
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    planes = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


class Bitmaps:
    """Bitmaps of a shard (a row of ``BITMAPS``), opened: by word, and by block for the words that stand in it."""

    def __init__(self, row):
        import numpy as np

        self.shard, self.ids = row["shard"][0].as_py(), row["ids"][0].values.to_numpy()
        sizes = row["sizes"][0].values.to_numpy()
        self.word = np.repeat(np.arange(len(self.ids), dtype=np.int32), sizes)
        self.ends = np.cumsum(sizes, dtype=np.int64)
        n = int(sizes.sum())
        self.block = np.cumsum(_restored(row["blocks"][0].as_py(), n, np.uint32), dtype=np.uint32).astype(np.int32)
        self.mask = _restored(row["masks"][0].as_py(), n, np.uint16)
        self.by_block = np.argsort(self.block, kind="stable").astype(np.int32)
        n = int(self.block.max()) + 3 if len(self.block) else 3
        self.begins = np.searchsorted(self.block[self.by_block], np.arange(n))

    def of_words(self, first: int, last: int):
        """(word, block, mask) of the words from ``first`` on and before ``last``."""
        a, z = (int(self.ends[k - 1]) if k else 0 for k in (first, last))
        return self.word[a:z], self.block[a:z], self.mask[a:z]

    def extend(self, phrase, block, mask):
        """(phrase, word, block, mask) of all words that follow the ends of phrases, some at a time."""
        import numpy as np

        within, carried = (mask.astype(np.uint32) << 1).astype(np.uint16), mask >> (BLOCK - 1)
        a, b = np.flatnonzero(within), np.flatnonzero(carried)
        phrase, block, mask = np.concatenate((phrase[a], phrase[b])), np.concatenate((block[a], block[b] + 1)), np.concatenate((within[a], carried[b]))
        begin = self.begins[block]
        runs = self.begins[block + 1] - begin
        ends = np.cumsum(runs)
        at = 0
        while at < len(runs):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + COMPARED, "right")))
            some = runs[at:to]
            met = self.by_block[np.repeat(begin[at:to] - (ends[at:to] - some - base), some) + np.arange(some.sum())]
            both = np.repeat(mask[at:to], some) & self.mask[met]
            hit = np.flatnonzero(both)
            source = np.repeat(np.arange(at, to), some)[hit]
            yield phrase[source], self.word[met[hit]], block[source], both[hit]
            at = to


class Phrases:
    """A trie of the listed phrases of a shard, all of one length; a node's key is parent * words + word."""

    def __init__(self, bitmaps: Bitmaps, phrases):
        import numpy as np

        words = np.searchsorted(bitmaps.ids, phrases)
        self.w, self.depth = len(bitmaps.ids), words.shape[1]
        self.keys = [np.arange(self.w)]
        node = words[:, 0]
        for k in range(1, self.depth):
            key = node * self.w + words[:, k]
            self.keys.append(np.unique(key))
            node = np.searchsorted(self.keys[-1], key)
        self.words = np.zeros((len(self.keys[-1]), self.depth), np.int64)
        self.words[node] = words
        # where a leaf's last words, without its first one, stand in the trie
        rest, alive = words[:, 1] if self.depth > 1 else np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for k in range(2, self.depth):
            rest, found = self.child(k - 1, np.where(alive, rest, 0), words[:, k])
            alive &= found
        self.rest = np.full(len(self.words), -1, np.int64)
        self.rest[node] = np.where(alive, rest, -1)

    def child(self, depth: int, node, word):
        """(node at ``depth`` words past the first, whether there is one)."""
        import numpy as np

        keys, key = self.keys[depth], node * self.w + word
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return at, keys[at] == key

    def moved(self, leaf, word):
        """(the leaf of the last words when ``word`` follows, whether it is listed)."""
        import numpy as np

        if self.depth == 1:
            return word.astype(np.int64), np.ones(len(word), bool)
        rest = self.rest[leaf]
        to, found = self.child(self.depth - 1, np.maximum(rest, 0), word)
        return to, found & (rest >= 0)


def _count(bitmaps: Bitmaps, trie: Phrases, longest: int):
    """(words of phrases, numbers) of phrases longer than the listed ones, all of whose runs of their length are listed."""
    import numpy as np

    from mosaiq.llm.words import sums_by_key

    w = len(bitmaps.ids)
    bounds, at = [0], 0
    while at < w:
        at = max(at + 1, int(np.searchsorted(bitmaps.ends, (bitmaps.ends[at - 1] if at else 0) + COMPARED, "right")))
        bounds.append(at)

    def down(k, node, block, mask):
        """(leaf, block, mask) of the listed phrases under nodes of ``k`` words."""
        if k == trie.depth:
            yield node, block, mask
            return
        for node_, word, block_, both in bitmaps.extend(node, block, mask):
            child, found = trie.child(k, node_.astype(np.int64), word)
            yield from down(k + 1, child[found], block_[found], both[found])

    def beyond(words, leaf, phrase, block, mask):
        """Extensions of phrases: their ``words``, the leaf of their last ones, and (phrase, block, mask) of their ends."""
        for phrase_, word, block_, both in bitmaps.extend(phrase, block, mask):
            to, found = trie.moved(leaf[phrase_], word)
            phrase_, word, block_, both, to = phrase_[found].astype(np.int64), word[found], block_[found], both[found], to[found]
            key = phrase_ * w + word
            every, _, n = sums_by_key(key, np.bitwise_count(both).astype(np.int64))
            if not len(every):
                continue
            longer = np.hstack((words[every // w], (every % w)[:, None]))
            yield longer, n
            if longer.shape[1] < longest:
                at = np.searchsorted(every, key)
                leaves = np.zeros(len(every), np.int64)
                leaves[at] = to
                yield from beyond(longer, leaves, at, block_, both)

    for first, last in zip(bounds, bounds[1:], strict=False):
        for leaf, block, mask in down(1, *bitmaps.of_words(first, last)):
            if len(leaf):
                yield from beyond(trie.words, np.arange(len(trie.words)), leaf, block, mask)


def _found(bitmaps: Bitmaps, trie: Phrases, longest: int):
    import numpy as np
    import pyarrow as pa

    names = [x.split()[0] for x in _found_schema(longest).split(", ")]
    for words, n in _count(bitmaps, trie, longest):
        ids = bitmaps.ids[words]
        columns = [pa.array(ids[:, k]) if k < ids.shape[1] else pa.nulls(len(n), pa.int64()) for k in range(longest)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), bitmaps.shard)), *columns, pa.array(n)], names)


def _pairs(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            bitmaps = Bitmaps(batch.slice(at, 1))
            yield from _found(bitmaps, Phrases(bitmaps, bitmaps.ids[:, None]), 2)
    trim_memory()


def _longer(longest: int):
    def find(shard, listed):
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in _found_schema(longest).split(", ")]
        empty = pa.table([pa.array([], pa.int64())] * len(names), names)
        if not shard.num_rows or not listed.num_rows:
            return empty
        phrases = np.stack([listed[c].to_numpy() for c in listed.column_names if c.startswith("w")], axis=1)
        bitmaps = Bitmaps(shard)
        made = pa.Table.from_batches([*empty.to_batches(), *_found(bitmaps, Phrases(bitmaps, phrases), longest)], empty.schema)
        # a phrase may be met in several of the runs that are followed one by one
        made = made.group_by(names[:-1]).aggregate([("n", "sum")]).rename_columns(names)
        trim_memory()
        return made

    return find


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: id, lang, word, f), (phrases of 1 to ``longest`` words: ws, f), (langs: lang, n); f is at least ``least``."""
    spark = docs.sparkSession
    shards = materialise(cut_shards(docs), "collocation-shards")
    langs = materialise(shards.groupBy("lang").agg(F.sum("n_words").alias("n")), "collocation-langs")
    listed = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "t")).select("shard", "lang", "code", F.col("t.words").alias("word"), F.col("t.counts").cast("bigint").alias("n"))
    # all shards' rows of a word meet, and each frequent one goes back with the word's id and sum
    of_word = Window.partitionBy("lang", "word")
    dealt = listed.repartition("lang", "word").withColumn("row", F.monotonically_increasing_id())
    summed = dealt.withColumns({"f": F.sum("n").over(of_word), "id": F.min("row").over(of_word)}).filter(F.col("f") >= least)
    told = materialise(summed.select("shard", "code", "lang", "word", "f", "id", (F.col("row") == F.col("id")).alias("first")), "collocation-told-1")
    words = told.filter("first").select("id", "lang", "word", "f")
    del dealt, summed
    settle_shuffles(spark)
    # texts' positions are dealt by shard once; bitmaps of frequent words alone go on
    maps = materialise(shards.select(F.col("shard").alias("no"), "counts", "positions").groupBy("no").cogroup(told.select("shard", "code", "id").groupBy("shard")).applyInArrow(_bitmaps, BITMAPS), "collocation-bitmaps")
    remove_path(spark, shards.__dict__["mosaiq_path"])
    settle_shuffles(spark)
    phrases = words.select(F.array("id").alias("ws"), "f")
    for k in range(2, longest + 1):
        names = [f"w{i}" for i in range(1, k + 1)]
        met = maps.mapInArrow(_pairs, _found_schema(2)) if k == 2 else maps.groupBy("shard").cogroup(told.select("shard", *names[:-1]).groupBy("shard")).applyInArrow(_longer(k), _found_schema(k))
        of_phrase = Window.partitionBy(*names)
        summed = met.withColumns({"f": F.sum("n").over(of_phrase), "first": F.row_number().over(of_phrase.orderBy("shard")) == 1})
        told = materialise(summed.filter(F.col("f") >= least).select("shard", *names, "f", "first"), f"collocation-told-{k}")
        phrases = phrases.unionByName(told.filter("first").select(F.array(*names).alias("ws"), "f"))
        del met, summed
        settle_shuffles(spark)
    phrases = materialise(phrases, "collocation-phrases")
    remove_path(spark, maps.__dict__["mosaiq_path"])
    return words, phrases, langs


def collocations(docs: DataFrame, longest: int = 5, least: int = 100, share: int = 100, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    ``a`` is a phrase's number, ``l`` and ``r`` those of the parts of its worst cut, and the score
    floor(1000 a n / (l r)). A phrase that a longer one contains is left out when
    the longer one has ``share`` per cent of its occurrences or more.
    """
    words, phrases, langs = frequent_phrases(docs, longest, least)
    size = F.size("ws")
    candidates = phrases.filter(size > 1).withColumnRenamed("f", "a")
    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = candidates.select("ws", "a", k).select("ws", "a", "k", F.slice("ws", F.lit(1), F.col("k")).alias("left"), F.expr("slice(ws, k + 1, size(ws))").alias("right"))
    part = lambda name, f: phrases.select(F.col("ws").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    lang_of = words.select(F.col("id").alias("first"), "lang").join(langs, "lang")
    cuts = cuts.withColumn("first", F.element_at("ws", 1)).join(lang_of, "first")
    # 38 digits hold 1000 a n and l r up to 10^17 words
    score = F.expr("(CAST(1000 AS DECIMAL(38, 0)) * a * n) div (CAST(l AS DECIMAL(38, 0)) * r)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    scored = cuts.groupBy("ws", "a", "lang", "n").agg(worst).select("ws", "a", "lang", "n", "worst.*")

    inner = F.explode(F.sequence(F.lit(2), size - 1)).alias("m")
    within = candidates.filter(size > 2).select("ws", "a", inner).select("ws", "a", "m", F.explode(F.expr("sequence(1, size(ws) - m + 1)")).alias("at"))
    covered = within.groupBy(F.expr("slice(ws, at, m)").alias("ws")).agg(F.max("a").alias("longer"))
    open_ = scored.join(covered, "ws", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))

    spelt = open_.select("*", F.posexplode("ws").alias("at", "id")).join(words.select("id", "word"), "id")
    named = spelt.groupBy("ws", "lang", "a", "l", "r", "n", "score").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = named.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= most)
    return first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
