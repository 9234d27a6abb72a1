"""Operator 11: how far the sources of a language are from each other and from the language.

Terms that are in enough documents of a language have a smoothed share in each (language, source)
group and in the language. Shares are whole billionths, so all sums are exact. Terms are dealt to
blocks by hash, groups as well where a language has many. A tile is the dense matrix of the
groups of two group blocks by the terms of a block: its pairs of rows are compared by
broadcasting, and give one partial sum a pair; its rows give a heap of the terms that a group
has more of than the language. Partial sums are added by Spark, heaps are merged within tasks
first and by group then. No tile holds more than its share of terms, whatever the group's size.

Null lang, source and text count as empty. A group without terms is compared like any other, with
the share that smoothing gives. Repeated rows count as often as they stand there. A table of no rows
has no groups. Other columns are ignored. Counts are exact up to 9 * 10^15 terms a language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise

UNIT, ADDED = 10**9, 5
#: Terms of a tile, and groups of a group block, on average.
TERMS, GROUPS = 1024, 256
#: Text that is cut into terms at once, cells of one comparison, counts that a task gathers.
SLICE_BYTES, CELLS, GATHERED = 4 << 20, 1 << 21, 400_000
#: Languages whose few figures are sent to all; beyond these they are joined by shuffle.
BROADCAST_LANGS = 1 << 16

COUNTED = "lang string, source string, term string, n bigint, docs bigint"
TILED = "lang string, source string, part string, item string, value bigint"


def count_terms(docs: DataFrame) -> DataFrame:
    """``COUNTED``: occurrences and documents of each term of each group, summed."""

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from mosaiq.llm.words import byte_kinds, slices, split_words, sums_by_key

        kinds = byte_kinds([b for b in range(128) if not chr(b).isalpha()])
        names = [x.split()[0] for x in COUNTED.split(", ")]

        def merged(tables):
            sums = pa.concat_tables(tables).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
            return sums.rename_columns([c.removesuffix("_sum") for c in sums.column_names]).select(names)

        held, rows = [], 0
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                words, doc, _ = split_words(part["text"], kinds)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                lang, source = (pc.fill_null(part[c], "").dictionary_encode() for c in ("lang", "source"))
                n_terms, n_sources = len(coded.dictionary), len(source.dictionary)
                group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
                in_docs, n, *_ = sums_by_key(doc * n_terms + coded.indices.to_numpy())
                at, n_docs, n = sums_by_key(group[in_docs // n_terms] * n_terms + in_docs % n_terms, n)
                of, term = np.divmod(at, n_terms)
                taken = [lang.dictionary.take(pa.array(of // n_sources)), source.dictionary.take(pa.array(of % n_sources)), coded.dictionary.take(pa.array(term))]
                held.append(pa.table([*taken, pa.array(n.astype(np.int64)), pa.array(n_docs.astype(np.int64))], names))
                rows += len(at)
                if rows > GATHERED:
                    held = [merged(held)]
                    rows = held[0].num_rows
                    if rows > GATHERED // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts, totals):
    """1 + floor(UNIT * (counts + ADDED) / totals), by long division: no product passes 64 bits."""
    import numpy as np

    quotient, rest = np.divmod(counts + ADDED, totals)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + digits
    return 1 + quotient


def pair_distances(p):
    """Sums of absolute differences of all pairs of rows, by broadcasting some columns at a time."""
    import numpy as np

    out, step = np.zeros((len(p), len(p)), np.int64), max(1, CELLS // max(1, len(p) ** 2))
    for at in range(0, p.shape[1], step):
        part = p[:, at : at + step]
        out += np.abs(part[:, None, :] - part[None, :, :]).sum(axis=2)
    return out


def _merge_heaps(most: int):
    """Of ``TILED`` rows the first ``most`` of each group, by value downwards and item."""
    import heapq

    def merge(batches):
        import pyarrow as pa

        heaps: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                heaps.setdefault((r["lang"], r["source"], r["part"]), []).append((-r["value"], r["item"].encode()))
            heaps = {k: heapq.nsmallest(most, v) if len(v) > most else v for k, v in heaps.items()}
        rows = [(*k, item.decode(), -value) for k, v in heaps.items() for value, item in v]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], [x.split()[0] for x in TILED.split(", ")])

    return merge


def _tile(most_terms: int):
    def tile(key, cells, groups):
        import heapq

        import numpy as np
        import pyarrow as pa

        lang, _, first, second = (k.as_py() for k in key)
        groups = groups.sort_by("source")
        names, own = groups["source"].to_pylist(), groups["own"].to_numpy()
        n_terms, v = groups["n_terms"][0].as_py(), groups["v"][0].as_py()
        totals = groups["total"].to_numpy() + ADDED * v
        rows: list[tuple] = []
        found = np.zeros((len(names), len(names)), np.int64)
        if v:
            coded = cells["term"].combine_chunks().dictionary_encode()
            terms = coded.dictionary.cast(pa.binary()).to_pylist()
            number = dict(zip(names, range(len(names)), strict=True))
            at, term = np.array([number[s] for s in cells["source"].to_pylist()], np.int64), coded.indices.to_numpy()
            counts = np.zeros((len(names), len(terms)), np.int64)
            counts[at, term] = cells["n"].to_numpy()
            p = shares(counts, totals[:, None])
            # terms of the block that none of these groups has
            none = shares(np.zeros((len(names), 1), np.int64), totals[:, None])
            found = pair_distances(p) + (n_terms - len(terms)) * pair_distances(none)
            if first == second:
                of_lang = np.zeros(len(terms), np.int64)
                of_lang[term] = cells["n_lang"].to_numpy()
                more = p - shares(of_lang, groups["lang_total"][0].as_py() + ADDED * v)
                for k, name in enumerate(names):
                    mine = np.flatnonzero((counts[k] > 0) & (more[k] > 0))
                    heap = heapq.nsmallest(most_terms, zip((-more[k, mine]).tolist(), [terms[t] for t in mine], strict=True))
                    rows += [(lang, name, "term", item.decode(), -value) for value, item in heap]
        a, b = np.nonzero((own[:, None] == first) & (own[None, :] == second) & ~np.eye(len(names), dtype=bool))
        rows += [(lang, names[i], "pair", names[j], int(found[i, j])) for i, j in zip(a, b, strict=True) if first != second or i < j]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()], strict=True)], [x.split()[0] for x in TILED.split(", ")])

    return tile


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank: see the head of this module.

    ``pair``: each other source and its distance from this one. ``term``: the ``most_terms`` terms
    whose share is furthest above that in the language.
    """
    of_term = Window.partitionBy("lang", "term")
    counted = count_terms(docs).withColumns({"in_docs": F.sum("docs").over(of_term), "n_lang": F.sum("n").over(of_term)})
    kept = materialise(counted.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang"), "divergence-terms")
    none = F.lit(0).cast("bigint")
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).groupBy("lang", "source").agg(F.count("*").alias("_rows"))
    groups = materialise(named.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", none).alias("total")), "divergence-groups")
    terms = kept.groupBy("lang", "term").agg(F.max("n_lang").alias("n"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).alias("group_blocks")).join(terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total")), "lang", "left")
    sizes = materialise(sizes.select("lang", "group_blocks", F.coalesce("v", none).alias("v"), F.coalesce("lang_total", none).alias("lang_total"), F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).alias("blocks")), "divergence-langs")
    langs = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes

    block, own = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.pmod(F.xxhash64("source"), F.col("group_blocks"))
    met = F.explode(F.sequence(none, F.col("group_blocks") - 1)).alias("other")
    both = (F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    in_block = terms.join(langs, "lang").groupBy("lang", block).agg(F.count("*").alias("n_terms"))
    cells = kept.join(langs, "lang").withColumn("own", own).select("lang", block, "own", met, "source", "term", "n", "n_lang")
    cells = cells.select("lang", "block", *both, "source", "term", "n", "n_lang")
    heads = groups.join(langs, "lang").withColumn("own", own).select("*", met).select("*", *both, F.explode(F.sequence(none, F.col("blocks") - 1)).alias("block"))
    heads = heads.join(in_block, ["lang", "block"], "left").select("lang", "block", "first", "second", "source", "own", "total", "v", "lang_total", F.coalesce("n_terms", none).alias("n_terms"))

    keys = ["lang", "block", "first", "second"]
    tiles = materialise(cells.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(_tile(most_terms), TILED), "divergence-tiles")
    half = tiles.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    pairs = half.select("lang", "part", "value", ways).select("lang", "way.source", "part", "way.item", "value")
    merge = _merge_heaps(most_terms)

    def merge_group(table):
        import pyarrow as pa

        return pa.Table.from_batches(list(merge(table.to_batches())))

    tops = tiles.filter("part = 'term'").mapInArrow(merge, TILED).groupBy("lang", "source").applyInArrow(merge_group, TILED)
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(tops).withColumn("rank", rank)
