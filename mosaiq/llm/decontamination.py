"""Operator 9: benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of every training token: documents are cut into blocks of
a few MB, and a row of the index holds one block's sorted terms, their counts and, term by
term, the ascending positions. A block's positions leave a gap between documents, so that no
phrase crosses one. The index is partitioned by documents: each query visits each block, which
needs no shuffle and has no hot terms. In a block a phrase starts from its rarest term; the
offset-adjusted list of the next rarest is intersected with it, and so on to the last.

Null text has no words. Null ids and repeated rows give rows of their own. Items with a null
or empty text have no windows; items with a null id are left out. Empty tables give no rows or
no hits. Other columns are ignored. Benchmarks are searched in slices of ``SLICE_BYTES`` of
text, so what is sent to the executors at once is bounded; a single longer item is a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise

BLOCK_BYTES = 4 << 20
SLICE_BYTES = 8 << 20

INDEX = "block bigint, doc_ids array<bigint>, carried array<string>, n_words array<bigint>, terms binary, counts binary, postings binary"
HITS = "row_key string, doc_id bigint, carried string, n_words bigint, spans array<struct<first:bigint,stop:bigint>>, items array<string>"

#: Every byte that is no part of a word becomes a space; A to Z become a to z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, as UTF-8."""
    return (text or "").encode().translate(WORD_BYTES).split()


class _Block:
    """Words of some documents, turned into one row of the index."""

    def __init__(self):
        self.doc_ids, self.carried, self.n_words, self.words, self.size = [], [], [], [], 0

    def add(self, doc_id, carried, text) -> None:
        words = words_of(text)
        self.doc_ids.append(doc_id)
        self.carried.append(carried)
        self.n_words.append(len(words))
        self.words += words
        self.size += len(text or "") + 64

    def row(self, block: int):
        import numpy as np
        import pyarrow as pa

        terms = sorted(set(self.words))
        number = dict(zip(terms, range(len(terms)), strict=True))
        ids = np.fromiter(map(number.__getitem__, self.words), np.int32, len(self.words))
        order = np.argsort(ids, kind="stable")
        n = np.array(self.n_words, np.int64)
        gaps = np.repeat(np.arange(len(n)), n)  # one free position after each document
        positions = (order + gaps[order]).astype(np.uint32)
        deltas = np.diff(positions, prepend=np.uint32(0))  # wraps around where a term begins
        cells = [block, self.doc_ids, self.carried, self.n_words, b" ".join(terms), np.bincount(ids, minlength=len(terms)).astype(np.uint32).tobytes(), deltas.astype(np.uint32).tobytes()]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], ["block", "doc_ids", "carried", "n_words", "terms", "counts", "postings"])


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: Column | None = None) -> DataFrame:
    """The stored positional index of all documents (``INDEX``); ``carry``: a string kept for each."""

    def build(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for doc in zip(batch["doc_id"].to_pylist(), batch["carried"].to_pylist(), batch["text"].to_pylist(), strict=True):
                block.add(*doc)
                if block.size >= block_bytes:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.doc_ids:
            yield block.row(number)

    kept = F.lit(None) if carry is None else carry
    return materialise(docs.select(F.col("doc_id").cast("bigint"), kept.cast("string").alias("carried"), "text").mapInArrow(build, INDEX), "postings")


class Postings:
    """One row of the index, opened for search."""

    def __init__(self, n_words, terms, counts, postings, wanted):
        import numpy as np

        self.n_words = np.asarray(n_words, np.int64)
        listed = terms.split(b" ") if terms else []
        self.number = {t: k for k, t in enumerate(listed) if t in wanted}
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.positions = np.cumsum(np.frombuffer(postings, np.uint32), dtype=np.uint32).astype(np.int64)
        #: where each document begins: the documents before it, their words and a gap each
        self.begins = np.concatenate(([0], np.cumsum(self.n_words + 1)))[:-1]

    def of(self, term: int):
        return self.positions[self.ends[term] - self.counts[term] : self.ends[term]]

    def phrase(self, terms: list[int]):
        """Positions at which the terms stand one after the other."""
        offsets = sorted(range(len(terms)), key=lambda k: self.counts[terms[k]])
        starts = self.of(terms[offsets[0]]) - offsets[0]
        for k in offsets[1:]:
            if not len(starts):
                break
            starts = starts[_within(starts + k, self.of(terms[k]))]
        return starts

    def near(self, terms: list[int], slop: int):
        """Positions of the rarest term with each other term at most ``slop`` words away in the
        same document."""
        import numpy as np

        order = sorted(set(terms), key=lambda t: self.counts[t])
        found = self.of(order[0])
        doc = np.searchsorted(self.begins, found, "right") - 1
        low, high = self.begins[doc], self.begins[doc] + self.n_words[doc]
        keep = np.ones(len(found), bool)
        for t in order[1:]:
            at = self.of(t)
            nearest = np.searchsorted(at, np.maximum(found - slop, low))
            keep &= (nearest < len(at)) & (at[np.minimum(nearest, len(at) - 1)] <= np.minimum(found + slop, high - 1))
        return found[keep]


def _within(values, sorted_list):
    import numpy as np

    at = np.searchsorted(sorted_list, values)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == values


def _windows(items: list[tuple], size: int | None) -> dict[tuple, list[str]]:
    """Windows of ``size`` words (whole items if None, or if they are shorter) -> their items."""
    found: dict[tuple, set] = {}
    for item_id, text in items:
        words = words_of(text)
        n = len(words) if size is None else min(size, len(words))
        for at in range(len(words) - n + 1) if n else ():
            found.setdefault(tuple(words[at : at + n]), set()).add(str(item_id))
    return {w: sorted(x) for w, x in found.items()}


def _search(index: DataFrame, items: list[tuple], window: int | None, slop: int | None) -> DataFrame:
    import numpy as np

    windows = _windows(items, window)
    vocabulary = sorted({t for w in windows for t in w})
    at = {t: k for k, t in enumerate(vocabulary)}
    keys = list(windows)
    widest = max((len(w) for w in keys), default=1)
    grid = np.full((len(keys), widest), -1, np.int32)
    for k, w in enumerate(keys):
        grid[k, : len(w)] = [at[t] for t in w]
    sent = index.sparkSession.sparkContext.broadcast((vocabulary, grid, [windows[w] for w in keys]))

    def search(batches):
        import numpy as np
        import pyarrow as pa

        vocabulary, grid, owners = sent.value
        wanted = set(vocabulary)
        for batch in batches:
            for row in batch.to_pylist():
                postings = Postings(row["n_words"], row["terms"], row["counts"], row["postings"], wanted)
                known = np.array([postings.number.get(t, -2) for t in vocabulary] + [-1], np.int32)
                there = known[grid]  # -1: beyond the window's end
                spans: list[list] = [[] for _ in row["n_words"]]
                hit_items: list[set] = [set() for _ in row["n_words"]]
                for k in np.flatnonzero((there != -2).all(axis=1)) if len(grid) else ():
                    terms = [int(t) for t in there[k] if t >= 0]
                    found, n = (postings.phrase(terms), len(terms)) if slop is None else (postings.near(terms, slop), 1)
                    for doc, first in zip((np.searchsorted(postings.begins, found, "right") - 1).tolist(), found.tolist(), strict=True):
                        begin = first - int(postings.begins[doc])
                        spans[doc].append((begin, begin + n))
                        hit_items[doc].update(owners[k])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{row['block']}/{k}" for k in range(len(spans))]),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["carried"], pa.string()),
                        pa.array(row["n_words"], pa.int64()),
                        pa.array([[{"first": a, "stop": b} for a, b in merge_spans(s)] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([sorted(x) for x in hit_items], pa.list_(pa.string())),
                    ],
                    ["row_key", "doc_id", "carried", "n_words", "spans", "items"],
                )

    return index.mapInArrow(search, HITS)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ascending spans with the same cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _slices(items: DataFrame, slice_bytes: int):
    """Items by slices of bounded text, each small enough for the driver."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    named = items.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null")
    total, largest = named.agg(F.sum(size), F.max(size)).first()
    if total is None:
        return
    if total <= slice_bytes:
        yield [tuple(r) for r in named.collect()]
        return
    before = Window.orderBy("item_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    cut = materialise(named.withColumn("slice", F.floor(F.coalesce(F.sum(size).over(before), F.lit(0)) / slice_bytes)), "items")
    for k in range(total // slice_bytes + 1):
        if found := cut.filter(F.col("slice") == k).drop("slice").collect():
            yield [tuple(r) for r in found]


def search_index(index: DataFrame, items: DataFrame, window: int | None = 10, slop: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per document of the index: ``HITS``, the merged spans of its hit words and the items hit.

    With ``slop`` a hit is a proximity match (see ``Postings.near``), else an exact phrase.
    """
    made = [_search(index, part, window, slop) for part in _slices(items, slice_bytes)] or [_search(index, [], window, slop)]
    if len(made) == 1:
        return made[0]
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    # a group holds one row a slice of one document
    merged = whole.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.first("carried").alias("carried"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = F.expr(
        "aggregate(all, cast(array() as array<struct<first:bigint,stop:bigint>>), (a, x) -> if(size(a) > 0 and x.first <= a[size(a) - 1].stop,"
        " concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].first as first, greatest(a[size(a) - 1].stop, x.stop) as stop))), concat(a, array(x))))"
    )
    return merged.select("row_key", "doc_id", "carried", "n_words", joined.alias("spans"), "items")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, carry: Column | None = None) -> DataFrame:
    """doc_id, carried, n_words, spans, items, n_hit of every row of ``docs``."""
    hits = search_index(build_index(docs, block_bytes, carry), items, window)
    return hits.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.first)")).drop("row_key")
