"""Operator 3: exact removal of repeated byte strings, by suffix sorting.

A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller
id. Documents are cut into blocks of a few MB that never split a document. Each start position
has a key, the smallest hash of the grams in its string, so equal strings have equal keys and
neighbouring positions mostly share one. Three rounds follow, each linear in the text:

1. blocks name their distinct keys; keys of one document only need no more work;
2. runs of positions under the other keys travel, once a block and string, to the groups that
   own their keys, and each group sorts the suffixes of its strings by bucket-pointer
   refinement; suffixes that agree on ``length`` bytes stand together and learn the smallest id;
3. blocks learn by one bit a position whether a smaller document elsewhere holds the string.

Bucket-pointer refinement: suffixes are put in buckets by their first q bytes; then each bucket
of more than one is sorted by the buckets of the suffixes some bytes later. New pointers are
written at once and used by the buckets refined after them, so depth at least doubles a round.

A hot passage costs one entry a block, however many documents hold it. Null text is empty.
Documents shorter than ``length`` keep all. Rows with a null id neither lose nor take anything.
Repeated ids are one document: equal ids are not smaller. Each input row gives one output row.
An empty table gives no rows. Other columns are ignored, unless ``carry`` names them: then they
travel beside their own row's text. With ``whole_characters`` a span is drawn in to the
characters that lie wholly within it, so the bytes left are UTF-8.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, release_shuffles, total_bytes, trim_memory

LENGTH, GRAM = 50, 24
BLOCK_BYTES = 4 << 20
#: Text for each group of keys; a group then sorts some hundred kB of suffixes.
GROUP_BYTES = 2 << 20
LEAST_GROUPS = 64
KEY_BITS = 48
#: Positions, or runs, of a block that are worked on at a time.
CHUNK = 1 << 18
#: Text for each task that applies the replies to its blocks.
TASK_BYTES = 16 << 20
#: Positions up to which two bucket pointers and a position fit into one 64-bit sort key.
PACKED_POSITIONS = 1 << 21

BLOCKS = "block bigint, doc_ids array<bigint>, sizes array<bigint>, payload binary, carried binary"
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<first:bigint,stop:bigint>>, kept binary"


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _rows(batches):
    """One row at a time, so that no second copy of a whole batch stands in memory."""
    for batch in batches:
        for k in range(len(batch)):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(names_types: dict, cells: list[tuple]):
    import pyarrow as pa

    columns = zip(*cells, strict=True) if cells else [[] for _ in names_types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names_types.values(), strict=True)], list(names_types))


def _to_ipc(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _blocks(docs: DataFrame, block_bytes: int, carry: tuple[str, ...]) -> DataFrame:
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "payload": pa.binary(), "carried": pa.binary()}
        number, ids, texts, parts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            carried = _squeeze(_to_ipc(pa.Table.from_batches(parts))) if carry else None
            return _batch(types, [(number, ids, [len(t) for t in texts], _squeeze(b"".join(texts)), carried)])

        for batch in batches:
            beside, begin = batch.select(list(carry)) if carry else None, 0
            for k, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                ids.append(doc_id)
                texts.append((text or "").encode())
                held += len(texts[-1]) + 64
                if held >= block_bytes:
                    if carry:
                        parts.append(beside[begin : k + 1])
                    begin = k + 1
                    yield row()
                    number, ids, texts, parts, held = number + 1, [], [], [], 0
            if carry and begin < len(batch):
                parts.append(beside[begin:])
        if ids:
            yield row()

    return materialise(docs.select(F.col("doc_id").cast("bigint"), "text", *carry).mapInArrow(pack, BLOCKS), "dedup-blocks")


class _Runs:
    """Runs of start positions of a block that share a key: start, size, key, doc, id_rank."""

    def __init__(self, data: bytes, sizes, doc_ids, length: int, gram: int):
        import numpy as np

        empty = np.empty(0, np.int64)
        self.start = self.size = self.doc = self.key = empty
        sizes = np.asarray(sizes, np.int64)
        begins = np.cumsum(sizes) - sizes
        usable = np.array([d is not None for d in doc_ids], bool) & (sizes >= length)
        if not usable.any():
            return
        n, previous, starts, keys = len(data) - length + 1, None, [], []
        fresh = np.zeros(n, bool)
        fresh[begins[usable]] = True
        for at in range(0, n, CHUNK):
            # minima crowd at the low end; the product spreads them evenly
            least = _window_minimum(_gram_hashes(data[at : at + CHUNK + length - 1], gram), length - gram + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - KEY_BITS)
            new = fresh[at : at + CHUNK]
            new[1:] |= least[1:] != least[:-1]
            new[0] |= previous is None or least[0] != previous
            previous, found = least[-1], np.flatnonzero(new)
            starts.append(found + at)
            keys.append(least[found].astype(np.int64))
        start = np.concatenate(starts)
        # of documents that begin at one place, all but the last are empty
        doc = np.searchsorted(begins, start, "right") - 1
        last = begins[doc] + sizes[doc] - length + 1
        valid = usable[doc] & (start < last)
        self.start, self.doc, self.key = start[valid], doc[valid], np.concatenate(keys)[valid]
        self.size = np.minimum(np.append(self.start[1:], n + 1), last[valid]) - self.start


def _gram_hashes(data: bytes, gram: int):
    """64-bit hashes of all grams of ``gram`` bytes, a multiple of eight."""
    import numpy as np

    n = len(data) - gram + 1
    mixed = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        mixed += np.ndarray((n,), "<u8", data, at, (1,))
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed


def _window_minimum(values, width: int):
    """Minimum of each ``width`` values that follow each other."""
    import numpy as np

    done = 1
    while 2 * done <= width:
        values, done = np.minimum(values[:-done], values[done:]), 2 * done
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


def _groups_of(keys, groups: int):
    return keys // -(-(1 << KEY_BITS) // groups)


def _distinct_keys(runs: _Runs, doc_ids):
    """Sorted keys of a block, whether several documents of it have them, and each run's key."""
    import numpy as np

    keys, which = np.unique(runs.key, return_inverse=True)
    names = np.array([d or 0 for d in doc_ids], np.int64)[runs.doc]
    low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(low, which, names)
    np.maximum.at(high, which, names)
    return keys, low < high, which


def _shared_keys(blocks: DataFrame, groups: int, length: int, gram: int) -> DataFrame:
    """(block, masks: grp and bits of that group's keys in order) for blocks with shared keys."""

    def name(batches):
        import numpy as np
        import pyarrow as pa

        types = {"grp": pa.int32(), "block": pa.int64(), "n": pa.int32(), "keys": pa.binary(), "several": pa.binary()}
        for row in _rows(batches):
            runs = _Runs(_expand(row["payload"]), row["sizes"], row["doc_ids"], length, gram)
            if not len(runs.key):
                continue
            keys, several, _ = _distinct_keys(runs, row["doc_ids"])
            owner = _groups_of(keys, groups)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            cells = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                planes = np.diff(keys[a:b], prepend=0).astype("<u8").view(np.uint8).reshape(-1, 8).T
                cells.append((int(owner[a]), row["block"], b - a, _squeeze(planes.tobytes()), np.packbits(several[a:b]).tobytes()))
            yield _batch(types, cells)
            trim_memory()

    def meet(table):
        import numpy as np
        import pyarrow as pa

        keys, said, rows = [], [], table.to_pylist()
        for row in rows:
            planes = np.frombuffer(_expand(row["keys"]), np.uint8).reshape(8, -1)
            keys.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)))
            said.append(np.unpackbits(np.frombuffer(row["several"], np.uint8), count=row["n"]).astype(bool))
        everything = np.concatenate(keys)
        order = np.argsort(everything)
        at = everything[order]
        same = at[1:] == at[:-1]
        shared = np.zeros(len(at), bool)
        shared[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        shared |= np.concatenate(said)
        # a key that several documents of one block have is shared in every block
        out, k = [], 0
        for row in rows:
            mine = shared[k : k + row["n"]]
            k += row["n"]
            if mine.any():
                out.append((row["block"], row["grp"], np.packbits(mine).tobytes()))
        return pa.Table.from_batches([_batch({"block": pa.int64(), "grp": pa.int32(), "bits": pa.binary()}, out)])

    named = blocks.mapInArrow(name, "grp int, block bigint, n int, keys binary, several binary")
    met = named.groupBy("grp").applyInArrow(meet, "block bigint, grp int, bits binary")
    # as many entries as a block has groups at most
    return met.groupBy("block").agg(F.collect_list(F.struct("grp", "bits")).alias("masks"))


class _SharedRuns:
    """The runs of a block under shared keys, and their distinct strings (entries)."""

    def __init__(self, row: dict, groups: int, length: int, gram: int):
        import numpy as np

        data = _expand(row["payload"])
        runs = _Runs(data, row["sizes"], row["doc_ids"], length, gram)
        keys, _, which = _distinct_keys(runs, row["doc_ids"])
        owner = _groups_of(keys, groups)
        shared = np.zeros(len(keys), bool)
        for mask in row["masks"]:
            a, b = np.searchsorted(owner, [mask["grp"], mask["grp"] + 1])
            shared[a:b] = np.unpackbits(np.frombuffer(mask["bits"], np.uint8), count=b - a)
        kept = np.flatnonzero(shared[which])
        self.data, self.start, self.size = data, runs.start[kept], runs.size[kept]
        index: dict[bytes, int] = {}
        stops = (self.start + self.size + length - 1).tolist()
        self.entry = np.fromiter((index.setdefault(data[a:b], len(index)) for a, b in zip(self.start.tolist(), stops, strict=True)), np.int64, len(kept))
        self.strings = list(index)
        self.names = np.array([d or 0 for d in row["doc_ids"]], np.int64)[runs.doc[kept]]
        self.least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.names)
        self.grp = np.empty(len(index), np.int64)
        self.grp[self.entry] = owner[which[kept]]
        self.order = np.argsort(self.grp, kind="stable")


def _entries(blocks: DataFrame, masks: DataFrame, groups: int, length: int, gram: int) -> DataFrame:
    """Distinct strings of the shared runs, a row for each block and group."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        types = {"block": pa.int64(), "grp": pa.int32(), "data": pa.binary()}
        for row in _rows(batches):
            found = _SharedRuns(row, groups, length, gram)
            cells, order, grp = [], found.order, found.grp[found.order]
            at = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1]))) if len(order) else order
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                texts = [found.strings[k] for k in mine.tolist()]
                sizes = np.array([len(t) for t in texts], "<i8")
                cells.append((row["block"], int(grp[a]), _squeeze(b"".join([len(mine).to_bytes(8, "little"), sizes.tobytes(), found.least[mine].astype("<i8").tobytes(), *texts]))))
            del found
            yield _batch(types, cells)
            trim_memory()

    return blocks.join(masks, "block").mapInArrow(cut, "block bigint, grp int, data binary")


def sort_suffixes(text, ends, depth: int):
    """Suffixes of all positions in order of at least their first ``depth`` bytes.

    ``text``: uint8 array of strings laid end to end; ``ends``: for each position the end of
    its string, beyond which a suffix has nothing. Bucket-pointer refinement, see above.
    """
    import numpy as np

    n, q = len(text), 5
    position = np.arange(n)
    code = np.zeros(n, np.uint64)
    for k in range(q):  # a byte counts from 1; what lies beyond the string is 0
        there = np.zeros(n, np.uint64)
        inside = slice(0, max(0, n - k))
        there[inside] = np.where(position[inside] + k < ends[inside], text[k:].astype(np.uint64) + np.uint64(1), 0)
        code = code * np.uint64(257) + there
    packed = n <= PACKED_POSITIONS
    if packed:  # 257^5 takes 41 bits
        ordered = np.sort(code << np.uint64(21) | position.astype(np.uint64))
        suffixes = (ordered & np.uint64(PACKED_POSITIONS - 1)).astype(np.int64)
    else:
        suffixes = np.argsort(code, kind="stable")
    at = code[suffixes]
    pointer = np.empty(n + 1, np.int64)
    pointer[n] = 0
    fresh = np.concatenate(([True], at[1:] != at[:-1]))
    pointer[suffixes] = np.maximum.accumulate(np.where(fresh, position, 0)) + 1  # 1 on: 0 is beyond the end
    offset = q
    while offset < depth:
        ranks = pointer[suffixes]
        first = np.concatenate(([True], ranks[1:] != ranks[:-1]))
        alone = first & np.concatenate((first[1:], [True]))
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            break
        # parts of the open buckets one after another: later parts use the pointers of earlier ones
        parts = [0]
        for share in range(1, 4):
            cut = len(open_slots) * share // 4
            while cut < len(open_slots) and not first[open_slots[cut]]:
                cut += 1
            parts.append(max(cut, parts[-1]))
        parts.append(len(open_slots))
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            if a == b:
                continue
            slots = open_slots[a:b]
            mine = suffixes[slots]
            later = mine + offset
            later = pointer[np.where(later < ends[mine], later, n)]
            own = ranks[slots]
            if packed:
                keyed = own.astype(np.uint64) << np.uint64(42) | later.astype(np.uint64) << np.uint64(21) | mine.astype(np.uint64)
                keyed.sort()
                mine = (keyed & np.uint64(PACKED_POSITIONS - 1)).astype(np.int64)
                pair = keyed >> np.uint64(21)
                split = np.concatenate(([True], pair[1:] != pair[:-1]))
            else:
                order = np.lexsort((mine, later, own))
                mine, later, own = mine[order], later[order], own[order]
                split = np.concatenate(([True], (own[1:] != own[:-1]) | (later[1:] != later[:-1])))
            suffixes[slots] = mine
            pointer[mine] = np.maximum.accumulate(np.where(split, slots, 0)) + 1
        offset *= 2
    return suffixes


def _keys_of(strings: list[bytes], gram: int):
    """The smallest gram hash of each string, which is the key of all its starts."""
    import numpy as np

    sizes = np.array([len(s) for s in strings], np.int64)
    hashes = _gram_hashes(b"".join([*strings, bytes(gram - 1)]), gram)
    begins = np.cumsum(sizes) - sizes
    # from each string's first gram to its last; the hashes between belong to no string
    edges = np.stack((begins, begins + sizes - gram + 1), axis=1).ravel()
    return np.minimum.reduceat(hashes, edges)[::2]


def smallest_owners(strings: list[bytes], owners, length: int, gram: int = GRAM):
    """For each start of ``length`` bytes in each string, laid end to end, the smallest owner
    of a string that holds the same bytes; and the strings' sizes.

    Keys are the first buckets. A string that is alone under its key holds no other's bytes.
    """
    import numpy as np

    sizes = np.array([len(s) for s in strings], np.int64)
    owners = np.asarray(owners, np.int64)
    found = np.repeat(owners, sizes)
    _, which, count = np.unique(_keys_of(strings, gram), return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(count[which] > 1)
    if len(crowded):
        found[np.repeat(count[which] > 1, sizes)] = _sorted_owners([strings[k] for k in crowded.tolist()], owners[crowded], length)
    return found, sizes


def _sorted_owners(strings: list[bytes], owners, length: int):
    import numpy as np

    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    stop = np.cumsum(sizes)
    ends = np.repeat(stop, sizes)
    suffixes = sort_suffixes(text, ends, length)
    position = np.arange(len(text))
    suffixes = suffixes[(position + length <= ends)[suffixes]]
    # neighbours that agree on all bytes of the string
    equal = np.ones(len(suffixes) - 1, bool)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.ndarray((len(text),), "<u8", padded.data, 0, (1,))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        at = words[suffixes + k]
        equal &= at[1:] == at[:-1]
    first = np.flatnonzero(np.concatenate(([True], ~equal)))
    owner = np.repeat(owners, sizes)[suffixes]
    least = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(suffixes))))
    found = np.empty(len(text), np.int64)
    found[suffixes] = least
    return found


def _answers(entries: DataFrame, length: int, gram: int) -> DataFrame:
    """(block, replies: grp and a bit for each start of its entries, in order)."""

    def sort(table):
        import numpy as np
        import pyarrow as pa

        index: dict[bytes, int] = {}
        owners: list[int] = []
        told = []
        for block, grp, data in zip(table["block"].to_pylist(), table["grp"].to_pylist(), table["data"], strict=True):
            raw = _expand(data.as_py())
            n = int.from_bytes(raw[:8], "little")
            sizes = np.frombuffer(raw, "<i8", n, 8)
            least = np.frombuffer(raw, "<i8", n, 8 + 8 * n).tolist()
            stops = (16 * n + 8 + np.cumsum(sizes)).tolist()
            mine = []
            for a, b, owner in zip([16 * n + 8, *stops], stops, least, strict=False):
                k = index.setdefault(raw[a:b], len(owners))
                if k == len(owners):
                    owners.append(owner)
                elif owner < owners[k]:
                    owners[k] = owner
                mine.append(k)
            told.append((block, grp, mine, least))
        strings = list(index)
        del index
        found, sizes = smallest_owners(strings, owners, length, gram)
        del strings
        begins = np.cumsum(sizes) - sizes
        out = []
        for block, grp, mine, least in told:
            mine = np.array(mine)
            count = sizes[mine] - length + 1
            at = np.repeat(begins[mine], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out.append((block, grp, np.packbits(found[at] < np.repeat(least, count)).tobytes()))
        trim_memory()
        return pa.Table.from_batches([_batch({"block": pa.int64(), "grp": pa.int32(), "bits": pa.binary()}, out)])

    sorted_ = entries.groupBy("grp").applyInArrow(sort, "block bigint, grp int, bits binary")
    return sorted_.groupBy("block").agg(F.collect_list(F.struct("grp", "bits")).alias("replies"))


def _at_characters(gone, data):
    """``gone`` (flags of bytes) but for the parts of characters that are not wholly in it."""
    import numpy as np

    inner = (data & 0xC0) == 0x80
    starts = np.flatnonzero(~inner)
    if not len(starts):
        return gone
    whole = np.minimum.reduceat(gone, starts)
    out = np.repeat(whole, np.diff(np.append(starts, len(data))))
    return np.concatenate((gone[: starts[0]], out))


def _apply(blocks: DataFrame, masks: DataFrame, answers: DataFrame, tasks: int, groups: int, length: int, gram: int, carry: tuple[str, ...], kinds: dict[str, str], whole_characters: bool) -> DataFrame:
    def remove(batches):
        import numpy as np
        import pyarrow as pa

        span = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
        types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": span, "kept": pa.binary()}
        for row in _rows(batches):
            sizes = np.array(row["sizes"], np.int64)
            if row["masks"] is None:
                data = _expand(row["payload"])
                flags = np.zeros(len(data) + length + 1, bool)
            else:
                found = _SharedRuns(row, groups, length, gram)
                data, start, size, entry = found.data, found.start, found.size, found.entry
                starts = np.zeros(len(data) + length + 1, np.int32)  # differences
                later = found.names > found.least[entry]
                np.add.at(starts, start[later], 1)
                np.add.at(starts, start[later] + size[later], -1)
                flags = np.cumsum(starts, dtype=np.int32) > 0
                # the replies' bits follow the entries by group
                count = np.zeros(len(found.strings), np.int64)
                count[entry] = size
                begins = np.empty(len(count), np.int64)
                begins[found.order] = np.cumsum(count[found.order]) - count[found.order]
                per_group = {r["grp"]: r["bits"] for r in row["replies"] or ()}
                totals = np.bincount(found.grp, count).astype(np.int64) if len(count) else count
                bits = [np.unpackbits(np.frombuffer(per_group[g], np.uint8), count=totals[g]) for g in np.unique(found.grp).tolist()]
                bits = np.concatenate([*bits, np.empty(0, np.uint8)])
                own = np.flatnonzero(~later)
                for k in range(0, len(own), CHUNK >> 4):
                    some = own[k : k + (CHUNK >> 4)]
                    many = size[some]
                    steps = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    hit = bits[np.repeat(begins[entry[some]], many) + steps].astype(bool)
                    flags[(np.repeat(start[some], many) + steps)[hit]] = True
                del found
            reach = np.cumsum(flags, dtype=np.int32)  # a block has less than 2^31 bytes, or differences wrap
            gone = np.concatenate((reach[:length], reach[length:] - reach[:-length]))[: len(data)] > 0
            kept_all = np.frombuffer(data, np.uint8)
            if whole_characters:
                gone = _at_characters(gone, kept_all)
            cells, at = [], 0
            for doc_id, n_bytes in zip(row["doc_ids"], sizes.tolist(), strict=True):
                mine = gone[at : at + n_bytes]
                if mine.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                    spans = [{"first": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]
                    cells.append((doc_id, n_bytes, spans, kept_all[at : at + n_bytes][~mine].tobytes()))
                else:
                    cells.append((doc_id, n_bytes, [], data[at : at + n_bytes]))
                at += n_bytes
            beside = pa.ipc.open_stream(_expand(row["carried"])).read_all() if carry else None
            for k in range(0, len(cells), 500):
                made = _batch(types, cells[k : k + 500])
                if carry:
                    some = beside[k : k + 500].combine_chunks()
                    made = pa.RecordBatch.from_arrays([*made.columns, *[some[c].chunk(0) for c in carry]], [*made.schema.names, *carry])
                yield made
            del data, cells
            trim_memory()

    # a task's rows reach Python in one batch; by size alone it would be that of a shuffle partition
    blocks, masks, answers = (df.repartition(tasks, "block") for df in (blocks, masks, answers))
    joined = blocks.join(masks, "block", "left").join(answers, "block", "left")
    return joined.mapInArrow(remove, ", ".join([RESULT, *[f"`{c}` {kinds[c]}" for c in carry]]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, carry: Sequence[str] = (), whole_characters: bool = False) -> DataFrame:
    """``RESULT`` of every row, and its columns ``carry``: its removed spans and its remaining bytes."""
    if gram % 8 or not gram <= length:
        raise ValueError("the gram is a multiple of 8 bytes, within the length")
    size = total_bytes(docs)
    groups = max(LEAST_GROUPS, -(-size // group_bytes))
    carry = tuple(carry)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    blocks = _blocks(docs, block_bytes, carry)
    masks = materialise(_shared_keys(blocks, groups, length, gram), "dedup-masks")
    release_shuffles(docs.sparkSession)
    answers = materialise(_answers(_entries(blocks, masks, groups, length, gram), length, gram), "dedup-answers")
    release_shuffles(docs.sparkSession)
    return _apply(blocks, masks, answers, max(1, -(-size // TASK_BYTES)), groups, length, gram, carry, kinds, whole_characters)
