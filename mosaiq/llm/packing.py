"""Operator 4: bounded-space online packing of token sequences.

Each partition reads its documents once and keeps ``windows`` open windows. A document gives
full windows of its own as long as it can; its rest goes to the open window it fits best. If
none fits, the fullest is topped up by a cut and emitted. At its end a partition merges its
open windows, and the one unfilled rest of each partition is merged with those of the others
by a running sum over one row a partition. The last rest of all is cut into powers of two,
so no sequence needs padding.

Null text counts as empty, and an empty document is its end id alone. Null ids and repeated
rows are packed like any other row. An empty table gives an empty result. Other columns of
the input are ignored, whatever their names. Memory: a partition's open windows and one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, trim_memory

PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary, part int, rest boolean"
)
#: Sequences made from the partitions' rests get ids from here on, above any partition's own.
REST_BASE = 1 << 60


#: Texts of a batch that are held as Python strings at once.
TEXTS = 256


class _Packer:
    """Places pieces of one partition; ``out`` collects pieces of emitted sequences."""

    def __init__(self, part: int, size: int, windows: int):
        self.size, self.windows = size, windows
        self.next_id = part << 33
        self.open: list[list] = []  # [filled, pieces]; a piece: (doc_id, start, doc_tokens, ids)
        self.out: list[tuple] = []

    def emit(self, pieces: list, rest: bool = False) -> None:
        at = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, doc_tokens, self.next_id, at, ids, rest))
            at += n
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.size:
            self.emit([(doc_id, at, total, ids[4 * at : 4 * (at + self.size)])])
            at += self.size
        while at < total:
            left = total - at
            fit = max((w for w in self.open if w[0] + left <= self.size), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.windows:
                self.open.append(fit := [0, []])
            window = fit or max(self.open, key=lambda w: w[0])
            n = min(left, self.size - window[0])
            window[1].append((doc_id, at, total, ids[4 * at : 4 * (at + n)]))
            window[0] += n
            at += n
            if window[0] == self.size:
                self.open = [w for w in self.open if w is not window]
                self.emit(window[1])

    def finish(self) -> None:
        """Merge the open windows into full ones and one rest."""
        held, filled = [], 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for doc_id, start, total, ids in pieces:
                while ids:
                    n = min(len(ids) // 4, self.size - filled)
                    held.append((doc_id, start, total, ids[: 4 * n]))
                    start, ids, filled = start + n, ids[4 * n :], filled + n
                    if filled == self.size:
                        self.emit(held)
                        held, filled = [], 0
        if held:
            self.emit(held, rest=True)


def _rows(rows: list[tuple], part: int):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "rest"]
    types = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
    made = {n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)}
    made["part"] = pa.array([part] * len(rows), pa.int32())
    order = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "part", "rest"]
    return pa.RecordBatch.from_arrays([made[n] for n in order], order)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024, windows: int = 16) -> DataFrame:
    """Pieces of packed sequences, with their ids (``PIECES`` without part and rest).

    ``tokenizer``: file of the tokenizers library; ``end_id`` closes each document; ``size``:
    tokens of a sequence; ``windows``: open windows of a partition.
    """

    def pack(batches):
        from pyspark import TaskContext

        from mosaiq.llm.tokens import encoder

        if not encoder.cache_info().currsize:
            trim_memory()  # a worker of other stages holds what they freed
        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        packer = _Packer(part, size, windows)
        held = 0
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                packer.add(doc_id, ids := encode(text or "") + end)
                held += len(ids)
                if held > 4 << 20 and packer.out:
                    yield _rows(packer.out, part)
                    packer.out, held = [], 0
        packer.finish()
        if packer.out:
            yield _rows(packer.out, part)

    made = materialise(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(pack, PIECES), "packed")
    return _merge_rests(made, size).drop("part", "rest")


def _merge_rests(made: DataFrame, size: int) -> DataFrame:
    """Lay the partitions' rests end to end and cut them at multiples of ``size``."""
    rests = made.filter("rest")
    lengths = rests.groupBy("part").agg(F.sum("length").alias("n"))
    # one row a partition: a single task can order them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = lengths.agg(F.sum("n")).first()[0] or 0
    cuts, at = [], total - total % size
    for bit in reversed(range(size.bit_length())):
        if (total % size) >> bit & 1:
            cuts.append(at)
            at += 1 << bit
    tail = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    begin, end = F.col("base") + F.col("offset"), F.col("base") + F.col("offset") + F.col("length")
    starts = F.array_union(F.transform(F.sequence(F.floor(begin / size), F.floor((end - 1) / size)), lambda k: k * F.lit(size).cast("bigint")), F.filter(tail, lambda c: c < end))
    placed = rests.join(bases, "part").withColumn("starts", F.array_sort(starts)).withColumn("g", begin).withColumn("e", end)
    stretches = F.expr("transform(filter(starts, (s, i) -> i = size(starts) - 1 or starts[i + 1] > g), s -> s)")
    one = placed.withColumn("s", F.explode(stretches)).withColumn("next", F.coalesce(F.array_min(F.filter("starts", lambda x: x > F.col("s"))), F.col("e")))
    lo, hi = F.greatest("s", "g"), F.least("next", "e")
    skipped = lo - F.col("g")
    merged = one.select(
        "doc_id",
        (F.col("start") + skipped).alias("start"),
        (hi - lo).alias("length"),
        "doc_tokens",
        (F.lit(REST_BASE) + F.col("s")).alias("sequence_id"),
        (lo - F.col("s")).alias("offset"),
        F.expr("substring(ids, cast(4 * (greatest(s, g) - g) + 1 as int), cast(4 * (least(next, e) - greatest(s, g)) as int))").alias("ids"),
        "part",
        "rest",
    )
    return made.filter("not rest").unionByName(merged)
