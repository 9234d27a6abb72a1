"""Operator 5: token ids in ORC files, in ascending order of the document ids.

Spark's ORC writer run-length encodes the integers and keeps row indexes; Bloom filters are
asked for on the document id. Range partitions sorted by id give files that ascend across and
within, so readers prune stripes by id and read the others in parallel. A file keeps each
document's start within its own part; the part's base is a running sum over one row a part.

Null text counts as empty (its end id alone). Null ids come first. Repeated rows are kept, in
a fixed order of their texts' hashes. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise, release_shuffles

BROADCAST_PARTS = 1 << 18

STORED = "part int, doc_id bigint, part_start bigint, n_tokens bigint, ids array<int>"


def write_token_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, stripe_bytes: int = 32 << 20, row_index_stride: int = 1000) -> None:
    """Encode every text and write ``STORED`` as ORC under ``path``."""

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from mosaiq.llm.tokens import encoder

        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for at in range(0, len(texts), 500):
                ids = [encode(t or "") + end for t in texts[at : at + 500]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(doc_ids[at : at + 500], pa.int64()), pa.array(start + ends - n), pa.array(n), lists],
                    ["part", "doc_id", "part_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    texts = docs.select(F.col("doc_id").cast("bigint"), "text").withColumn("h", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    writer = ordered.select("doc_id", "text").mapInArrow(encode, STORED).write
    options = {"orc.bloom.filter.columns": "doc_id", "orc.row.index.stride": str(row_index_stride), "orc.stripe.size": str(stripe_bytes), "compression": "zstd"}
    writer.options(**options).orc(path)
    del ordered, writer
    release_shuffles(docs.sparkSession)  # the sorted texts


def read_token_orc(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Documents of ``write_token_orc`` with ``start`` over all files; ``where`` prunes stripes.

    The base of a part comes from the two small columns of all files, whatever ``where`` keeps. Up to
    ``BROADCAST_PARTS`` parts (16 bytes each) the bases go to the rows, so that no ids are shuffled.
    """
    stored = spark.read.schema(STORED).orc(path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a file part: a single task can order them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "part-bases")
    if bases.count() <= BROADCAST_PARTS:
        bases = F.broadcast(bases)
    kept = stored if where is None else stored.filter(where)
    return kept.join(bases, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit) in place of ids."""

    def crc(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch["ids"]
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            offsets = lists.offsets.to_numpy()
            made = np.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(made)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
