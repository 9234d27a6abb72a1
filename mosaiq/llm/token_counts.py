"""Operator 10: token counts of documents in flat token files without an index.

A file is nothing but token ids of fixed width; an end-of-document id closes each document.
Files are cut into blocks; each block is searched for the id with one vectorised comparison,
and documents that cross blocks are stitched by running sums over the blocks of a file, of
tokens and of separators. Work and memory are bounded by the block, whatever a document's length.

Tokens after the last separator of a file form a document with ``terminated`` false. An empty
file has no documents. A trailing part of a token at the end of a file is no token. Null text
is an empty document; repeated rows are documents of their own. Rows of the input keep the
order of their partition in the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise


def write_flat_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of every text, each followed by ``end_id``, as unsigned 16-bit files.

    Spark's text writer puts the bytes of each row and then its line separator, which is the
    end id here, so that files are flat and go to any file system that Spark can write.
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        from mosaiq.llm.tokens import encoder

        encode = encoder(tokenizer).encode
        for batch in batches:
            texts = batch["text"].to_pylist()
            for at in range(0, len(texts), 500):
                rows = [np.frombuffer(encode(t or ""), "<u4").astype("<u2").tobytes() for t in texts[at : at + 500]]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    rows = docs.select("text").mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    separator = end_id.to_bytes(2, "little").decode("latin1")
    rows.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def _local(path: str) -> str:
    """A path as Arrow takes it; Hadoop writes local ones with one slash."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _reachable(path: str) -> bool:
    import pyarrow as pa

    from mosaiq.sources.files import open_fs

    try:
        open_fs(_local(path))
    except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def _blocks(spark: SparkSession, path: str, block: int) -> DataFrame:
    """path, block and tokens (its bytes) of all blocks of the files that are not empty."""
    files = spark.read.format("binaryFile").load(path)
    number = F.explode(F.expr(f"sequence(0L, (length - 1) div {block})")).alias("block")
    if not _reachable(path):
        content = files.where("length > 0").select("path", "content", number)
        return content.select("path", "block", F.expr(f"substring(content, cast(1 + block * {block} as int), {block})").alias("tokens"))

    def read(batches):
        import pyarrow as pa

        from mosaiq.sources.files import read_bytes

        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                data = read_bytes(_local(one["path"][0].as_py()), one["block"][0].as_py() * block, block)
                yield pa.RecordBatch.from_arrays([one["path"], one["block"], pa.array([data], pa.binary())], ["path", "block", "tokens"])

    # names and lengths only: contents are not read here
    spread = files.where("length > 0").select("path", number).repartition("path", "block")
    return spread.mapInArrow(read, "path string, block bigint, tokens binary")


def count_tokens(spark: SparkSession, path: str, end_id: int, block_bytes: int = 4 << 20) -> DataFrame:
    """Documents of flat 16-bit token files: path, doc_no and start (in tokens of the file,
    end ids included), n_tokens (without the end id), terminated."""
    cut = _blocks(spark, path, block_bytes - block_bytes % 2)

    def search(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found, sizes = [], []
            for raw in batch["tokens"]:
                buffer = raw.as_buffer()
                ids = np.frombuffer(buffer, "<u2", count=len(buffer) // 2)
                found.append(np.flatnonzero(ids == end_id).astype(np.int64))
                sizes.append(len(ids))
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["block"], pa.array(sizes, pa.int64()), ends], ["path", "block", "n", "ends"])

    searched = materialise(cut.mapInArrow(search, "path string, block bigint, n bigint, ends array<bigint>"), "token-blocks")
    # prefix scan over the blocks of a file: tokens and separators before, and where the last document ended
    told = searched.select("path", "block", "n", F.size("ends").cast("bigint").alias("n_ends"), F.array_max("ends").alias("last"))
    whole = Window.partitionBy("path").orderBy("block")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    scanned = told.select(
        "path",
        "block",
        "last",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs"),
        F.lead("block").over(whole).isNull().alias("final"),
    )
    opened = F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0))
    scanned = scanned.withColumn("open", opened).drop("last")
    carried = searched.join(scanned, ["path", "block"])
    stitched = F.expr(
        "transform(ends, (e, i) -> struct(docs + i as doc_no, if(i = 0, open, base + ends[i - 1] + 1) as start,"
        " base + e - if(i = 0, open, base + ends[i - 1] + 1) as n_tokens, true as terminated))"
    )
    last_end = F.expr("coalesce(base + array_max(ends) + 1, open)")
    over = F.when(
        F.col("final") & (F.col("base") + F.col("n") > last_end),
        F.array(F.struct((F.col("docs") + F.size("ends")).alias("doc_no"), last_end.alias("start"), (F.col("base") + F.col("n") - last_end).alias("n_tokens"), F.lit(False).alias("terminated"))),
    ).otherwise(F.expr("filter(array(struct(0L as doc_no, 0L as start, 0L as n_tokens, false as terminated)), x -> false)"))
    return carried.select("path", F.explode(F.concat(stitched, over)).alias("d")).select("path", "d.*")
