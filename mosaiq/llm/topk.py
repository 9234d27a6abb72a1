"""Operator 7: exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and cut into buckets. The longest ones are searched first and give
each query a threshold, the k-th best product so far. In a bucket that threshold is a threshold
on the cosine: threshold / (query's length * longest length in the bucket). Above one, no
vector of the bucket can do, and the query skips it. High thresholds prune by coordinates:
a vector at that cosine or better has its largest-query coordinates in narrow intervals; low
ones prune by length. What is left is verified by exact integer products.

Queries are searched in blocks, and a block visits a bucket if any of its queries may need it.
Products are exact: in 64-bit floats while lengths bound them below 2^53, else in whole numbers.

Components become floor(scale * x). Vectors that are null, or hold null or non-finite
components, and rows with a null id take no part. Of unequal lengths, missing components count
as 0. A query is not compared with rows of its own id; repeated rows are rows. Ties go to the
smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise

BUCKET, QUERY_BLOCK = 2048, 512
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM, FOCUS = 0.6, 6
SEED_BUCKETS = 2
#: Buckets that a block of queries meets together, at least; they are more where else there were too many chunks.
CHUNK, MOST_CHUNKS = 16, 1 << 16

PACKED = "bucket bigint, n bigint, width int, longest double, shortest double, ids binary, data binary"


def _whole(df: DataFrame, id_column: str, vector: str, scale: float) -> DataFrame:
    x = F.transform(F.col(vector), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    sound = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    kept = df.filter(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).filter(sound)
    made = kept.select(F.col(id_column).cast("bigint").alias("vec_id"), x.alias("v"))
    return made.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def _pack(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of ``PACKED``: vectors that follow each other by length, longest first."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def row():
            width = max(len(v) for _, v in held)
            data = np.zeros((len(held), width), np.int64)
            for k, (_, v) in enumerate(held):
                data[k, : len(v)] = v
            lengths = np.sqrt((data.astype(np.float64) ** 2).sum(axis=1))
            ids = np.array([i for i, _ in held], np.int64)
            cells = [number, len(held), width, float(lengths.max(initial=0)), float(lengths.min()), ids.tobytes(), data.tobytes()]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], ["bucket", "n", "width", "longest", "shortest", "ids", "data"])

        for batch in batches:
            for pair in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist(), strict=True):
                held.append(pair)
                if len(held) == size:
                    yield row()
                    number, held = number + 1, []
        if held:
            yield row()

    # the id parts vectors of equal length
    ordered = vectors.repartitionByRange(F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    return ordered.select("vec_id", "v").mapInArrow(pack, PACKED)


class _Bucket:
    def __init__(self, n, width, ids, data):
        import numpy as np

        self.ids = np.frombuffer(ids, np.int64)
        self.data = np.frombuffer(data, np.int64).reshape(n, width)
        self.floats = self.data.astype(np.float64)
        self.lengths = np.sqrt((self.floats**2).sum(axis=1))

    def widened(self, width: int) -> _Bucket:
        import numpy as np

        if self.data.shape[1] < width:
            pad = ((0, 0), (0, width - self.data.shape[1]))
            self.data, self.floats = np.pad(self.data, pad), np.pad(self.floats, pad)
        return self


def _products(queries: _Bucket, rows, bucket: _Bucket, candidates):
    """Exact inner products, as 64-bit whole numbers, of some queries and some vectors."""
    import numpy as np

    if queries.lengths.max(initial=0) * bucket.lengths.max(initial=0) < 2.0**53:
        return (queries.floats[rows] @ bucket.floats[candidates].T).astype(np.int64)
    exact = queries.data[rows].astype(object) @ bucket.data[candidates].astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores, ids, own: int, k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best, ties to smaller ids, without the query's own id."""
    import numpy as np

    keep = ids != own
    scores, ids = scores[keep], ids[keep]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = scores >= least
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(scores[order].tolist(), ids[order].tolist(), strict=True))


def _candidates(queries: _Bucket, thresholds, bucket: _Bucket):
    """Queries that may need the bucket, and what of it is left to verify for them."""
    import numpy as np

    width = max(queries.data.shape[1], bucket.data.shape[1])
    queries, bucket = queries.widened(width), bucket.widened(width)
    longest, slack = bucket.lengths.max(initial=0), 1 + 1e-9
    reach = queries.lengths * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, thresholds / reach, np.where(thresholds > 0, np.inf, -np.inf))
    visits = local <= slack
    by_coordinate = np.flatnonzero(visits & (local >= COORDINATE_FROM) & (bucket.lengths.min(initial=0) > 0))
    by_length = np.flatnonzero(visits & ~np.isin(np.arange(len(local)), by_coordinate))
    unit = None
    for q in by_coordinate.tolist():
        unit = bucket.floats / bucket.lengths[:, None] if unit is None else unit
        t, mine = local[q] / slack, queries.floats[q] / queries.lengths[q]
        focus = np.argsort(-np.abs(mine))[:FOCUS]
        spread = np.sqrt(max(0.0, 1 - t * t) * np.maximum(0, 1 - mine[focus] ** 2)) + 1e-9
        # with a cosine of t or more: the lowest and highest such a coordinate can be
        low = np.where(mine[focus] <= -t, -1.0, t * mine[focus] - spread)
        high = np.where(mine[focus] >= t, 1.0 + 1e-9, t * mine[focus] + spread)
        some = np.ones(len(unit), bool)
        for f, a, b in zip(focus, low, high, strict=True):
            some &= (unit[:, f] >= a - 1e-9) & (unit[:, f] <= b)
        yield q, np.flatnonzero(some)
    for at in range(0, len(by_length), 256):
        some = by_length[at : at + 256]
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(queries.lengths[some] > 0, thresholds[some] / queries.lengths[some], -np.inf).min(initial=np.inf)
        candidates = np.flatnonzero(bucket.lengths * slack >= needed)
        yield some, candidates


def _chunks(buckets: DataFrame) -> tuple[DataFrame, list[float]]:
    """(bucket, chunk) in the order of lengths, and each chunk's longest length (``MOST_CHUNKS`` numbers at most).

    A bucket's number has its range and its place in it, so places need a count a range and no order over all buckets.
    """
    part, within = F.shiftright("bucket", 32), F.col("bucket").bitwiseAND(F.lit(0xFFFFFFFF))
    held = buckets.select("bucket", "longest", part.alias("part"), within.alias("within"))
    counts = held.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = max(CHUNK, -(-total // MOST_CHUNKS))
    place = F.floor((F.col("base") + F.col("within")) / size)
    dealt = materialise(held.join(bases, "part").select("bucket", "longest", place.alias("chunk")), "bucket-chunks")
    heads = dict(dealt.groupBy("chunk").agg(F.max("longest")).collect())
    reach = [heads[c] for c in range(len(heads))]
    for c in range(len(reach) - 2, -1, -1):  # rounding must not hide a longer one behind
        reach[c] = max(reach[c], reach[c + 1])
    return dealt, reach


def _meetings(blocks: DataFrame, buckets: DataFrame, dealt: DataFrame) -> DataFrame:
    """Blocks of the stated queries beside the buckets that are long enough for one of their queries.

    A block goes to the first ``last`` chunks, which are those that it needs: joins by chunk, each of whose sides
    Spark may send out if it is small.
    """
    wanted = blocks.filter("last > 0").select("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") - 1)).alias("chunk"))
    asked = blocks.join(wanted, "block")
    return asked.join(buckets.join(dealt.select("bucket", "chunk"), "bucket"), "chunk").filter(F.col("longest") * (1 + 1e-9) >= F.col("need"))


def top_products(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest products with other rows."""
    whole = _whole(vectors, id_column, vector, scale)
    asked = _whole(vectors.filter(is_query), id_column, vector, scale)
    buckets = materialise(_pack(whole, BUCKET), "norm-buckets")
    blocks = materialise(_pack(asked, QUERY_BLOCK), "query-blocks")
    seeds = [(r.n, r.width, bytes(r.ids), bytes(r.data)) for r in buckets.orderBy(F.desc("longest"), "bucket").limit(SEED_BUCKETS).collect()]
    dealt, reach = _chunks(buckets)
    sent = vectors.sparkSession.sparkContext.broadcast(seeds)

    def seed(batches):
        import numpy as np
        import pyarrow as pa

        first = [_Bucket(*s) for s in sent.value]
        for batch in batches:
            for row in batch.to_pylist():
                queries = _Bucket(row["n"], row["width"], row["ids"], row["data"])
                found: list[list] = [[] for _ in range(row["n"])]
                for bucket in first:
                    width = max(row["width"], bucket.data.shape[1])
                    scores = _products(queries.widened(width), np.arange(row["n"]), bucket.widened(width), np.arange(len(bucket.ids)))
                    for q in range(row["n"]):
                        found[q] = sorted(found[q] + _best(scores[q], bucket.ids, queries.ids[q], k), reverse=True)[:k]
                    queries = _Bucket(row["n"], row["width"], row["ids"], row["data"])
                floor = np.array([f[-1][0] if len(f) == k else -np.inf for f in found], np.float64)
                # a float may be above the whole number it stands for
                floor = np.where(np.abs(floor) >= 2.0**53, np.nextafter(floor, -np.inf), floor)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(queries.lengths > 0, floor / queries.lengths, np.where(floor > 0, np.inf, -np.inf)).min()
                # chunks are ordered, so those that are long enough come first
                last = int((np.array(reach) * (1 + 1e-9) >= need).sum())
                cells = [row["bucket"], row["n"], row["width"], row["ids"], row["data"], floor.tobytes(), float(need), last]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], ["block", "q_n", "q_width", "q_ids", "q_data", "floors", "need", "last"])

    seeded = blocks.mapInArrow(seed, "block bigint, q_n bigint, q_width int, q_ids binary, q_data binary, floors binary, need double, last bigint")
    pairs = _meetings(materialise(seeded, "query-blocks"), buckets, dealt)

    def search(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                queries = _Bucket(row["q_n"], row["q_width"], row["q_ids"], row["q_data"])
                bucket = _Bucket(row["n"], row["width"], row["ids"], row["data"])
                out = []
                for some, candidates in _candidates(queries, np.frombuffer(row["floors"]), bucket):
                    rows = np.atleast_1d(some)
                    scores = _products(queries, rows, bucket, candidates)
                    for q, mine in zip(rows.tolist(), scores, strict=True):
                        out += [(row["block"] * QUERY_BLOCK + q, int(queries.ids[q]), i, s) for s, i in _best(mine, bucket.ids[candidates], queries.ids[q], k)]
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q_key", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "q_key bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
