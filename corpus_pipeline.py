"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the
last return the columns of documents; ``n_chars`` follows ``text``. Every row is judged by its own
text, rows with a null or a repeated id too, and no stage gives more rows than it takes. A null text
is judged as an empty one and stays null. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import materialise
from mosaiq.llm.tokens import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below the threshold."""
    from mosaiq.llm.toxicity import THRESHOLD, learn_toxicity, score_toxicity

    network = learn_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs.select(*COLUMNS), network, list(COLUMNS))
    return scored.filter(F.col("score") < THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Five-word shingles and a similarity of 0.8. Of repeated rows one stays; rows without an id yield to those with one.
    """
    from mosaiq.llm.simhash import row_key, similar_groups

    found = similar_groups(docs, width=5, similarity=0.8).filter("kept")
    kept = materialise(found.groupBy("row_key").agg(F.count("*").alias("n")), "kept-rows")
    keyed = docs.select(*COLUMNS, row_key().alias("row_key"))
    # texts are not sorted: the hint builds tables of the keys, and rows that stand alone are as they are
    alone = keyed.join(kept.filter("n = 1").hint("shuffle_hash"), "row_key", "left_semi").select(*COLUMNS)
    repeated = kept.filter("n > 1").select("row_key")
    if repeated.isEmpty():
        return alone
    # rows of one key have one id and text; the join puts them together
    again = keyed.join(repeated, "row_key", "left_semi")
    first = again.groupBy("row_key").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("d"))
    return alone.unionByName(first.select(*[F.col(f"d.{c}").alias(c) for c in COLUMNS]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; whole characters only."""
    from mosaiq.llm.substring_dedup import remove_repeats

    named = docs.select(*COLUMNS, F.col("text").isNull().alias("none"))
    cut = remove_repeats(named, carry=["lang", "source", "n_chars", "none"], whole_characters=True)
    # the bytes are those of whole characters
    text = F.when(~F.col("none"), F.col("kept").cast("string"))
    made = cut.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), text.alias("text"), "lang", "source", "n_chars")
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    from mosaiq.llm.decontamination import decontaminate
    from mosaiq.llm.simhash import row_key

    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=row_key())
    hit = materialise(found.filter("n_hit > 0").select(F.col("carried").alias("row_key")).distinct(), "contaminated")
    return docs.select(*COLUMNS, row_key().alias("row_key")).join(hit, "row_key", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    from mosaiq.llm.packing import pack_documents

    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
