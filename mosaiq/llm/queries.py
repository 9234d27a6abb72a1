"""The thin queries ``opN_<name>``: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm.common import new_path
from mosaiq.llm.tokens import tokenizer_path


#: Arrivals that the shard store takes one by one.
ARRIVALS = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.common import held_out
    from mosaiq.llm.toxicity import THRESHOLD, learn_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    network = learn_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, network)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.substring_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.packing import pack_documents

    pieces = pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.token_orc import ids_crc32, read_token_orc, write_token_orc

    path = new_path(spark, "token-orc")
    write_token_orc(_table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return ids_crc32(read_token_orc(spark, path))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.token_counts import count_tokens, write_flat_tokens

    path = new_path(spark, "flat-tokens")
    write_flat_tokens(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), 50256)
    counted = count_tokens(spark, path, 50256)
    return counted.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("file_no"), "doc_no", "start", "n_tokens", "terminated")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.shards import ShardStore

    docs = _table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    kept = store.read()
    return kept.select("doc_id", "source", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.topk import top_products

    return top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.decontamination import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"), longest=5, least=100, share=100, most=2000)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mosaiq.llm.fingerprints import edited_likeness, spelt

    found = edited_likeness(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelt(F.col("chosen")).alias("fingerprint"), spelt(F.col("edited_chosen")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_toxicity, op3_substring_dedup, op4_packing, op5_token_orc, op6_compaction, op7_topk, op8_simhash, op9_decontamination, op10_token_counts, op11_source_divergence, op12_collocations, op13_fingerprints)
}
ORACLE_SQL = {
    "op3_substring_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM b)),
        f AS (SELECT s, min(doc_id) AS first_doc FROM g GROUP BY s),
        m AS (SELECT doc_id, p FROM g JOIN f USING (s) WHERE first_doc < doc_id),
        r AS (SELECT doc_id, p, coalesce(p > lag(p) OVER w + 50, TRUE) AS fresh FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
        i AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
        spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY ALL),
        edges AS (SELECT doc_id, a, z, coalesce(lag(z) OVER w, 0) AS before FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
        parts AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS z, sum(z - a) AS n_removed, count(*) AS n_spans
                  FROM edges JOIN b USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN z IS NULL THEN h ELSE kept || substr(h, 2 * z + 1) END)) AS kept_sha256
        FROM b LEFT JOIN parts USING (doc_id)""",
    "op6_compaction": "SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g
              FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
        g AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
        h AS (SELECT doc_id, p, g.n, item_id FROM g JOIN i ON g.g = i.g AND g.n = i.n),
        words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS at FROM h) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS n_lang FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        f AS (SELECT lang, source, term, n_lang, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER one + 5 * count(*) OVER one) AS BIGINT) AS p FROM f WINDOW one AS (PARTITION BY lang, source)),
        q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n_lang + 5) // (sum(n_lang) OVER one + 5 * count(*) OVER one) AS BIGINT) AS q FROM k WINDOW one AS (PARTITION BY lang)),
        s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
        ways AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
                 UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ways)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
    "op12_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
        w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM d)),
        g AS (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
        k AS (SELECT lang, m, phrase, a, k, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
        s AS (SELECT k.*, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
              FROM k JOIN n USING (lang) JOIN f x ON x.lang = k.lang AND x.phrase = k.x AND x.m = k.k JOIN f y ON y.lang = k.lang AND y.phrase = k.y AND y.m = k.m - k.k),
        worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1),
        inside AS (SELECT lang, i AS m, array_to_string(ws[j:j + i - 1], ' ') AS phrase, max(a) AS longer
                   FROM (SELECT *, unnest(range(1, m - i + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS i FROM c)) GROUP BY ALL),
        r AS (SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst LEFT JOIN inside USING (lang, m, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000""",
}
