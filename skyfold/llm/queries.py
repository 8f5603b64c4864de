"""One query for each operator of this package, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_text import main_text
from .kd_sharding import kd_shards
from .mixing import mix
from .pii import find_pii
from .projection_ann import nearest
from .pu_quality import score
from .simhash import near_duplicates
from .spark_util import table
from .substring_dedup import remove_repeats
from .suffix_decontamination import contamination
from .warc import page_derivatives


def op1_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose vec_id is divisible by 20, by inner product.

    Vectors that are null, zero or hold null or non-finite components take no part; ties go to the smaller vec_id; repeated rows are candidates each; an empty table gives no rows.
    """
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of each window of 20 that starts earlier in the table, as a digest of what is kept.

    A null text has no words; a null doc_id comes before all others; of repeated rows the later ones lose their words; an empty table gives no rows.
    """
    return remove_repeats(table(spark, sf_dir, "documents"), window=20, digest=True)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains (groups of sources), languages and sources; half of the tokens' volume, four epochs at most.

    A null language or source is a node of its own; a null text has no tokens; repeated rows are read or left together; an empty table gives no rows.
    """
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]+)", 1)
    domain = F.when(number == "", "other").otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("news"), F.lit("forums")), (F.pmod(F.xxhash64(number), F.lit(4)) + 1).cast("int")))
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain)
    weights = {("web",): 0.4, ("books",): 0.3, ("news",): 0.2, ("forums",): 0.1, ("*", "en"): 0.6, ("*", "de"): 0.15, ("*", "fr"): 0.15, ("*", "es"): 0.1}
    mixed = mix(docs, levels=("domain", "lang", "source"), weights=weights, share=0.5, max_epochs=4, power=0.5)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes, from a k-d tree over source, language, length and doc_id.

    A null text has 8 bytes; null metadata sort first; rows that agree in all of it share a shard; an empty table gives no rows.
    """
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page; empty for a null page or one without content. Repeated rows give repeated results, an empty table none."""
    return main_text(table(spark, sf_dir, "pages"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id that it reaches over links of at most two bits.

    Texts without words have fingerprint zero and link like any other; rows with a null doc_id take part in links; repeated rows give repeated results, an empty table none.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion and a metadata record for each page; a null page has an empty body, a null url an empty URI. Repeated rows give repeated records with the same ids, an empty table none."""
    made = page_derivatives(table(spark, sf_dir, "pages"))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "source_digest", "block_digest", F.map_entries("headers").alias("headers"), F.decode("block", "UTF-8").alias("block"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in ten words of a benchmark item, and a digest of the items found.

    A null text has no words; items without words are in no document; items that share an id count once; repeated rows give repeated results, an empty table none.
    """
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document, learnt from positive labels of the folds that are not held out.

    A null text is scored as an empty one; a null doc_id is held out; without a positive label every score is 0.5; repeated rows give repeated results, an empty table none.
    """
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), accept=0.3)


def op10_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data in each document, and all spans that the classifier accepts. A null text has none; repeated rows give repeated results, an empty table none."""
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_projection_ann": op1_projection_ann,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_kd_sharding": op4_kd_sharding,
    "op5_html_text": op5_html_text,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_decontaminate": op8_decontaminate,
    "op9_pu_quality": op9_pu_quality,
    "op10_pii_spans": op10_pii_spans,
}

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, range(0, 20) AS r(o)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, string_agg(CASE WHEN g.i IS NULL THEN e.word END, ' ' ORDER BY e.i) AS t, count(g.i) AS n
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
bl AS (SELECT item, ws, least(len(ws), 10) AS l FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM (SELECT item, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bl),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS k
       FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, ls WHERE len(ws) >= l)),
hit AS (SELECT doc_id, dw.l, i, item FROM dw JOIN bw ON dw.l = bw.l AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT doc_id, l, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
}
