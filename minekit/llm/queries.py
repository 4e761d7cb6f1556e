"""The registered queries of this package and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from minekit.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    fill_middle,
    language,
    licenses,
    mixing,
    near_dedup,
    packing,
    quality,
    scoring,
    site_tree,
    token_counts,
)
from minekit.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licence_scan(table(spark, folder, "documents"))


@query("op2_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"), words_each=3, per_cent=85)


@query("op3_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return site_tree.main_texts(table(spark, folder, "pages"))


@query("op4_quality")
def quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op7_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.language_model_scores(table(spark, folder, "documents"), order=3)


@query("op8_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_regions(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op9_token_counts")
def token_counts_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"))


@query(
    "op10_exact_dedup",
    """
    WITH folded AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM folded
    """,
)
def exact_dedup_query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query(
    "op11_fill_in_middle",
    r"""
    WITH docs AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
    ), units AS (
      SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
      FROM docs
    ), cuts AS (
      SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM units
    ), parts AS (
      SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
             coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix
      FROM cuts
    )
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM parts
    """,
)
def fill_in_middle_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query(
    "op12_source_mix",
    r"""
    WITH docs AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest
      FROM documents
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS copy FROM docs
    ), sizes AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
    ), weighed AS (
      SELECT source, source_size, [5, 2, 1][(place % 3 + 1)::INT] AS weight FROM sizes
    ), ratios AS (
      SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM weighed
    ), candidates AS (
      SELECT ratio, ((SELECT sum(source_size) FROM ratios)::DOUBLE * 1.5::DOUBLE
                     - coalesce(sum(2 * source_size) OVER (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)::DOUBLE)
                    / (sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM ratios
    ), water AS (
      SELECT max(level) AS level FROM candidates
    ), targets AS (
      SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * coalesce(level, 0)) AS target FROM weighed, water
    ), expected AS (
      SELECT n.*, source_size, target, floor(target + 0.5::DOUBLE)::BIGINT AS words,
             CASE WHEN source_size > 0 THEN floor(target + 0.5::DOUBLE) / source_size ELSE 0 END AS e
      FROM numbered n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source
    ), drawn AS (
      SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p,
             (('0x' || sha256('12:' || coalesce(doc_id::VARCHAR, '') || ':' || digest || ':' || copy)[1:13])::BIGINT + 0.5::DOUBLE)
               / 4503599627370496::DOUBLE AS u
      FROM expected
    ), ranked AS (
      SELECT *, words - whole * source_size AS rest,
             sum(size) OVER (PARTITION BY source ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id, digest, copy
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead
      FROM drawn WHERE p > 0
    )
    SELECT doc_id, size, source_size, target, (whole * size + greatest(least(size, rest - coalesce(ahead, 0)), 0))::BIGINT AS taken FROM ranked
    UNION ALL
    SELECT doc_id, size, source_size, target, whole * size FROM drawn WHERE p = 0
    """,
)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, folder, "documents"))
