"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import simhash

    return simhash.query(table(spark, sf_dir, "documents"))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import piece_bpe

    return piece_bpe.query(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import quality_rules

    return quality_rules.query(table(spark, sf_dir, "documents"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import langid

    return langid.query(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import license_scan

    return license_scan.query(table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import html_extract

    return html_extract.query(table(spark, sf_dir, "pages"))


def op5_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import sketch

    return sketch.query(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import mixing

    return mixing.query(table(spark, sf_dir, "documents"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import kneser_ney

    return kneser_ney.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import suffix_dedup

    return suffix_dedup.query(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import periodic_runs

    return periodic_runs.query(table(spark, sf_dir, "documents"))


def op12_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import embedding_join

    return embedding_join.query(table(spark, sf_dir, "embeddings"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleaner.llm import spelling

    return spelling.query(table(spark, sf_dir, "documents"))


EMBEDDING_LINKS = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.v FROM reach r JOIN links l ON l.u = r.other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT l.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, l.vec_id = l.component_id AS kept FROM least l LEFT JOIN counts c ON c.u = l.vec_id"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_simhash, op3_quality_rules, op4_html_extract, op5_sketch, op6_langid, op7_piece_bpe, op8_license_scan, op9_suffix_dedup, op10_mixing,
                                op11_periodic_runs, op12_embedding_join, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {"op12_embedding_join": EMBEDDING_LINKS}
