"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from finfacts.llm import exact_dedup, fill_middle, html_text, jaccard, mixing, pseudonyms, quality, runs, simhash, url_rules, vptree
from finfacts.llm.huffman import huffman_round_trip
from finfacts.llm.packing import pack_documents
from finfacts.llm.shared import documents, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_round_trip(documents(spark, sf_dir), vocabulary(), end=1)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages"), url_rules.rules_table(spark))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir), k=4, percent=85)


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, sf_dir))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), vocabulary(), end=0, capacity=2048)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle_digests(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(documents(spark, sf_dir))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), k=4, most=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_html_text": op3_html_text,
    "op4_url_rules": op4_url_rules,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_nearest_vectors": op7_nearest_vectors,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_quality_scores": op9_quality_scores,
    "op10_mix_sources": op10_mix_sources,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash_dedup": op13_simhash_dedup,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_url_rules": url_rules.oracle(),
    "op10_mix_sources": mixing.oracle(),
    "op11_fill_in_middle": fill_middle.ORACLE,
}
