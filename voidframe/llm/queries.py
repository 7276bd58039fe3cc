"""The queries of this subpackage: thin wrappers that read a table and apply an operator."""

from __future__ import annotations

from . import chat, decontaminate, dedup, fingerprint, html_text, language, packing, pii, prefix_trie, quality, ranked_search, secrets, sharding
from .common import documents

QUERIES = {
    "op1_sharding": lambda spark, sf_dir: sharding.digest(documents(spark, sf_dir)),
    "op2_fingerprint": lambda spark, sf_dir: fingerprint.digest(documents(spark, sf_dir)),
    "op3_pii": lambda spark, sf_dir: pii.digest(documents(spark, sf_dir)),
    "op4_secrets": lambda spark, sf_dir: secrets.digest(documents(spark, sf_dir)),
    "op5_packing": lambda spark, sf_dir: packing.digest(documents(spark, sf_dir)),
    "op6_html": lambda spark, sf_dir: html_text.digest(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op7_language": lambda spark, sf_dir: language.digest(documents(spark, sf_dir)),
    "op8_dedup": lambda spark, sf_dir: dedup.digest(documents(spark, sf_dir)),
    "op9_quality": lambda spark, sf_dir: quality.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op10_decontaminate": lambda spark, sf_dir: decontaminate.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op11_chat": lambda spark, sf_dir: chat.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op12_search": lambda spark, sf_dir: ranked_search.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op13_prefix_trie": lambda spark, sf_dir: prefix_trie.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline

ORACLE_SQL: dict[str, str] = {"op11_chat": chat.SQL, "op12_search": ranked_search.SQL, "op13_prefix_trie": prefix_trie.SQL}
