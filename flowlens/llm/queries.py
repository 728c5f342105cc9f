"""One registered query per operator, over its whole tables, and the SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import oracles
from flowlens.llm.filter_audit import audit_filters
from flowlens.llm.mixing import mix_summary
from flowlens.llm.near_dedup import near_duplicates
from flowlens.llm.outliers import quality_rules
from flowlens.llm.packing import pack_documents
from flowlens.llm.pii import personal_data
from flowlens.llm.prefix_trie import prefix_trie
from flowlens.llm.quality import quality_scores
from flowlens.llm.recompression import without_repeats
from flowlens.llm.rp_forest import near_vectors
from flowlens.llm.secret_scan import secret_digest
from flowlens.llm.storage import read_table
from flowlens.llm.syncmers import fingerprint_digest
from flowlens.llm.toxicity import toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _on(table: str, *more: str) -> Callable[[Callable[..., DataFrame]], Query]:
    def run_on(fn: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: fn(*[read_table(spark, sf_dir, t) for t in (table, *more)])
    return run_on


QUERIES["op1_mixing"] = _on("documents")(mix_summary)
QUERIES["op2_syncmers"] = _on("documents")(fingerprint_digest)
QUERIES["op3_rp_forest"] = _on("embeddings")(near_vectors)
QUERIES["op4_packing"] = _on("documents")(pack_documents)
QUERIES["op5_superminhash"] = _on("documents")(near_duplicates)
QUERIES["op6_quality"] = _on("documents", "labels")(quality_scores)
QUERIES["op7_recompression"] = _on("documents")(without_repeats)
QUERIES["op8_pii"] = _on("documents")(personal_data)
QUERIES["op9_toxicity"] = _on("documents", "labels")(toxicity_scores)
QUERIES["op10_secrets"] = _on("documents")(secret_digest)
QUERIES["op11_outliers"] = _on("documents")(quality_rules)
QUERIES["op12_prefix_trie"] = _on("conversations")(prefix_trie)
QUERIES["op13_filter_audit"] = lambda spark, sf_dir: audit_filters(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))

ORACLES["op3_rp_forest"] = oracles.NEAR_VECTORS
ORACLES["op5_superminhash"] = oracles.NEAR_DUPLICATES
ORACLES["op7_recompression"] = oracles.WITHOUT_REPEATS
ORACLES["op12_prefix_trie"] = oracles.PREFIX_TRIE
ORACLES["op13_filter_audit"] = oracles.FILTER_AUDIT
