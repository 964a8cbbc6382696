"""Queries of this subpackage over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ticketflow.llm.decontam import contaminated
from ticketflow.llm.divergence import ORACLE as DIVERGENCE_SQL
from ticketflow.llm.divergence import divergence
from ticketflow.llm.embedding_pq import embedding_duplicates
from ticketflow.llm.licenses import license_oracle, license_passages, license_scan
from ticketflow.llm.mixing import mix_sources
from ticketflow.llm.ngram_join import jaccard_components
from ticketflow.llm.quality_qda import quality_classifier
from ticketflow.llm.quality_rules import quality_rules
from ticketflow.llm.secret_scan import scan_secrets
from ticketflow.llm.spelling import spelling_variants
from ticketflow.llm.substring_dedup import fuzzy_passages
from ticketflow.llm.suffix_dedup import remove_repeats
from ticketflow.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": lambda s, d: jaccard_components(table(s, d, "documents")),
    "op2_substring_dedup": lambda s, d: fuzzy_passages(table(s, d, "documents")),
    "op3_suffix_dedup": lambda s, d: remove_repeats(table(s, d, "documents")).drop("kept"),
    "op4_license_scan": lambda s, d: license_scan(table(s, d, "documents")),
    "op4_license_passages": lambda s, d: license_passages(table(s, d, "documents")),
    "op5_mix_sources": lambda s, d: mix_sources(table(s, d, "documents")),
    "op6_quality_rules": lambda s, d: quality_rules(table(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity(table(s, d, "documents"), table(s, d, "labels")),
    "op8_secret_scan": lambda s, d: scan_secrets(table(s, d, "documents")),
    "op9_quality_classifier": lambda s, d: quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
    "op10_decontaminate": lambda s, d: contaminated(table(s, d, "documents"), table(s, d, "benchmark")),
    "op11_embedding_pq": lambda s, d: embedding_duplicates(table(s, d, "embeddings")),
    "op12_spelling_variants": lambda s, d: spelling_variants(table(s, d, "documents")),
    "op13_source_divergence": lambda s, d: divergence(table(s, d, "documents")),
}

ORACLE: dict[str, str] = {"op4_license_scan": license_oracle(), "op13_source_divergence": DIVERGENCE_SQL}
