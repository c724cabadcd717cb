"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import stages
from .centroids import OP13_SQL, op13_centroid_clusters
from .fingerprints import op4_bloom_sketch
from .html_text import op7_html_text
from .language import op5_language
from .licenses import OP12_SQL, op12_license_scan
from .mixing import OP9_DOCUMENTS_SQL, op9_mixed_documents
from .near_duplicates import op10_ngram_jaccard
from .ngram_scores import op2_deleted_interpolation
from .packing import op3_packing
from .quality import op6_quality_rules
from .spelling import OP11_SQL, op11_spelling_variants
from .token_counts import op1_token_counts
from .toxicity import op8_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline over `documents`."""
    return stages.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_deleted_interpolation, op3_packing, op4_bloom_sketch, op5_language, op6_quality_rules, op7_html_text, op8_toxicity, op9_mixed_documents, op10_ngram_jaccard, op11_spelling_variants, op12_license_scan, op13_centroid_clusters, pipeline)}

ORACLES: dict[str, str] = {"op9_mixed_documents": OP9_DOCUMENTS_SQL, "op11_spelling_variants": OP11_SQL, "op12_license_scan": OP12_SQL, "op13_centroid_clusters": OP13_SQL, **({"pipeline": stages.ORACLE_SQL} if stages.ORACLE_SQL else {})}
