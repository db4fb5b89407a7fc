"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cooccurrence, distinctive, packing, residue, shared_spans, similar_sets, term_counts, tokenizer, topn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": similar_sets.p1_found,
        "p1_classes": similar_sets.p1_classes,
        "p2_found": distinctive.p2_found,
        "p2_residuals": distinctive.p2_residuals,
        "p2_ranking": distinctive.p2_ranking,
        "p2_agreement": distinctive.p2_agreement,
        "p3_found": term_counts.p3_found,
        "p3_counts": term_counts.p3_counts,
        "p4_found": topn.p4_found,
        "p5_found": cooccurrence.p5_found,
        "p5_pairs": cooccurrence.p5_pairs,
        "p6_found": shared_spans.p6_found,
        "p6_coverage": shared_spans.p6_coverage,
        "p7_ids": tokenizer.p7_ids,
        "p7_roundtrip": tokenizer.p7_roundtrip,
        "p8_containers": packing.p8_containers,
        "p8_fill": packing.p8_fill,
        "p8_sound": packing.p8_sound,
        "p9_found": residue.p9_found,
        "p9_residue": residue.p9_residue,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": similar_sets.P1_SQL,
        "p1_classes": similar_sets.P1_CLASSES_SQL,
        "p2_found": distinctive.P2_SQL,
        "p2_residuals": distinctive.P2_RESIDUALS_SQL,
        "p2_ranking": distinctive.P2_RANKING_SQL,
        "p2_agreement": distinctive.P2_AGREEMENT_SQL,
        "p3_found": term_counts.P3_SQL,
        "p3_counts": term_counts.P3_COUNTS_SQL,
        "p4_found": topn.P4_SQL,
        "p5_found": cooccurrence.P5_SQL,
        "p5_pairs": cooccurrence.P5_PAIRS_SQL,
        "p6_found": shared_spans.P6_SQL,
        "p6_coverage": shared_spans.P6_COVERAGE_SQL,
        "p7_roundtrip": tokenizer.P7_ROUNDTRIP_SQL,
        "p8_sound": packing.P8_SOUND_SQL,
    }
