"""All registered queries of the engine's core, with their SQL.

Results are reports: fractions are given to six decimals, so that they do not depend on the order in which partial sums
of distributed rows are added up.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenarium.plans import annotated, dyads, extended, files, members, problems, reports, streams

_MODULES = (problems, dyads, annotated, reports, extended, members, files, streams)

#: Columns with fractions, by query (the SQL has to name them).
FRACTIONS: dict[str, str] = {
    "d0_resolver": "confidence",
    "d1_resolved": "confidence",
    "e7_bilateral_matrix": "mean_sentiment sd_sentiment",
    "h5_grounded_mentions": "grounded_score",
    "e8_bilateral_concreteness": "mean_score median_score sd_score",
    "e12_asymmetry": "share_ab log_ratio sentiment_gap",
    "d5_directed_ratio": "ratio",
    "m18_smoothed_asymmetry": "rate_forward rate_reverse log_ratio",
    "e11_shock_window": "sentiment_pre sentiment_post delta_sentiment",
    "e27_yearly_attention": "mean_sentiment",
    "m2_share_matrix": "share",
    "m4_masked_means": "mean_value",
    "m5_profile_features": "value",
    "m6_features": "value",
    "m7_zscores": "z",
    "m8_cosine": "similarity",
    "m9_extremes": "similarity",
    "m11_lift": "share corpus_share lift",
    "m15_residuals": "expected residual",
    "h6_concreteness": "concreteness_score",
    "h4_lexicon_concreteness": "concreteness_score",
    "e2_entity_stats": "mean_value sd_value min_value max_value",
    "e3_distribution": "percent",
    "e16_regional_concreteness": "mean_score median_score sd_score",
    "e18_mention_profile": "mean_concreteness",
    "e19_yearly_profile": "mean_concreteness",
    "e21_patterns": "mean_score",
    "e24_source_summary": "mean_sentiment mean_concreteness",
    "i3_concrete_events": "concreteness_score",
    "d14_places": "latitude longitude",
    "j3_both_ends": "concreteness_score",
    "j4_examples": "concreteness_score",
    "j1_share_in_source": "percent",
    "m17_policy_similarity": "similarity",
    "m20_density": "share",
    "v6_polarity_shares": "share_positive share_negative",
    "z_scalar_check": "log_chars",
    "c17_safe_label": "mean_ratio",
    "c16_fact_score": "fact_score",
    "e17_visible_targets": "mean_score",
    "e20_target_year": "mean_score median_score",
    "e23_year_summary": "mean_score",
    "e30_source_totals": "per_thousand",
    "i4_europe_events": "concreteness_score",
    "j7_global_top": "concreteness_score",
    "m12_extreme_cells": "mean_value",
    "m13_share_leaders": "share",
    "v4_mean_by_year": "mean_score",
    "v8_timeline": "concreteness_score",
    "m17_convergence_pairs": "similarity",
    "c11_agenda": "percent",
    "d6_normalized": "rate_per_1000_units rate_per_1000_mentions raw_ratio normalized_ratio normalized_log_ratio",
    "e27_scored_attention": "mean_sentiment mean_concreteness",
    "i6_event_table": "concreteness_score fact_score",
    "v3_asymmetry_bars": "log_ratio",
}


def _rounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})

    return run


def _rounded_sql(name: str, sql: str) -> str:
    columns = FRACTIONS.get(name, "").split()
    return f"SELECT * REPLACE ({', '.join(f'round(cast({c} AS double), 6) AS {c}' for c in columns)}) FROM ({sql})" if columns else sql


QUERIES = {name: _rounded(f) for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: _rounded_sql(name, sql) for m in _MODULES for name, sql in m.ORACLE.items()}
