"""Existing queries over the varied transactions, where the branches that the driver's events never
reach occur: alerts, rejections, violations, unknown members, null keys, repeated ids, the 30-day edge."""

from __future__ import annotations

from paylens.plans import registry
from paylens.sources.tables import variant, varied_sql

NAMES = [
    "expectations", "contract_check", "unexpected_values", "valid_requests", "stream_score", "anomaly_review",
    "category_precision", "category_bias", "governance_gate", "risk_level", "recommended_action",
    "merchant_severity", "merchant_dimension", "fraud_by_state", "threat_map", "curated_clean", "table_health",
    "merchant_history", "training_features", "live_feed", "live_feed_base", "score_heuristic",
]


def _varied(name: str):
    def run(spark, sf_dir):
        with variant("varied"):
            return registry.QUERIES[name](spark, sf_dir)
    return run


for _name in NAMES:
    registry.register(f"{_name}_varied", registry.OPERATOR_IDS[_name], varied_sql(registry.ORACLES[_name]))(_varied(_name))
