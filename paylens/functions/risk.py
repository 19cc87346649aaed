"""Scoring-rule expressions (R-1, R-2, R-4, R-6, R-7, R-8) as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import clamp, col


def risk_level(score) -> Column:
    """R-1: >= .95 CRITICAL, >= .85 HIGH, >= .70 MEDIUM, else LOW."""
    s = col(score)
    out = None
    for cut, name in C.RISK_LEVELS:
        out = F.when(s >= cut, F.lit(name)) if out is None else out.when(s >= cut, F.lit(name))
    return out.otherwise(F.lit(C.RISK_DEFAULT))


def sql_risk_level(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {cut} THEN '{name}'" for cut, name in C.RISK_LEVELS)
    return f"CASE {whens} ELSE '{C.RISK_DEFAULT}' END"


def recommended_action(score) -> Column:
    """R-2."""
    s = col(score)
    out = None
    for cut, text in C.ACTIONS:
        out = F.when(s >= cut, F.lit(text)) if out is None else out.when(s >= cut, F.lit(text))
    return out.otherwise(F.lit(C.ACTION_DEFAULT))


def sql_recommended_action(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} >= {cut} THEN '{text}'" for cut, text in C.ACTIONS)
    return f"CASE {whens} ELSE '{C.ACTION_DEFAULT}' END"


def zscore(amount, mean, std) -> Column:
    """Online z-score: (x - mean) / max(std, .01) (P-15, online floor)."""
    return (col(amount) - col(mean)) / F.greatest(F.coalesce(col(std), F.lit(0.0)), F.lit(C.STD_FLOOR))


def heuristic_score(z) -> Column:
    """R-4: clamp(|z| / 10, 0, 1)."""
    return clamp(F.abs(col(z)) / C.HEURISTIC_Z_DIVISOR, 0.0, 1.0)


def review_score(z) -> Column:
    """R-5: clamp(z / 10, 0, 1) with the sign kept."""
    return clamp(col(z) / C.HEURISTIC_Z_DIVISOR, 0.0, 1.0)


def stream_score(amount) -> Column:
    """R-6: clamp(amount / 5000, 0, 1)."""
    return clamp(col(amount) / C.STREAM_AMOUNT_SCALE, 0.0, 1.0)


def feed_score(z, terminal, card, fraud) -> Column:
    """R-3 live-feed proxy score."""
    s = (F.lit(C.FEED_BASE)
         + F.least(F.abs(col(z)) / C.FEED_Z_DIVISOR, F.lit(C.FEED_Z_CAP))
         + F.when(col(terminal) == "manual_entry", F.lit(C.FEED_MANUAL)).otherwise(F.lit(0.0))
         + F.when(col(card) == "credit", F.lit(C.FEED_CREDIT)).otherwise(F.lit(0.0))
         + F.when(F.coalesce(col(fraud), F.lit(False)), F.lit(C.FEED_FRAUD)).otherwise(F.lit(0.0)))
    return clamp(s, 0.0, 1.0)


def explain_topk(features: dict[str, Column]) -> Column:
    """R-7: features sorted by |value| desc (stable): array<struct<feature, value>>."""
    items = [F.struct((-F.abs(v.cast("double"))).alias("k"), F.lit(i).alias("pos"),
                      F.lit(name).alias("feature"), v.cast("double").alias("value"))
             for i, (name, v) in enumerate(features.items())]
    ranked = F.array_sort(F.array(*items))
    return F.transform(ranked, lambda r: F.struct(r["feature"].alias("feature"), r["value"].alias("value")))


def fraud_prior(amount, category, terminal, card, off_hours) -> Column:
    """R-8: additive fraud-probability rule, clipped at .45."""
    base_map = F.create_map(*[x for c, b in C.CATEGORY_BASE_AMOUNT for x in (F.lit(c), F.lit(b))])
    base = base_map[col(category)]
    ratio = col(amount) / F.greatest(base, F.lit(1.0))
    manual = col(terminal) == "manual_entry"
    chip = col(terminal) == "chip_and_pin"
    off = F.coalesce(col(off_hours), F.lit(False))
    r4 = F.coalesce(ratio > 4.0, F.lit(False))
    r8 = F.coalesce(ratio > 8.0, F.lit(False))

    def term(cond, w):
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    p = (F.lit(C.FRAUD_PRIOR_BASE)
         + term(manual, C.FRAUD_PRIOR_MANUAL)
         + term(chip, C.FRAUD_PRIOR_CHIP)
         + term(off, C.FRAUD_PRIOR_OFF_HOURS)
         + term(col(card) == "credit", C.FRAUD_PRIOR_CREDIT)
         + term(r4, C.FRAUD_PRIOR_RATIO_GT4)
         + term(r8, C.FRAUD_PRIOR_RATIO_GT8)
         + term(manual & off & r4, C.FRAUD_PRIOR_MANUAL_OFF_RATIO4)
         + term(chip & off & r4, C.FRAUD_PRIOR_CHIP_OFF_RATIO4))
    return clamp(p, 0.0, C.FRAUD_PRIOR_CLIP)


def sql_fraud_prior(amount: str, category: str, terminal: str, card: str, off: str) -> str:
    base = "CASE " + " ".join(f"WHEN {category} = '{c}' THEN {b}" for c, b in C.CATEGORY_BASE_AMOUNT) + " END"
    ratio = f"({amount} / greatest({base}, 1.0))"
    manual = f"({terminal} = 'manual_entry')"
    chip = f"({terminal} = 'chip_and_pin')"
    offc = f"COALESCE({off}, FALSE)"
    r4 = f"COALESCE({ratio} > 4.0, FALSE)"
    r8 = f"COALESCE({ratio} > 8.0, FALSE)"

    def term(cond, w):
        return f"CASE WHEN {cond} THEN CAST({w!r} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"

    p = " + ".join([f"CAST({C.FRAUD_PRIOR_BASE!r} AS DOUBLE)",
                    term(manual, C.FRAUD_PRIOR_MANUAL), term(chip, C.FRAUD_PRIOR_CHIP),
                    term(offc, C.FRAUD_PRIOR_OFF_HOURS), term(f"{card} = 'credit'", C.FRAUD_PRIOR_CREDIT),
                    term(r4, C.FRAUD_PRIOR_RATIO_GT4), term(r8, C.FRAUD_PRIOR_RATIO_GT8),
                    term(f"{manual} AND {offc} AND {r4}", C.FRAUD_PRIOR_MANUAL_OFF_RATIO4),
                    term(f"{chip} AND {offc} AND {r4}", C.FRAUD_PRIOR_CHIP_OFF_RATIO4)])
    return f"least(greatest({p}, CAST(0 AS DOUBLE)), CAST({C.FRAUD_PRIOR_CLIP!r} AS DOUBLE))"
