"""Model queries: trained models have no SQL form, but their first steps and their properties do."""

from __future__ import annotations

from pyspark.sql import functions as F

from paylens import constants as C
from paylens.functions.numeric import round_half
from paylens.functions.numeric import sql_round as R
from paylens.operators import boosting as B
from paylens.operators import ml as ML
from paylens.operators.evaluation import is_healthy
from paylens.plans.features_q import ROUNDED_FEATURES_CTE, TRAINING_FEATURES_CTES, rounded_training_features
from paylens.plans.registry import register
from paylens.sources.tables import with_transactions

_TRAINED: dict[tuple[str, str], tuple] = {}
#: the transaction columns that the training run and its results read
_BESIDE = ["transaction_id", "merchant_id", "timestamp", "is_fraud"]


def trained(spark, sf_dir):
    """The full training run (200 trees, 450 rounds at most), once per session and table: its features, stored, and
    its models; its results are checkpointed."""
    from paylens.session import cut_lineage, stored
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TRAINED:
        features = stored(rounded_training_features(spark, sf_dir, beside=_BESIDE), "features")
        iso, nodes, clf, scored, metrics = ML.train_ensemble(features, trees=200, psi=256, max_iter=450)
        _TRAINED[at] = features, nodes, clf, cut_lineage(scored), cut_lineage(metrics)
    return _TRAINED[at]


@register("train_ensemble", "M-3")
def q_train_ensemble(spark, sf_dir):
    return is_healthy(trained(spark, sf_dir)[4])


@register("ensemble_scores", "M-6")
def q_ensemble_scores(spark, sf_dir):
    """Test-split rows with iso, classifier and min-max ensemble scores."""
    return trained(spark, sf_dir)[3].select("transaction_id", "merchant_id", "is_fraud", "iso_score", "clf_score", "anomaly_score")


@register("train_properties", "M-3", with_transactions("""
SELECT floor(COUNT(*) * 0.8)::BIGINT AS train_rows, (COUNT(*) - floor(COUNT(*) * 0.8))::BIGINT AS test_rows,
       (COUNT(*) - floor(COUNT(*) * 0.8))::BIGINT AS scores_in_range, TRUE AS metrics_in_range, TRUE AS stopped_as_set,
       0 AS splits_without_gain, 0 AS children_below_weight, 0 AS values_off_their_sums FROM transactions"""))
def q_train_properties(spark, sf_dir):
    """What the full training run must give: the split's sizes, scores and metrics in their ranges, the end of the
    rounds, and in every tree gains above zero, children of the least weight and covers that add up."""
    f, _, clf, scored, metrics = trained(spark, sf_dir)
    s, rows = B.Settings(), len(clf.history)
    best = max(range(rows), key=lambda k: (clf.history[k], -k), default=s.rounds - 1) + 1
    # the rounds end ``patience`` after the best one, or as set; without held-out rows all are kept
    stopped = rows in ((s.rounds, best + s.patience) if rows else (0,)) and len(clf.trees) == best
    t = clf.nodes(spark)
    inner = t.filter("feature >= 0").alias("t")
    child = t.select("tree", F.floor((F.col("node") - 1) / 2).cast("int").alias("node"), F.col("cover").alias("part")) \
        .filter("node >= 0").groupBy("tree", "node").agg(F.sum("part").alias("parts"), F.min("part").alias("least"), F.count(F.lit(1)).alias("n"))
    checked = inner.join(child, ["tree", "node"], "left").agg(
        F.count_if(~(F.col("gain") > 0)).cast("int").alias("splits_without_gain"),
        F.count_if(F.coalesce(F.col("least"), F.lit(0.0)) < s.least_child).cast("int").alias("children_below_weight"),
        F.count_if(F.coalesce(F.abs(F.col("parts") - F.col("cover")) > 1e-6, F.lit(True))).cast("int").alias("values_off_their_sums"))
    counts = scored.agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col("anomaly_score").between(0, 1)).alias("scores_in_range"))
    ok = metrics.select((F.col("roc_auc").between(0, 1) & F.col("threshold").between(0.05, 0.95)).alias("ok"))
    return f.select((F.floor(F.count(F.lit(1)) * 0.8)).cast("long").alias("train_rows")).select(
        "train_rows", counts.select("test_rows").scalar().alias("test_rows"),
        counts.select("scores_in_range").scalar().alias("scores_in_range"), ok.scalar().alias("metrics_in_range"),
        F.lit(stopped).alias("stopped_as_set"), *[checked.select(c).scalar().alias(c) for c in checked.columns])


#: cut points of every feature in the query below
_CUTS = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0]
_UNIT = float(1 << B.SCALE)


def _grown_sql(level: int) -> list[str]:
    """The best split of each node of a level, and the rows of the next one."""
    gain = "0.5 * (lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1))"
    return [f"""sums{level} AS (SELECT node, SUM(g) / {_UNIT} AS g, SUM(h) / {_UNIT} AS h FROM rows{level} GROUP BY node)""",
            f"""tried{level} AS (SELECT r.node, feature, cut, SUM(CASE WHEN v < cut THEN r.g ELSE 0 END) / {_UNIT} AS lg,
              SUM(CASE WHEN v < cut THEN r.h ELSE 0 END) / {_UNIT} AS lh
              FROM rows{level} r JOIN cells USING (transaction_id), (SELECT unnest({_CUTS}) AS cut) c GROUP BY 1, 2, 3)""",
            f"""best{level} AS (SELECT * FROM (SELECT t.*, {gain} AS gain, row_number() OVER (PARTITION BY node ORDER BY {gain} DESC, feature, cut) AS rn
              FROM tried{level} t JOIN sums{level} USING (node) WHERE lh >= 8 AND h - lh >= 8) x WHERE rn = 1 AND gain > 1e-6)""",
            f"""rows{level + 1} AS (SELECT r.transaction_id, r.g, r.h, 2 * r.node + CASE WHEN v < cut THEN 1 ELSE 2 END AS node
              FROM rows{level} r JOIN best{level} b USING (node) JOIN cells USING (transaction_id, feature))"""]


_CELLS = " UNION ALL ".join(f"SELECT transaction_id, {i} AS feature, {c} AS v FROM tf" for i, c in enumerate(C.FEATURE_COLUMNS))


@register("boosting_first_tree", "M-3", with_transactions(
    " UNION ALL ".join(f"""SELECT CAST(s.node AS INTEGER) AS node, CAST(COALESCE(b.feature, -1) AS INTEGER) AS feature,
  CAST(COALESCE(b.cut, 0.0) AS DOUBLE) AS threshold, {R('COALESCE(b.gain, 0.0)', 4)} AS gain, {R('s.h', 4)} AS cover,
  {R('-0.03 * s.g / (s.h + 1)', 6)} AS value
FROM sums{k} s LEFT JOIN best{k} b USING (node)""" for k in (0, 1))
    + f""" UNION ALL SELECT CAST(node AS INTEGER), -1, 0.0::DOUBLE, 0.0::DOUBLE, {R('SUM(h) / ' + str(_UNIT), 4)}, {R(f'-0.03 * (SUM(g) / {_UNIT}) / (SUM(h) / {_UNIT} + 1)', 6)}
FROM rows2 GROUP BY node""",
    *TRAINING_FEATURES_CTES, ROUNDED_FEATURES_CTE, f"cells AS MATERIALIZED ({_CELLS})",
    "wt AS (SELECT CAST(COUNT(*) FILTER (WHERE NOT is_fraud) AS DOUBLE) / greatest(COUNT(*) FILTER (WHERE is_fraud), 1) AS w FROM tf)",
    f"""rows0 AS (SELECT transaction_id, 0 AS node, round_even(CASE WHEN is_fraud THEN w * -0.5 ELSE 0.5 END * {_UNIT}, 0) AS g,
       round_even(CASE WHEN is_fraud THEN w ELSE 1.0 END * 0.25 * {_UNIT}, 0) AS h FROM tf, wt)""",
    *_grown_sql(0), *_grown_sql(1)))
def q_boosting_first_tree(spark, sf_dir):
    """The first tree, two levels deep, on given cut points and all rows: gradients, histograms, gains and leaf values."""
    import numpy as np
    from paylens.session import cut_lineage
    f = cut_lineage(rounded_training_features(spark, sf_dir))
    fraud = F.col("is_fraud")
    weight = f.agg(F.count_if(~fraud).cast("double") / F.greatest(F.count_if(fraud), F.lit(1)).cast("double")).first()[0]
    rows = f.select(*C.FEATURE_COLUMNS, fraud.cast("int").alias("label"), F.when(fraud, F.lit(weight)).otherwise(F.lit(1.0)).alias("weight"),
                    F.xxhash64("transaction_id").alias("id"), F.lit(False).alias("held"))
    model = B.fit(rows, C.FEATURE_COLUMNS, B.Settings(rounds=1, depth=2, rows=1.0, columns=1.0), [np.array(_CUTS)] * len(C.FEATURE_COLUMNS))
    return model.nodes(spark).select("node", "feature", "threshold", round_half("gain", 4).alias("gain"), round_half("cover", 4).alias("cover"),
                                     round_half("value", 6).alias("value"))


_TREES, _PSI, _SEED = 200, 256, 42
_ROWS = f"CAST({_TREES * 2 * _PSI} AS DOUBLE)"


def _mix_sql(x: str) -> str:
    """``ml.mixed`` once."""
    return f"(({x}) % 2147483647 * (({x}) % 2147483647) + 48271 * (({x}) % 2147483647) + 12345) % 2147483647"


def _draw_sql(tree: str, node: str, k: int) -> str:
    start = f"{tree} * 1000003 + {node} * 10007 + {k * 101 + _SEED}"
    return f"(SELECT {_mix_sql('b')} FROM (SELECT {_mix_sql('a')} AS b FROM (SELECT {_mix_sql('x')} AS a FROM (SELECT CAST({start} AS BIGINT) AS x))))"


def _level_sql(level: int) -> list[str]:
    """Nodes of a level with their splits, and the sampled rows one level on."""
    sizes = ", ".join(f"MIN(x[{i + 1}]) AS lo{i}, MAX(x[{i + 1}]) AS hi{i}" for i in range(len(C.FEATURE_COLUMNS)))
    free = ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(len(C.FEATURE_COLUMNS)))
    lows, highs = (", ".join(f"{e}{i}" for i in range(len(C.FEATURE_COLUMNS))) for e in ("lo", "hi"))
    return [f"""seen{level} AS MATERIALIZED (SELECT tree, node, COUNT(*) AS size, {sizes} FROM at{level} GROUP BY tree, node)""",
            f"""drawn{level} AS (SELECT *, {_draw_sql('tree', 'node', 0)} AS d0, {_draw_sql('tree', 'node', 1)} AS d1,
              list_filter([{free}], lambda i: i IS NOT NULL) AS free, [{lows}] AS lows, [{highs}] AS highs FROM seen{level})""",
            f"""nodes{level} AS MATERIALIZED (SELECT tree, node, size, feature, lows[feature + 1] + d1 / 2147483647.0::DOUBLE * (highs[feature + 1] - lows[feature + 1]) AS threshold
              FROM (SELECT *, CASE WHEN size > 1 AND len(free) > 0 AND {level} < 8 THEN free[d0 % len(free) + 1] END AS feature FROM drawn{level}) y)""",
            f"""at{level + 1} AS MATERIALIZED (SELECT a.tree, 2 * a.node + CASE WHEN x[n.feature + 1] < n.threshold THEN 1 ELSE 2 END AS node, x
              FROM at{level} a JOIN nodes{level} n USING (tree, node) WHERE n.feature IS NOT NULL)"""]


def _walk_sql(level: int) -> str:
    """Rows by tree at a level of the walk: node null where the row has reached its leaf."""
    step = f"CASE WHEN n.feature IS NOT NULL THEN 2 * w.node + CASE WHEN x[n.feature + 1] < n.threshold THEN 1 ELSE 2 END END"
    done = f"CASE WHEN n.feature IS NULL THEN {level} + CASE WHEN n.size <= 1 THEN 0.0 WHEN n.size = 2 THEN 1.0 " \
           f"ELSE 2.0 * (ln(n.size - 1.0) + {ML.EULER!r}) - 2.0 * (n.size - 1.0) / n.size END END"
    return f"""walk{level + 1} AS (SELECT w.tid, w.tree, {step} AS node, {done} AS path, w.x FROM walk{level} w
              JOIN nodes{level} n ON n.tree = w.tree AND n.node = w.node)"""


_LEVELS = 9
_FOREST_SQL = with_transactions(
    f"""SELECT transaction_id, merchant_id, is_fraud, {R(f"pow(2.0, -(total / {_TREES}.0) / {ML.c_factor(_PSI)!r})", 6)} AS iso_score
FROM (SELECT tid, SUM(path) AS total FROM ({" UNION ALL ".join(f"SELECT tid, path FROM walk{k + 1} WHERE path IS NOT NULL" for k in range(_LEVELS))}) p GROUP BY tid) s
JOIN tf ON tf.transaction_id = s.tid""",
    *TRAINING_FEATURES_CTES, ROUNDED_FEATURES_CTE,
    f"""rows AS MATERIALIZED (SELECT transaction_id AS tid, [{", ".join(f"CAST({c} AS DOUBLE)" for c in C.FEATURE_COLUMNS)}] AS x,
      CAST('0x' || substr(md5(transaction_id), 1, 8) AS BIGINT) AS m1, CAST('0x' || substr(md5(transaction_id), 9, 7) AS BIGINT) AS m2,
      least(1.0, {_ROWS} / (SELECT COUNT(*) FROM tf)) AS keep, (SELECT COUNT(*) FROM tf) AS n FROM tf)""",
    f"""keyed AS (SELECT tid, x, tree, {_mix_sql('y')} AS k, {2 * _PSI}.0 / (keep * n) AS share
      FROM (SELECT *, {_mix_sql(f"m2 + tree * 1000003 + {_SEED}")} AS y FROM rows, range({_TREES}) t(tree) WHERE m1 / 4294967296.0 < keep) z)""",
    f"""at0 AS MATERIALIZED (SELECT tree, CAST(0 AS BIGINT) AS node, x FROM (
      SELECT *, row_number() OVER (PARTITION BY tree ORDER BY k, tid) AS rn FROM keyed WHERE k / 2147483647.0 < share) q WHERE rn <= {_PSI})""",
    *[c for k in range(_LEVELS) for c in _level_sql(k)],
    f"walk0 AS (SELECT tid, tree, CAST(0 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS path, x FROM rows, range({_TREES}) t(tree))",
    *[_walk_sql(k) for k in range(_LEVELS)])


@register("isolation_forest_scores", "M-2", _FOREST_SQL)
def q_isolation_forest_scores(spark, sf_dir):
    """200 trees of 256 rows, grown by counters, and every row's score."""
    from paylens.session import cut_lineage
    f = cut_lineage(rounded_training_features(spark, sf_dir))
    nodes = ML.fit_isolation_forest(f, trees=_TREES, psi=_PSI, seed=_SEED)
    model = ML.load_isolation_forest(nodes, psi=_PSI)
    return model.transform(f).select("transaction_id", "merchant_id", "is_fraud",
                                     round_half("iso_score", 6).alias("iso_score"))
