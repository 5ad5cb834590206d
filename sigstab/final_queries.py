"""Queries of the search's later stages (several estimators, more splits, correlates, final scores) and their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BEST, FOLDS, INNER, RANKS, SCORED, SEARCH, SEARCHED, UNIQUE, anova_sql, cascade_sql, distance_sql, evaluate, mutual_sql, nearest_sql, plan, query, ranking, resample, rnd, rounded, signatures, stats
from .operators import trees
from .queries import ALL_PRED, BASE, CANDIDATES, DIST, GROUPS, KFOLD, METHODS, NEAR, OBS2, OBS3, OUTER_SPLITS, PAIR_TESTS, PAIRS, all_predictions, emb, log_sql, ranked_of, searched, splits3

EST = evaluate.ESTIMATORS


def inner_sql(name: str, k: int) -> str:
    """CTE of k inner splits in every outer fold."""
    return INNER.replace("inner_splits", name).replace("ntile(3)", f"ntile({k})").replace("range(3)", f"range({k})")


def estimators_sql(name: str, splits: str, keys: str) -> str:
    """CTEs: name_z, name_m and name (keys, estimator, sample_id, y, feature, c, d)."""
    head = distance_sql(name, splits, keys).split(f"{name}_m AS")[0]
    values = "(VALUES ('centroid'), ('naive_bayes'), ('manhattan')) e (estimator)"
    loss = "CASE estimator WHEN 'centroid' THEN pow(value - m, 2) WHEN 'manhattan' THEN abs(value - m) ELSE pow(value - m, 2) / v + ln(v) END"
    return f"""{head}{name}_m AS (SELECT {keys}, feature, y AS c, avg(value) AS m, greatest(1e-9, var_pop(value)) AS v FROM {name}_z WHERE NOT is_test GROUP BY {keys}, feature, y),
    {name} AS (SELECT {keys}, estimator, sample_id, t.y, feature, c, {loss} AS d FROM {name}_z t JOIN {name}_m USING ({keys}, feature), {values} WHERE is_test)"""


def sums_sql(d: str, found: str, keys: str) -> str:
    """keys, sig_id, sample_id, y, c, d; keys hold fold."""
    return f"(SELECT {keys}, sig_id, sample_id, y, c, sum(d) AS d FROM {d} JOIN (SELECT fold, sig_id, unnest(genes) AS feature FROM {found}) USING (fold, feature) GROUP BY {keys}, sig_id, sample_id, y, c)"


def summary_sql(pred: str, keys: str) -> str:
    return f"(SELECT {keys}, round_even(avg(s), 3) AS cv_mean, round_even(stddev_pop(s), 3) AS cv_std FROM (SELECT {keys}, split, avg(CAST(y_true = y_pred AS INTEGER)) AS s FROM {pred} GROUP BY {keys}, split) GROUP BY {keys})"


def probability_sql(sums: str, keys: str) -> str:
    """CTEs: pm (keys, roc_auc, average_precision, log_loss), from summed losses."""
    w = f"OVER (PARTITION BY {keys}, c ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"
    return f"""pe AS (SELECT *, exp((min(d) OVER (PARTITION BY {keys}, sample_id) - d) / 2) AS e FROM {sums}), pp AS (SELECT {keys}, sample_id, y, c, round(e / sum(e) OVER (PARTITION BY {keys}, sample_id), 9) AS p FROM pe),
    pv AS (SELECT {keys}, c, p, CAST(count(*) FILTER (y = c) AS DOUBLE) AS pos, CAST(count(*) FILTER (y <> c) AS DOUBLE) AS neg FROM pp GROUP BY {keys}, c, p),
    pr AS (SELECT *, sum(pos) {w} AS tp, sum(neg) {w} AS fp, sum(pos) OVER (PARTITION BY {keys}, c) AS n1, sum(neg) OVER (PARTITION BY {keys}, c) AS n0 FROM pv),
    pa AS (SELECT {keys}, c, sum(pos * (n0 - fp + neg / 2)) / any_value(n1 * n0) AS auc, sum(pos * tp / (tp + fp)) / any_value(n1) AS ap FROM pr WHERE n1 > 0 AND n0 > 0 GROUP BY {keys}, c),
    pm AS (SELECT * FROM (SELECT {keys}, avg(-ln(greatest(p, 1e-15))) AS log_loss FROM pp WHERE y = c GROUP BY {keys}) LEFT JOIN (SELECT {keys}, avg(auc) AS roc_auc, avg(ap) AS average_precision FROM pa GROUP BY {keys}) USING ({keys}))"""


def metrics_sql(pred: str, keys: str) -> str:
    """CTEs: mt (keys, accuracy, precision, recall, f1, fbeta, kappa, mcc), from predictions."""
    return f"""me AS (SELECT {keys}, c, CAST(sum(CAST(y_true = c AS INTEGER)) AS DOUBLE) AS t, CAST(sum(CAST(y_pred = c AS INTEGER)) AS DOUBLE) AS p, CAST(sum(CAST(y_true = c AND y_pred = c AS INTEGER)) AS DOUBLE) AS h FROM {pred}, (SELECT unnest(range(3)) AS c) GROUP BY {keys}, c),
    mf AS (SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS rc FROM me),
    mg AS (SELECT {keys}, sum(t) AS s, sum(h) AS h, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp, sum(t * pr) / sum(t) AS precision, sum(t * rc) / sum(t) AS recall, sum(t * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) / sum(t) AS f1, sum(t * CASE WHEN 0.25 * pr + rc > 0 THEN 1.25 * pr * rc / (0.25 * pr + rc) ELSE 0 END) / sum(t) AS fbeta FROM mf GROUP BY {keys}),
    mt AS (SELECT {keys}, h / s AS accuracy, precision, recall, f1, fbeta, CASE WHEN tp / (s * s) < 1 THEN (h / s - tp / (s * s)) / (1 - tp / (s * s)) ELSE 0 END AS kappa, CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (h * s - tp) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END AS mcc FROM mg)"""


# Metrics


@query(
    f"""WITH {OBS3}, {KFOLD}, {DIST}, {ALL_PRED}, e AS (SELECT split, c, count(*) FILTER (y_true = c) AS t, count(*) FILTER (y_pred = c) AS p, count(*) FILTER (y_true = c AND y_pred = c) AS h FROM ap, (SELECT unnest(range(3))::INTEGER AS c) GROUP BY split, c)
    SELECT split, c, t AS support, {rnd('CASE WHEN p > 0 THEN h / p::DOUBLE ELSE 0 END')} AS precision, {rnd('CASE WHEN t > 0 THEN h / t::DOUBLE ELSE 0 END')} AS recall, {rnd('CASE WHEN t + p > 0 THEN 2 * h / (t + p)::DOUBLE ELSE 0 END')} AS f1, {rnd('CASE WHEN t + p > 0 THEN 1.25 * h / (0.25::DOUBLE * t + p) ELSE 0 END')} AS fbeta FROM e WHERE t + p > 0"""
)
def cv_class_metrics(spark, sf_dir):
    return rounded(evaluate.class_metrics(evaluate.confusion(all_predictions(spark, sf_dir))), "precision", "recall", "f1", "fbeta")


@query(f"WITH {OBS3}, {KFOLD}, {DIST}, {probability_sql('(SELECT split, sample_id, y, c, sum(d) AS d FROM d0 GROUP BY ALL)', 'split')} SELECT split, {rnd('roc_auc')} AS roc_auc, {rnd('average_precision')} AS average_precision, {rnd('log_loss')} AS log_loss FROM pm")
def cv_probability_metrics(spark, sf_dir):
    obs = emb(spark, sf_dir)
    sums = evaluate.feature_distances(obs, splits3(obs)).groupBy("split", "sample_id", "y", "c").agg(F.sum("d").alias("d"))
    return rounded(evaluate.probability_metrics(evaluate.probabilities(sums, ("split",))), "roc_auc", "average_precision", "log_loss")


@query(f"WITH {OBS2} SELECT feature, {rnd('r')} AS r01, {rnd('-r')} AS r10 FROM (SELECT feature, {log_sql('a')} - {log_sql('b')} AS r FROM (SELECT feature, avg(value) FILTER (y = 0) AS a, avg(value) FILTER (y = 1) AS b FROM (SELECT * REPLACE (abs(value) AS value) FROM obs) GROUP BY feature))")
def class_log_ratio_two(spark, sf_dir):
    return rounded(stats.class_log_ratio_two(emb(spark, sf_dir, 2).withColumn("value", F.abs("value"))), "r01", "r10")


@query(f"WITH {OBS3} SELECT 'f' AS mode, feature, {rnd('score')} AS score FROM {anova_sql('obs')} UNION ALL SELECT 'reference', feature, {rnd('score')} FROM {mutual_sql('obs')}")
def anova_modes(spark, sf_dir):
    obs = emb(spark, sf_dir)
    both = [stats.anova_f(obs, mode=m).select(F.lit(m).alias("mode"), "feature", "score") for m in ("f", "reference")]
    return rounded(both[0].unionByName(both[1]), "score")


@query(f"WITH {BASE} SELECT fold, feature, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN pos END) AS {m}" for m in METHODS) + " FROM ranked GROUP BY fold, feature")
def rank_positions_wide(spark, sf_dir):
    return ranking.scores_wide(ranked_of(spark, sf_dir), METHODS, "pos")


@query(f"WITH {OBS3} SELECT CAST(least(20, count(DISTINCT feature), count(DISTINCT sample_id)) AS BIGINT) AS feature_limit FROM obs")
def signature_feature_limit(spark, sf_dir):
    return spark.range(1).select(F.lit(resample.feature_limit(emb(spark, sf_dir))).cast("long").alias("feature_limit"))


# Search: combinations, more splits, correlates

PAIRED = "cand AS (SELECT * FROM cand0 UNION ALL SELECT a.fold, 'smallcomb_' || a.method, list_sort([a.feature, b.feature]), array_to_string(list_sort([a.feature, b.feature]), '|'), 2 FROM ranked a JOIN ranked b ON a.fold = b.fold AND a.method = b.method AND a.pos < b.pos WHERE b.pos < 5)"
WITH_PAIRS = ", ".join([BASE, CANDIDATES.replace("cand AS", "cand0 AS", 1), PAIRED, UNIQUE, inner_sql("inner_splits", 3), SCORED])


@query(f"WITH {WITH_PAIRS} SELECT fold, sig_id, size, owner, cv_mean, cv_std, adjusted FROM scored")
def search_with_combinations(spark, sf_dir):
    config = plan.SignatureConfig(combinations=(2,))
    return plan.search(emb(spark, sf_dir), config, RANKS)[1].select("fold", "sig_id", "size", "owner", "cv_mean", "cv_std", "adjusted")


MORE = f"{inner_sql('more_splits', SEARCH.candidate_splits)}, {distance_sql('md', 'more_splits', 'fold, split')}"
ADJUSTED = "round_even((mean_freq / 10 + 0.9) * (cv_mean - 2 * cv_std), 3) AS adjusted"
CHOSEN = f"{NEAR}, {MORE}, np AS {nearest_sql(sums_sql('md', 'near', 'fold, split'), 'fold, split, sig_id')}, ns AS {summary_sql('np', 'fold, sig_id')}, chosen AS (SELECT fold, sig_id, genes, methods, mean_freq, ns.cv_mean, ns.cv_std, round_even((mean_freq / 10 + 0.9) * (ns.cv_mean - 2 * ns.cv_std), 3) AS adjusted FROM near JOIN ns USING (fold, sig_id))"


@query(f"WITH {SEARCHED}, {CHOSEN} SELECT fold, sig_id, cv_mean, cv_std, adjusted FROM chosen")
def candidate_rescore(spark, sf_dir):
    return plan.candidates(emb(spark, sf_dir), searched(spark, sf_dir)[1]).select("fold", "sig_id", "cv_mean", "cv_std", "adjusted")


@query(f"WITH {SEARCHED}, m AS (SELECT owner AS method, " + ", ".join(f"max(CASE WHEN fold = {k} THEN cv_mean END) AS fold_{k}" for k in FOLDS) + f" FROM scored GROUP BY owner) SELECT *, {rnd('(fold_0 + fold_1 + fold_2 + fold_3) / 4')} AS mean FROM m")
def max_score_first_owner(spark, sf_dir):
    found, scored = searched(spark, sf_dir)
    return rounded(signatures.max_per_rank(found, scored, FOLDS, first_owner=True), "mean")


def substitutes_sql(most: int) -> str:
    """CTEs: sub (fold, sig_id, genes, origin, methods, mean_freq), with each feature or one of its correlates."""
    steps = ["alt AS (SELECT kept, unnest(list_prepend(kept, dropped)) AS other FROM groups)", "w0 AS (SELECT fold, sig_id AS origin, genes AS base, methods, mean_freq, []::VARCHAR[] AS made FROM chosen)"]
    for i in range(most):
        steps.append(f"w{i + 1} AS (SELECT fold, origin, base, methods, mean_freq, CASE WHEN len(base) > {i} THEN list_append(made, coalesce(other, base[{i + 1}])) ELSE made END AS made FROM w{i} LEFT JOIN alt ON kept = base[{i + 1}])")
    steps.append(f"sub0 AS (SELECT fold, list_sort(made) AS genes, array_to_string(list_sort(made), '|') AS sig_id, origin, methods, mean_freq FROM w{most})")
    steps.append("sub AS (SELECT * FROM sub0 ANTI JOIN chosen USING (fold, sig_id) QUALIFY row_number() OVER (PARTITION BY fold, sig_id ORDER BY origin) = 1)")
    return ", ".join(steps)


STRICT = 0.15  # of |r|; the ways of a signature multiply with its features' correlates
CORRELATES = f"{PAIRS}, {PAIR_TESTS}, {GROUPS.replace('> 0.1)', f'> {STRICT})')}, {substitutes_sql(SEARCH.most_features)}"


@query(
    f"""WITH {SEARCHED}, {CHOSEN}, {CORRELATES}, sp2 AS {nearest_sql(sums_sql('md', 'sub', 'fold, split'), 'fold, split, sig_id')}, ss2 AS {summary_sql('sp2', 'fold, sig_id')},
    edge AS (SELECT fold, max(cv_mean) AS top FROM chosen GROUP BY fold)
    SELECT fold, sig_id, cv_mean, cv_std, adjusted, false AS correlate FROM chosen UNION ALL SELECT fold, sig_id, cv_mean, cv_std, {ADJUSTED}, true FROM sub JOIN ss2 USING (fold, sig_id) JOIN edge USING (fold) WHERE round(cv_mean * 1000) > round(top * 1000) - 100"""
)
def correlates_near_best(spark, sf_dir):
    obs = emb(spark, sf_dir)
    chosen = plan.candidates(obs, searched(spark, sf_dir)[1])
    groups = stats.correlation_groups(stats.pearson_tests(stats.pearson_pairs(obs)), STRICT, 0.9)
    return plan.with_correlates(obs, chosen, groups).select("fold", "sig_id", "cv_mean", "cv_std", "adjusted", "correlate")


# Several estimators

MANY = f"{estimators_sql('ed', 'inner_splits', 'fold, split')}, ep AS {nearest_sql(sums_sql('ed', 'uniq', 'estimator, fold, split'), 'estimator, fold, split, sig_id')}, es AS {summary_sql('ep', 'fold, sig_id, estimator')}"
SEARCHED_MANY = f"{SEARCHED}, {MANY}"


def estimator_scores(spark, sf_dir):
    return plan.estimator_scores(emb(spark, sf_dir), searched(spark, sf_dir)[1], SEARCH.inner_splits, RANKS)


@query(f"WITH {SEARCHED_MANY} SELECT fold, sig_id, " + ", ".join(f"max(CASE WHEN estimator = '{e}' THEN cv_mean END) AS cv_{e}" for e in EST) + " FROM es GROUP BY fold, sig_id")
def signature_estimator_scores(spark, sf_dir):
    return signatures.catalogue_table(estimator_scores(spark, sf_dir), EST)


@query(f"WITH {SEARCHED_MANY}, m AS (SELECT fold, estimator, avg(cv_mean) AS score FROM es GROUP BY fold, estimator) SELECT fold, estimator, {rnd('score')} AS score FROM m QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(score, 9) DESC, list_position(['centroid', 'naive_bayes', 'manhattan'], estimator)) = 1")
def pick_estimator(spark, sf_dir):
    return rounded(signatures.pick_estimator(estimator_scores(spark, sf_dir), EST), "score")


NAMES = ("accuracy", "precision", "recall", "f1", "fbeta", "kappa", "mcc", "roc_auc", "average_precision", "log_loss")
ALL_KEYS = "part, estimator, fold, split, sig_id"
BOTH_SPLITS = f"{inner_sql('final_splits', SEARCH.final_splits)}, {OUTER_SPLITS}, both_splits AS (SELECT 'cv' AS part, fold, sample_id, split, is_test FROM final_splits UNION ALL SELECT 'test', fold, sample_id, 0, is_test FROM osp)"


@query(
    f"""WITH {SEARCHED}, {BEST}, {BOTH_SPLITS}, {estimators_sql('fd', 'both_splits', 'part, fold, split')}, fs AS {sums_sql('fd', 'best', 'part, estimator, fold, split')}, fp AS {nearest_sql('fs', ALL_KEYS)},
    {metrics_sql('fp', ALL_KEYS)}, {probability_sql('fs', ALL_KEYS)}, fm AS (SELECT fold, sig_id, estimator, part, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM mt JOIN pm USING ({ALL_KEYS}) GROUP BY fold, sig_id, estimator, part)
    SELECT fold, sig_id, estimator, part, {', '.join(f'{rnd(n)} AS {n}' for n in NAMES)}, row_number() OVER (PARTITION BY fold, sig_id, part ORDER BY round(f1, 9) DESC, list_position(['centroid', 'naive_bayes', 'manhattan'], estimator)) = 1 AS best FROM fm"""
)
def final_evaluation(spark, sf_dir):
    chosen = signatures.best(searched(spark, sf_dir)[1])
    return rounded(plan.final_evaluation(emb(spark, sf_dir), chosen), *NAMES)


@query()
def double_cross_validation_oversampled(spark, sf_dir):
    chosen = signatures.best(searched(spark, sf_dir)[1])
    return rounded(plan.double_cross_validation_oversampled(emb(spark, sf_dir), chosen, RANKS), "mean", "std", "mean_smote", "std_smote")


# Rankings of all types


@query()
def rank_scores_all_types(spark, sf_dir):
    """fold, method, feature, score, pos of every ranking: sums, linear estimators and trees, in each outer fold."""
    return rounded(plan.rank(emb(spark, sf_dir), plan.RankConfig(fitted=True)), "score")


# Estimators of signatures


@query(f"WITH {SEARCHED_MANY} SELECT fold, sig_id, estimator, cv_mean AS score FROM (SELECT *, rank() OVER (PARTITION BY sig_id ORDER BY cv_mean DESC) AS r FROM es) WHERE r = 1")
def best_estimators(spark, sf_dir):
    """The estimators, and folds, in which a signature has its highest score."""
    return signatures.best_estimators(estimator_scores(spark, sf_dir).select("fold", "sig_id", "estimator", F.col("cv_mean").alias("score")))


ALL_ESTIMATORS = (*EST, "ridge", "lda", "bag_ridge", "bag_lda")


def model_scores(spark, sf_dir):
    return plan.model_scores(emb(spark, sf_dir), searched(spark, sf_dir)[1], SEARCH, RANKS)


@query()
def signature_model_scores(spark, sf_dir):
    """fold, sig_id and a score for each additive, linear and bagged estimator."""
    return signatures.catalogue_table(model_scores(spark, sf_dir), ALL_ESTIMATORS)


@query()
def pick_estimator_of_all(spark, sf_dir):
    return rounded(signatures.pick_estimator(model_scores(spark, sf_dir), ALL_ESTIMATORS), "score")


@query()
def search_with_large_combinations(spark, sf_dir):
    """Scores of prefixes, of all combinations of two to four and of drawn ones of five and six of the first eight features."""
    large = plan.SignatureConfig(most_features=8, combinations=(2, 3, 4), sampled=(5, 6), samples=5)
    return plan.search(emb(spark, sf_dir), large, RANKS)[1].select("fold", "sig_id", "size", "cv_mean", "cv_std")


@query()
def final_model_evaluation(spark, sf_dir):
    """Metrics of the chosen signatures with linear models and their bagged forms, inside and outside."""
    chosen = plan.stored(signatures.best(searched(spark, sf_dir)[1]))
    out = plan.model_evaluation(emb(spark, sf_dir), chosen, SEARCH, RANKS)
    return rounded(out, *[c for c, kind in out.dtypes if kind == "double"])


# Trees and orders of all rows


@query()
def nj_trees_up(spark, sf_dir):
    return trees.feature_trees(emb(spark, sf_dir), direction="up")


@query()
def nj_trees_down(spark, sf_dir):
    return trees.feature_trees(emb(spark, sf_dir), direction="down")


@query()
def nj_tree_of_samples(spark, sf_dir):
    """One neighbour-joining tree of all samples, from their Euclidean distances."""
    return trees.points_tree(emb(spark, sf_dir))


@query()
def feature_cluster_order(spark, sf_dir):
    """The order of features in a cluster map: average linkage of 1 - r."""
    pairs = stats.pearson_pairs(emb(spark, sf_dir)).select("a", "b", (1 - F.coalesce("r", F.lit(0.0))).alias("d"))
    return trees.clustered(pairs)
