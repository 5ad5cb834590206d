"""The queries themselves; see catalog."""

from __future__ import annotations

from functools import reduce

from .operators import models, trees
from .catalog import (
    BASE, BEST, CANDIDATES, DOC2, FOLDS, INNER, LI, METHODS, OUTER, QUERIES, RANKS, SAMPLES, SEARCH, SEARCHED, TRAIN0, UNIQUE,
    DataFrame, F, SparkSession, Window, anova_sql, bh_sql, cascade_sql, chi2_sql, distance_sql, evaluate, kruskal_sql, matrix, moments_sql, mutual_sql, nearest_sql, normal_sql, obs_sql, plan, query,
    ranking, ranks_sql, resample, rnd, rounded, scaling, signatures, stats, zscore_sql,
)

OBS3, OBS2 = obs_sql(3), obs_sql(2)


def emb(spark: SparkSession, sf_dir: str, classes: int = 3) -> DataFrame:
    return matrix.embeddings(spark, sf_dir, classes)


# 2.1-2.2: scans, scaling, projections


@query(f"WITH {OBS3} SELECT sample_id, label, y, feature, {rnd('value')} AS value FROM obs")
def matrix_long(spark, sf_dir):
    return rounded(emb(spark, sf_dir).select("sample_id", "label", "y", "feature", "value"), "value")


@query(f"WITH {OBS3} SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y, count(DISTINCT sample_id) AS n FROM obs GROUP BY label")
def class_levels(spark, sf_dir):
    return matrix.class_levels(emb(spark, sf_dir))


@query(f"WITH {OBS3} SELECT sample_id, feature, {rnd('value')} AS v FROM {zscore_sql('obs')}")
def matrix_zscore(spark, sf_dir):
    return rounded(scaling.zscore(emb(spark, sf_dir)).select("sample_id", "feature", F.col("value").alias("v")), "v")


@query(f"WITH {OBS3} SELECT sample_id, feature, {rnd('value / CASE WHEN n = 0 THEN 1 ELSE n END')} AS v FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY sample_id)) AS n FROM obs)")
def matrix_l2norm(spark, sf_dir):
    return rounded(scaling.l2_normalise(emb(spark, sf_dir)).select("sample_id", "feature", F.col("value").alias("v")), "v")


@query(f"WITH {OBS3} SELECT sample_id, feature, {rnd('1e-8 + (1 - 1e-8) * (value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END')} AS v FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM obs)")
def matrix_minmax(spark, sf_dir):
    return rounded(scaling.min_max(emb(spark, sf_dir)).select("sample_id", "feature", F.col("value").alias("v")), "v")


@query(
    f"""WITH {OBS3}, q AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM obs GROUP BY feature),
    s AS (SELECT sample_id, feature, (value - b) / CASE WHEN c = a THEN 1 ELSE c - a END AS v FROM obs JOIN q USING (feature))
    SELECT sample_id, feature, {rnd('CASE WHEN v > -0.5 AND v < 0.5 THEN 0 ELSE v END')} AS band, {rnd('CASE WHEN v >= 0.5 THEN v ELSE 0 END')} AS up, {rnd('CASE WHEN v <= -0.5 THEN v ELSE 0 END')} AS down FROM s"""
)
def matrix_robust_mask(spark, sf_dir):
    out = scaling.bands(scaling.robust(emb(spark, sf_dir))).select("sample_id", "feature", "band", "up", "down").na.fill(0.0, ["band", "up", "down"])
    return rounded(out, "band", "up", "down")


@query(f"WITH {OBS3}, l AS (SELECT DISTINCT feature, row_number() OVER (ORDER BY feature DESC) - 1 AS place FROM (SELECT DISTINCT feature FROM obs WHERE feature_pos % 8 = 3)) SELECT sample_id, feature, CAST(place AS INTEGER) AS feature_pos, {rnd('value')} AS value FROM obs JOIN l USING (feature)")
def feature_projection(spark, sf_dir):
    obs = emb(spark, sf_dir)
    names = obs.where("feature_pos % 8 = 3").select("feature").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.desc("feature"))) - 1)
    return rounded(scaling.project(obs, names).select("sample_id", "feature", "feature_pos", "value"), "value")


PIVOT5 = ["f00", "f07", "f21", "f40", "f63"]


@query(f"WITH {OBS3} SELECT sample_id, label AS class, " + ", ".join(f"round(max(CASE WHEN feature = '{f}' THEN value END), 6) + 0.0 AS {f}" for f in PIVOT5) + f" FROM {zscore_sql('obs')} GROUP BY sample_id, label")
def zscore_with_class(spark, sf_dir):
    return rounded(scaling.with_class_column(scaling.zscore(emb(spark, sf_dir)), PIVOT5), *PIVOT5)


@query(f"WITH {OBS3} SELECT min(n) AS n_min, min(n) - 1 AS reference_min FROM (SELECT label, count(*) AS n FROM {SAMPLES} GROUP BY label)")
def min_class_size(spark, sf_dir):
    return resample.class_balance(resample.samples_of(emb(spark, sf_dir))).select("n_min", "reference_min")


@query(
    f"""WITH {DOC2}, s AS (SELECT label, count(*) AS n FROM doc2 GROUP BY label), e AS (SELECT min(n) AS n_min, max(n) AS n_max, CAST(sum(n) AS BIGINT) AS n, count(*) AS levels, CAST(min(n) AS DOUBLE) / max(n) AS ratio FROM s)
    SELECT n_min, {rnd('ratio')} AS ratio, ratio <= 0.95 AS unbalanced, CASE WHEN n_min >= 11 THEN 0.2::DOUBLE WHEN ratio > 0.95 OR 0.1 * n < levels THEN CAST(levels AS DOUBLE) ELSE 0.1::DOUBLE END AS test_size FROM e"""
)
def class_balance_test_size(spark, sf_dir):
    return rounded(resample.class_balance(matrix.labelled_documents(spark, sf_dir)).drop("reference_min"), "ratio")


# 2.4: tests and scores


def log_sql(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN log2(1e-7) WHEN {x} > 0 THEN log2({x}) END)"


def ratio_sql(src: str) -> str:
    return f"SELECT feature, {log_sql('m0')} - {log_sql('m1')} AS r01, {log_sql('m0')} - {log_sql('m2')} AS r02, {log_sql('m1')} - {log_sql('m2')} AS r12 FROM (SELECT feature, avg(value) FILTER (y = 0) AS m0, avg(value) FILTER (y = 1) AS m1, avg(value) FILTER (y = 2) AS m2 FROM {src} GROUP BY feature)"


LI_Y = f"{LI}, liy AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS y FROM li)"


@query(f"WITH {LI_Y} SELECT feature, {rnd('r01')} AS r01, {rnd('r02')} AS r02, {rnd('r12')} AS r12 FROM ({ratio_sql('liy')})")
def class_log_ratio(spark, sf_dir):
    return rounded(stats.class_log_ratio_of_labels(matrix.lineitems(spark, sf_dir)), "r01", "r02", "r12")


MINMAX = "(SELECT * REPLACE (1e-8 + (1 - 1e-8) * (value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS value) FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM obs))"


@query(f"WITH {OBS3} SELECT feature, " + ", ".join(rnd(f"greatest(-1, least(1, {r}))") + f" AS {r}" for r in ("r01", "r02", "r12")) + f" FROM ({ratio_sql(MINMAX)})")
def class_log_ratio_clamped(spark, sf_dir):
    out = stats.class_log_ratio(scaling.min_max(emb(spark, sf_dir)))
    return rounded(out.withColumns({r: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)) for r in ("r01", "r02", "r12")}), "r01", "r02", "r12")


@query("""WITH o AS (SELECT 'price' AS feature, o_orderkey AS sample_id, round(o_totalprice / 1000) AS value FROM orders)
SELECT sample_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / CAST(2 AS DOUBLE) AS rank, count(*) OVER (PARTITION BY value) AS ties FROM o""")
def avg_rank_ties(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    obs = orders.select(F.lit("price").alias("feature"), F.col("o_orderkey").alias("sample_id"), F.round(F.col("o_totalprice") / 1000).alias("value"))
    return stats.average_ranks(obs, wide=True).select("sample_id", F.col("rank").cast("double").alias("rank"), "ties")


@query(f"WITH oo AS (SELECT 'price' AS feature, o_totalprice AS value, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS y FROM orders) SELECT feature, {rnd('h')} AS h, {rnd('p')} AS p FROM {kruskal_sql('oo')}")
def kruskal_h(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("price").alias("feature"), F.col("o_totalprice").alias("value"), "o_orderstatus")
    levels = orders.select("o_orderstatus").distinct().withColumn("y", F.dense_rank().over(Window.orderBy("o_orderstatus")) - 1)
    # without the hint rows are dealt by status first, as the plan can't tell how few levels there are
    return rounded(stats.kruskal(orders.join(F.broadcast(levels), "o_orderstatus"), wide=True), "h", "p")


@query(
    f"""WITH {OBS3}, t AS (SELECT * FROM {bh_sql(kruskal_sql('obs'))} WHERE p < 0.3), s AS (SELECT *, min(h) OVER () AS lo, max(h) OVER () AS hi FROM t)
    SELECT feature, {rnd('h')} AS h, {rnd('p', 9)} AS p, {rnd('q', 9)} AS q, {rnd('CASE WHEN hi = lo THEN h ELSE (h - lo) / (hi - lo) END')} AS score, CAST(row_number() OVER (ORDER BY round(CASE WHEN hi = lo THEN h ELSE (h - lo) / (hi - lo) END, 8) DESC, feature) - 1 AS INTEGER) AS pos FROM s"""
)
def kruskal_filter_top(spark, sf_dir):
    """The flagship of single tests: Kruskal-Wallis, false discovery rate, filter, normalised score and position."""
    good = stats.passing(stats.benjamini_hochberg(stats.kruskal(emb(spark, sf_dir))), 0.3, "p").withColumn("method", F.lit("kruskal")).withColumn("score", F.col("h"))
    ranked = ranking.positions(ranking.normalise(good, ()), ())
    return rounded(rounded(ranked.select("feature", "h", "p", "q", "score", "pos"), "h", "score"), "p", "q", digits=9)


@query(f"WITH {OBS2} SELECT feature, {rnd('z')} AS z, {rnd(normal_sql('z'))} AS p FROM (SELECT feature, (s0 - n0 * (n0 + n1 + 1) / 2) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12) AS z FROM {ranks_sql('obs')})")
def wilcoxon_ranksum(spark, sf_dir):
    return rounded(stats.wilcoxon(emb(spark, sf_dir, 2)), "z", "p")


T_BASE = "m AS (SELECT feature, max(CASE WHEN y = 0 THEN n END) AS n0, max(CASE WHEN y = 1 THEN n END) AS n1, max(CASE WHEN y = 0 THEN m END) AS m0, max(CASE WHEN y = 1 THEN m END) AS m1, max(CASE WHEN y = 0 THEN v END) AS v0, max(CASE WHEN y = 1 THEN v END) AS v1 FROM {src} GROUP BY feature), t AS (SELECT feature, (m0 - m1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1 / n0 + 1 / n1)) AS t, CAST(n0 + n1 - 2 AS BIGINT) AS df FROM m)"


def t_tail_sql(src: str, keys: str) -> str:
    """CTE tail (keys, p) of (keys, t, df): the series summed over rows, for whole degrees of freedom."""
    return f"""ang AS (SELECT {keys}, df, atan(abs(t) / sqrt(df)) AS a FROM {src}),
    js AS (SELECT j, exp(sum(CASE WHEN j = 0 THEN 0 ELSE ln((2.0::DOUBLE * j - 1) / (2.0::DOUBLE * j)) END) OVER (ORDER BY j)) AS ce, exp(sum(CASE WHEN j = 0 THEN 0 ELSE ln(2.0::DOUBLE * j / (2.0::DOUBLE * j + 1)) END) OVER (ORDER BY j)) AS co FROM (SELECT unnest(range(3000)) AS j)),
    tail AS (SELECT {keys}, greatest(0, 1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (a + sin(a) * sum(co * cos(a) * pow(pow(cos(a), 2), j))) ELSE sin(a) * sum(ce * pow(pow(cos(a), 2), j)) END) AS p
      FROM ang JOIN js ON j < CASE WHEN df % 2 = 1 THEN (df - 1) // 2 ELSE df // 2 END GROUP BY {keys}, df, a)"""


@query(f"WITH {OBS2}, " + T_BASE.format(src=moments_sql("obs")) + ", " + t_tail_sql("t", "feature") + f" SELECT feature, {rnd('t')} AS t, df, {rnd('p')} AS p FROM t JOIN tail USING (feature)")
def ttest_stat(spark, sf_dir):
    return rounded(stats.t_test(emb(spark, sf_dir, 2)), "t", "p")


@query(f"WITH {LI_Y} SELECT feature, {rnd('score', 4)} AS score FROM {chi2_sql('liy')}")
def chi2_score(spark, sf_dir):
    obs = matrix.lineitems(spark, sf_dir)
    return rounded(stats.chi2(obs.withColumnRenamed("label", "y")), "score", digits=4)


@query(f"WITH {OBS3} SELECT feature, {rnd('score')} AS score FROM {anova_sql('obs')}")
def anova_f(spark, sf_dir):
    return rounded(stats.anova_f(emb(spark, sf_dir)), "score")


@query(f"WITH {OBS3} SELECT feature, {rnd('score')} AS score FROM {mutual_sql('obs')}")
def binned_mutual_info(spark, sf_dir):
    return rounded(stats.binned_mutual_information(emb(spark, sf_dir)), "score")


Z_TESTS = f"(SELECT feature, {normal_sql('z')} AS p FROM (SELECT feature, (s0 - n0 * (n0 + n1 + 1) / 2) / sqrt(n0 * n1 * (n0 + n1 + 1) / 12) AS z FROM {ranks_sql('obs')}))"


@query(f"WITH {OBS2} SELECT feature, {rnd('p')} AS p, {rnd('q')} AS q FROM {bh_sql(Z_TESTS)}")
def bh_fdr(spark, sf_dir):
    return rounded(stats.benjamini_hochberg(stats.wilcoxon(emb(spark, sf_dir, 2))).select("feature", "p", "q"), "p", "q")


@query(f"WITH {OBS2}, g AS (SELECT *, count(*) FILTER (q < 0.3) OVER () AS n FROM {bh_sql(Z_TESTS)}) SELECT feature, {rnd('q')} AS q, n >= 4 AS enough, n >= 4 AND q < 0.3 AS kept FROM g")
def fdr_gate_filter(spark, sf_dir):
    gated = stats.fdr_gate(stats.benjamini_hochberg(stats.wilcoxon(emb(spark, sf_dir, 2))), 0.3)
    return rounded(gated.select("feature", "q", "enough", "kept"), "q")


PAIRS = "pairs AS (SELECT a.feature AS a, b.feature AS b, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN greatest(-1, least(1, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)))) END AS r, count(*) AS n FROM obs a JOIN obs b ON a.sample_id = b.sample_id AND a.feature_pos < b.feature_pos GROUP BY 1, 2)"
PAIR_TESTS = f"pt AS (SELECT a, b, a || '|' || b AS name, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df, r, n FROM pairs), {t_tail_sql('pt', 'name')}, tests AS {bh_sql('(SELECT a, b, name, r, n, CASE WHEN abs(r) >= 1 THEN 0 ELSE p END AS p FROM pt JOIN tail USING (name))', name='name')}"


@query(f"WITH {OBS3}, {PAIRS}, {PAIR_TESTS} SELECT a, b, {rnd('r')} AS r, {rnd('p')} AS p, {rnd('q')} AS q FROM tests")
def pearson_pairs(spark, sf_dir):
    return rounded(stats.pearson_tests(stats.pearson_pairs(emb(spark, sf_dir))).select("a", "b", "r", "p", "q"), "r", "p", "q")


@query(f"WITH {OBS3}, {PAIRS} SELECT a, b, CASE WHEN r < 0.1 THEN 0 ELSE {rnd('r')} END AS r FROM pairs")
def corr_threshold_zero(spark, sf_dir):
    return rounded(stats.threshold_to_zero(stats.pearson_pairs(emb(spark, sf_dir)), 0.1).select("a", "b", "r"), "r")


@query(f"WITH {OBS3}, {PAIRS} SELECT a, b, {rnd('CASE WHEN r * r >= 1 THEN 1e300 ELSE 1 / (1 - r * r) END')} AS vif FROM pairs")
def vif_pairs(spark, sf_dir):
    out = stats.variance_inflation(stats.pearson_pairs(emb(spark, sf_dir)))
    return rounded(out.select("a", "b", F.least(F.lit(1e300), "vif").alias("vif")), "vif")


GROUPS = "strong AS (SELECT a, b FROM tests WHERE q < 0.9 AND abs(r) > 0.1), groups AS (SELECT a AS kept, list_sort(list(DISTINCT b)) AS dropped FROM strong WHERE a NOT IN (SELECT b FROM strong) GROUP BY a)"


@query(f"WITH {OBS3}, {PAIRS}, {PAIR_TESTS}, {GROUPS} SELECT kept, array_to_string(dropped, '|') AS dropped FROM groups")
def corr_prune_groups(spark, sf_dir):
    return corr_groups(spark, sf_dir).select("kept", F.concat_ws("|", "dropped").alias("dropped"))


def corr_groups(spark, sf_dir) -> DataFrame:
    return stats.correlation_groups(stats.pearson_tests(stats.pearson_pairs(emb(spark, sf_dir))), 0.1, 0.9)


@query(f"WITH {OBS3}, {PAIRS}, {PAIR_TESTS}, {GROUPS} SELECT kept, unnest(dropped) AS dropped FROM groups")
def corr_groups_roundtrip(spark, sf_dir):
    lines = corr_groups(spark, sf_dir).select(F.concat_ws(",", F.array("kept"), "dropped").alias("line"))
    cells = F.split("line", ",")
    return lines.select(cells[0].alias("kept"), F.explode(F.slice(cells, F.lit(2), F.size(cells))).alias("dropped")).where("dropped <> ''")


@query(f"WITH {OBS3} SELECT a.sample_id AS a, b.sample_id AS b, {rnd('sqrt(sum(pow(a.value - b.value, 2)))')} AS d FROM obs a JOIN obs b ON a.feature = b.feature AND a.sample_id < b.sample_id WHERE a.sample_id < 40 AND b.sample_id < 40 GROUP BY 1, 2")
def sample_distance_pairs(spark, sf_dir):
    return rounded(stats.distances(emb(spark, sf_dir).where("sample_id < 40")), "d")


@query()
def sample_distance_pairs_whole(spark, sf_dir):
    return rounded(stats.distances(emb(spark, sf_dir)), "d")


# Resampling


@query(f"WITH {OBS3} SELECT sample_id, label, CAST(ntile(5) OVER (PARTITION BY label ORDER BY sample_id) - 1 AS INTEGER) AS fold FROM {SAMPLES}")
def stratified_kfold(spark, sf_dir):
    return resample.stratified_folds(resample.samples_of(emb(spark, sf_dir)), 5)


@query(f"WITH {DOC2} SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || sample_id), sample_id) <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test FROM doc2")
def stratified_holdout(spark, sf_dir):
    return resample.holdout(matrix.labelled_documents(spark, sf_dir), 0.2, 7)


@query(f"WITH {OBS3}, s AS (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS split FROM {SAMPLES}) SELECT sample_id, label, split, row_number() OVER (PARTITION BY split, label ORDER BY md5('0|' || split || '|' || sample_id), sample_id) <= ceil(count(*) OVER (PARTITION BY split, label) * 0.25::DOUBLE) AS is_test FROM s")
def shuffle_splits(spark, sf_dir):
    return resample.shuffle_splits(resample.samples_of(emb(spark, sf_dir)), 4, 0.25)


@query(f"WITH {DOC2}, a AS (SELECT *, row_number() OVER (ORDER BY sample_id) AS n FROM doc2), b AS (SELECT label AS permuted, row_number() OVER (ORDER BY md5('3|' || sample_id), sample_id) AS n FROM doc2) SELECT sample_id, label, permuted FROM a JOIN b USING (n)")
def label_permutation(spark, sf_dir):
    return resample.permute(matrix.labelled_documents(spark, sf_dir), "label", seed=3)


SMALL = "small AS (SELECT * FROM obs WHERE sample_id < 120 AND feature_pos < 6)"
U32 = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


@query(
    f"""WITH {OBS3}, {SMALL}, own AS (SELECT sample_id, feature, value FROM small WHERE label = 'c1'),
    d AS (SELECT a.sample_id AS a, b.sample_id AS b, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM own a JOIN own b ON a.feature = b.feature AND a.sample_id <> b.sample_id GROUP BY 1, 2),
    near AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM d), base AS (SELECT sample_id, row_number() OVER (ORDER BY md5('0|' || sample_id), sample_id) - 1 AS n FROM (SELECT DISTINCT sample_id FROM own)),
    want AS (SELECT id AS new_id, id % (SELECT count(*) FROM base) AS n, {U32.format(x="'0|k|' || id")} % 5 + 1 AS r, {U32.format(x="'0|u|' || id")} / 4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(30)) AS id))
    SELECT new_id, 'c1' AS label, x.feature, {rnd('x.value + u * (y.value - x.value)')} AS value FROM want JOIN base USING (n) JOIN near ON near.a = base.sample_id AND near.r = want.r JOIN own x ON x.sample_id = base.sample_id JOIN own y ON y.sample_id = near.b AND y.feature = x.feature"""
)
def smote_oversample(spark, sf_dir):
    small = emb(spark, sf_dir).where("sample_id < 120 and feature_pos < 6")
    return rounded(resample.smote(small, "c1", 30), "value")


@query()
def smote_oversample_whole(spark, sf_dir):
    return rounded(resample.smote_to_majority(emb(spark, sf_dir)), "value")


# Rankings


def ranked_of(spark, sf_dir) -> DataFrame:
    return plan.rank(emb(spark, sf_dir), RANKS)


@query(f"WITH {BASE} SELECT fold, method, feature, {rnd('score')} AS score FROM ranked")
def rank_scores(spark, sf_dir):
    return rounded(ranked_of(spark, sf_dir).drop("pos"), "score")


@query(f"WITH {BASE} SELECT fold, method, feature, pos FROM ranked")
def rank_positions(spark, sf_dir):
    return ranked_of(spark, sf_dir).drop("score")


@query(f"WITH {BASE} SELECT fold, pos, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN feature END) AS {m}" for m in METHODS) + " FROM ranked GROUP BY fold, pos")
def rank_names_wide(spark, sf_dir):
    return ranking.names_wide(ranked_of(spark, sf_dir), METHODS)


@query(f"WITH {BASE} SELECT fold, feature, " + ", ".join(f"round(max(CASE WHEN method = '{m}' THEN score END), 6) + 0.0 AS {m}" for m in METHODS) + " FROM ranked GROUP BY fold, feature")
def rank_scores_wide(spark, sf_dir):
    return rounded(ranking.scores_wide(ranked_of(spark, sf_dir), METHODS), *METHODS)


@query(f"WITH {BASE} SELECT fold, method, feature, {rnd('greatest(0.7, score)')} AS score, least(10, pos) AS pos FROM ranked")
def rank_clamped_scores(spark, sf_dir):
    return rounded(ranking.clamp(ranked_of(spark, sf_dir)), "score")


@query(f"WITH {BASE} SELECT fold, method, {rnd('min(score)')} AS least, {rnd('max(score)')} AS most, array_to_string(list_sort(list(DISTINCT feature)), '|') AS names FROM ranked WHERE pos < 10 GROUP BY fold, method")
def rank_top_report(spark, sf_dir):
    none = spark.createDataFrame([], "kept string, dropped array<string>")
    out = ranking.top_report(ranked_of(spark, sf_dir), none)
    return rounded(out.select("fold", "method", "least", "most", F.concat_ws("|", "names").alias("names")), "least", "most")


@query(f"WITH {BASE} SELECT fold, feature, count(*) FILTER (pos < 10) AS n, {rnd('count(*) FILTER (pos < 10) / 5.0::DOUBLE')} AS freq FROM ranked GROUP BY fold, feature")
def top10_frequency(spark, sf_dir):
    return rounded(ranking.top_counts(ranked_of(spark, sf_dir)).withColumn("freq", F.col("n") / len(METHODS)), "freq")


@query(f"WITH {BASE} SELECT feature, " + ", ".join(f"count(*) FILTER (pos < 10 AND fold = {k}) AS fold_{k}" for k in FOLDS) + " FROM ranked GROUP BY feature")
def top10_freq_per_fold(spark, sf_dir):
    return ranking.top_counts_wide(ranking.top_counts(ranked_of(spark, sf_dir)), FOLDS)


@query(f"WITH {BASE} SELECT feature, n, n > 5 / 3.0::DOUBLE * 4 AS kept FROM (SELECT feature, count(*) FILTER (pos < 10) AS n FROM ranked GROUP BY feature)")
def stable_features(spark, sf_dir):
    return ranking.stable(ranking.top_counts(ranked_of(spark, sf_dir)), len(METHODS), len(FOLDS))


@query(f"WITH {BASE} SELECT feature, method, {rnd('avg(score)')} AS mean, {rnd('stddev_pop(score)')} AS std FROM ranked GROUP BY feature, method")
def stability_mean_std(spark, sf_dir):
    return rounded(ranking.mean_std(ranked_of(spark, sf_dir)), "mean", "std")


@query(f"WITH {BASE} SELECT feature, method, {rnd('greatest(0, avg(score) - 2 * stddev_pop(score))')} AS lower FROM ranked GROUP BY feature, method")
def stability_lower_conf(spark, sf_dir):
    return rounded(ranking.lower_confidence(ranking.mean_std(ranked_of(spark, sf_dir))).select("feature", "method", "lower"), "lower")


def half_sql(of: str, absent: str) -> str:
    return f"""WITH {BASE}, k AS (SELECT fold, feature, avg(score) AS half FROM (SELECT *, row_number() OVER (PARTITION BY fold, feature ORDER BY score DESC, method) AS r FROM ranked JOIN (SELECT fold, count(DISTINCT feature) AS nf FROM ranked GROUP BY fold) USING (fold)) WHERE r <= {of} GROUP BY ALL)
    SELECT feature, fold, coalesce({rnd('half')}, {absent}) AS half FROM (SELECT DISTINCT feature FROM ranked) CROSS JOIN (SELECT DISTINCT fold FROM ranked) LEFT JOIN k USING (feature, fold)"""


@query(half_sql("nf // 2", "0"))
def stability_top_half(spark, sf_dir):
    return rounded(ranking.top_half(ranked_of(spark, sf_dir), F.floor(F.col("features") / 2), 0.0), "half")


@query(half_sql("2", "-0.1"))
def stability_top_half_methods(spark, sf_dir):
    return rounded(ranking.top_half(ranked_of(spark, sf_dir), F.lit(len(METHODS) // 2), -0.1), "half")


@query(
    f"""WITH {BASE}, c AS (SELECT feature, fold FROM (SELECT DISTINCT feature FROM ranked) CROSS JOIN (SELECT DISTINCT fold FROM ranked)), m AS (SELECT feature, -0.05 - 0.001 * (row_number() OVER (PARTITION BY feature ORDER BY fold) - 1) AS score FROM c ANTI JOIN ranked r USING (feature, fold))
    SELECT feature, array_to_string(list_transform(list(v ORDER BY v DESC), lambda x: printf('%.6f', x)), '|') AS values FROM (SELECT feature, round(score, 6) AS v FROM ranked UNION ALL SELECT feature, CAST(score AS DOUBLE) FROM m) GROUP BY feature"""
)
def boxplot_values_penalty(spark, sf_dir):
    out = ranking.value_lists(ranked_of(spark, sf_dir))
    return out.select("feature", F.array_join(F.transform("values", lambda x: F.format_string("%.6f", x + 0.0)), "|").alias("values"))


@query(
    f"""WITH {BASE}, q AS (SELECT feature, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3 FROM ranked GROUP BY feature)
    SELECT feature, {rnd('any_value(q1)')} AS q1, {rnd('any_value(median)')} AS median, {rnd('any_value(q3)')} AS q3, {rnd('min(score) FILTER (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS low, {rnd('max(score) FILTER (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS high FROM ranked JOIN q USING (feature) GROUP BY feature"""
)
def boxplot_stats(spark, sf_dir):
    return rounded(ranking.box_stats(ranked_of(spark, sf_dir)), "q1", "median", "q3", "low", "high")


@query(f"WITH {OBS3}, p AS (SELECT p, min(p) OVER () AS lo, max(p) OVER () AS hi FROM {kruskal_sql('obs')}) SELECT CAST(least(floor((p - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY 1")
def histogram_pvalues(spark, sf_dir):
    return ranking.histogram(stats.kruskal(emb(spark, sf_dir)), "p")


@query(f"WITH {BASE} SELECT fold, method, least(count(*) FILTER (score > 0), 20) AS n FROM ranked GROUP BY fold, method")
def nonzero_limit(spark, sf_dir):
    return ranking.nonzero_limit(ranked_of(spark, sf_dir), 20)


@query(f"WITH {BASE} SELECT fold, method, feature AS name, pos AS index, {rnd('score')} AS score FROM ranked WHERE pos < 10")
def rank_table_roundtrip(spark, sf_dir):
    """Wide and back: positions and scores by method, unpivoted again."""
    ranked = ranked_of(spark, sf_dir).where("pos < 10")
    names = ranking.names_wide(ranked, METHODS).unpivot(["fold", "pos"], METHODS, "method", "name").where("name is not null")
    scores = ranking.scores_wide(ranked, METHODS).unpivot(["fold", "feature"], METHODS, "method", "score").where("score is not null").withColumnRenamed("feature", "name")
    return rounded(names.join(scores, ["fold", "method", "name"]).select("fold", "method", "name", F.col("pos").alias("index"), "score"), "score")


@query(f"WITH {BASE} SELECT fold, method, pos AS index, feature AS name, printf('%.6f', score) AS score FROM ranked")
def rank_table_sink(spark, sf_dir):
    return ranked_of(spark, sf_dir).select("fold", "method", F.col("pos").alias("index"), F.col("feature").alias("name"), F.format_string("%.6f", "score").alias("score"))


# Signatures


def joined(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.concat_ws("|", c) for c in columns})


@query(f"WITH {BASE}, {CANDIDATES} SELECT fold, method, sig_id, size FROM cand")
def signature_prefixes(spark, sf_dir):
    return signatures.prefixes(ranked_of(spark, sf_dir), 5).drop("genes")


COMB3 = "comb AS (SELECT a.fold, a.method, list_sort([a.feature, b.feature, c.feature]) AS genes FROM ranked a JOIN ranked b ON a.fold = b.fold AND a.method = b.method AND a.pos < b.pos JOIN ranked c ON a.fold = c.fold AND a.method = c.method AND b.pos < c.pos WHERE c.pos < 6)"


@query(f"WITH {BASE}, {COMB3} SELECT fold, 'smallcomb_' || method AS method, array_to_string(genes, '|') AS sig_id, 3 AS size FROM comb")
def signature_combinations(spark, sf_dir):
    return signatures.combinations(ranked_of(spark, sf_dir), 6, 3).drop("genes")


@query(f"WITH {BASE}, {COMB3}, s AS (SELECT fold, 'smallcomb_' || method AS method, array_to_string(genes, '|') AS sig_id FROM comb) SELECT fold, method, sig_id FROM (SELECT *, row_number() OVER (PARTITION BY fold, method ORDER BY md5('0|' || sig_id), sig_id) AS r FROM s) WHERE r <= 7")
def signature_random_combinations(spark, sf_dir):
    return signatures.combinations(ranked_of(spark, sf_dir), 6, 3, 7).drop("genes", "size")


@query(f"WITH {BASE}, {CANDIDATES}, {UNIQUE} SELECT fold, sig_id, size, array_to_string(methods, '|') AS methods, owner FROM uniq")
def signature_dedupe(spark, sf_dir):
    return joined(signatures.catalogue(signatures.prefixes(ranked_of(spark, sf_dir), 5)).drop("genes"), "methods")


@query(f"WITH {BASE}, {CANDIDATES}, {UNIQUE} SELECT u.fold, sig_id, array_to_string(list_sort(list(method)), '|') AS found_in FROM (SELECT fold, sig_id, size, method, count(*) AS c FROM (SELECT fold, sig_id, size, unnest(genes) AS feature FROM uniq) JOIN ranked USING (fold, feature) WHERE pos < 8 GROUP BY ALL) u WHERE c = size GROUP BY u.fold, sig_id")
def signature_containment(spark, sf_dir):
    ranked = ranked_of(spark, sf_dir)
    return joined(signatures.containment(signatures.catalogue(signatures.prefixes(ranked, 5)), ranked, 8), "found_in")


@query(f"WITH {BASE}, {CANDIDATES}, {UNIQUE}, e AS (SELECT *, unnest(['centroid', 'ridge']) AS estimator FROM uniq) SELECT fold, sig_id, estimator FROM e WHERE NOT (size <= 2 AND estimator = 'centroid')")
def signature_unscored_antijoin(spark, sf_dir):
    unique = signatures.catalogue(signatures.prefixes(ranked_of(spark, sf_dir), 5))
    wanted = unique.withColumn("estimator", F.explode(F.array(F.lit("centroid"), F.lit("ridge"))))
    done = unique.where("size <= 2").withColumn("estimator", F.lit("centroid")).select("sig_id", "estimator").distinct()
    return signatures.not_scored(wanted, done).select("fold", "sig_id", "estimator")


ALIKE = "alike AS (SELECT kept, list_sort(list(d)) AS dropped FROM (SELECT 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS kept, 'x' || i || k AS d FROM (SELECT unnest(range(0, 64, 3)) AS i), (SELECT unnest(['a', 'b']) AS k)) GROUP BY kept)"


@query(
    f"""WITH RECURSIVE {BASE}, {CANDIDATES}, {UNIQUE}, {ALIKE}, s AS (SELECT DISTINCT sig_id, genes FROM uniq WHERE size <= 3),
    w AS (SELECT sig_id, genes, []::VARCHAR[] AS done, 0 AS i FROM s UNION ALL SELECT sig_id, genes, list_append(done, g), i + 1 FROM (SELECT w.*, unnest(list_concat([genes[i + 1]], coalesce(dropped, []))) AS g FROM w LEFT JOIN alike ON kept = genes[i + 1] WHERE i < len(genes)))
    SELECT DISTINCT sig_id, array_to_string(list_sort(done), '|') AS new_id FROM w WHERE i = len(genes)"""
)
def signature_corr_expand(spark, sf_dir):
    unique = signatures.catalogue(signatures.prefixes(ranked_of(spark, sf_dir), 5)).where("size <= 3").select("sig_id", "genes").distinct()
    i = F.col("id").cast("string")
    alike = spark.range(0, 64, 3).select(F.concat(F.lit("f"), F.lpad(i, 2, "0")).alias("kept"), F.array_sort(F.array(F.concat(F.lit("x"), i, F.lit("a")), F.concat(F.lit("x"), i, F.lit("b")))).alias("dropped"))
    return signatures.expand_correlates(unique, alike).select("sig_id", "new_id")


@query()
def signature_corr_expand_whole(spark, sf_dir):
    unique = signatures.catalogue(signatures.prefixes(ranked_of(spark, sf_dir), 5)).select("sig_id", "genes").distinct()
    return signatures.expand_correlates(unique, corr_groups(spark, sf_dir)).select("sig_id", "new_id")


# Evaluation

KFOLD = f"sp AS (SELECT sample_id, s.split, f.own = s.split AS is_test FROM (SELECT *, ntile(3) OVER (PARTITION BY label ORDER BY sample_id) - 1 AS own FROM {SAMPLES}) f, (SELECT CAST(unnest(range(3)) AS INTEGER) AS split) s)"
DIST = distance_sql("d0", "sp", "split")
ALL_PRED = "ap AS " + nearest_sql("(SELECT split, sample_id, y, c, sum(d) AS d FROM d0 GROUP BY ALL)", "split")


def splits3(obs: DataFrame) -> DataFrame:
    return resample.fold_splits(resample.samples_of(obs), 3)


def all_predictions(spark, sf_dir) -> DataFrame:
    obs = emb(spark, sf_dir)
    return evaluate.predict_all(evaluate.feature_distances(obs, splits3(obs)))


@query(f"WITH {OBS3}, {KFOLD}, {DIST}, {ALL_PRED} SELECT * FROM ap")
def centroid_predict_euclid(spark, sf_dir):
    return all_predictions(spark, sf_dir)


@query(
    f"WITH {OBS3}, {KFOLD}, {DIST}, cp AS "
    + nearest_sql("(SELECT split, sample_id, y, c, 1 - CASE WHEN s > 0 AND t > 0 THEN v / (s * t) ELSE 0 END AS d FROM (SELECT split, sample_id, t.y, m.c, covar_pop(value, m) AS v, stddev_pop(value) AS s, stddev_pop(m) AS t FROM d0_z t JOIN d0_m m USING (split, feature) WHERE is_test GROUP BY ALL))", "split")
    + " SELECT * FROM cp"
)
def centroid_predict_corr(spark, sf_dir):
    obs = emb(spark, sf_dir)
    return evaluate.predict_correlation(obs, splits3(obs))


@query(f"WITH {OBS3}, {KFOLD}, {DIST}, {ALL_PRED} SELECT split, y_true, y_pred, count(*) AS n FROM ap GROUP BY ALL")
def cv_confusion(spark, sf_dir):
    return evaluate.confusion(all_predictions(spark, sf_dir))


@query(
    f"""WITH {OBS3}, {KFOLD}, {DIST}, {ALL_PRED}, cl AS (SELECT DISTINCT split, y_true AS c FROM ap UNION SELECT DISTINCT split, y_pred FROM ap),
    e AS (SELECT cl.split, cl.c, CAST(count(*) FILTER (y_true = c) AS DOUBLE) AS t, CAST(count(*) FILTER (y_pred = c) AS DOUBLE) AS p, CAST(count(*) FILTER (y_true = c AND y_pred = c) AS DOUBLE) AS h FROM cl JOIN ap USING (split) GROUP BY ALL),
    f AS (SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN t > 0 THEN h / t ELSE 0 END AS rc FROM e),
    g AS (SELECT split, sum(t) AS s, sum(h) AS h, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp, sum(t * pr) / sum(t) AS precision, sum(t * rc) / sum(t) AS recall, sum(t * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END) / sum(t) AS f1, sum(t * CASE WHEN 0.25 * pr + rc > 0 THEN 1.25 * pr * rc / (0.25 * pr + rc) ELSE 0 END) / sum(t) AS fbeta FROM f GROUP BY split)
    SELECT split, {rnd('h / s')} AS accuracy, {rnd('precision')} AS precision, {rnd('recall')} AS recall, {rnd('f1')} AS f1, {rnd('fbeta')} AS fbeta, {rnd('(h / s - tp / (s * s)) / (1 - tp / (s * s))')} AS kappa, {rnd('(h * s - tp) / sqrt((s * s - pp) * (s * s - tt))')} AS mcc FROM g"""
)
def cv_metrics(spark, sf_dir):
    return rounded(evaluate.metrics(evaluate.confusion(all_predictions(spark, sf_dir))), "accuracy", "precision", "recall", "f1", "fbeta", "kappa", "mcc")


@query(f"WITH {OBS3}, {KFOLD}, {DIST}, fp AS " + nearest_sql("d0", "split, feature") + f" SELECT feature, {rnd('avg(s)')} AS score FROM (SELECT split, feature, avg(CAST(y_true = y_pred AS INTEGER)) AS s FROM fp GROUP BY ALL) GROUP BY feature")
def single_feature_cv(spark, sf_dir):
    obs = emb(spark, sf_dir)
    return rounded(evaluate.single_features(evaluate.feature_distances(obs, splits3(obs))), "score")


OBS8 = OBS3.replace("range(64)", "range(8)")


@query(
    f"""WITH {OBS8}, {KFOLD}, {DIST}, {ALL_PRED}, tests AS (SELECT split, rep, sample_id, y, feature, value FROM d0_z, (SELECT unnest(range(2)) AS rep) WHERE is_test),
    moved AS (SELECT a.split, a.rep, a.feature, a.sample_id, a.y, b.value AS permuted FROM (SELECT *, row_number() OVER (PARTITION BY split, feature, rep ORDER BY sample_id) AS n FROM tests) a JOIN (SELECT *, row_number() OVER (PARTITION BY split, feature, rep ORDER BY md5('0|' || split || '|' || feature || '|' || rep || '|' || sample_id), sample_id) AS n FROM tests) b USING (split, feature, rep, n)),
    tot AS (SELECT split, sample_id, c, sum(d) AS a FROM d0 GROUP BY ALL), ch AS (SELECT v.split, v.rep, v.feature, v.sample_id, v.y, m.c, a - d + pow(permuted - m, 2) AS d FROM moved v JOIN d0_m m ON v.split = m.split AND v.feature = m.feature JOIN d0 ON d0.split = v.split AND d0.sample_id = v.sample_id AND d0.feature = v.feature AND d0.c = m.c JOIN tot ON tot.split = v.split AND tot.sample_id = v.sample_id AND tot.c = m.c),
    sh AS {nearest_sql('ch', 'split, rep, feature')}
    SELECT feature, {rnd('(SELECT avg(s) FROM (SELECT split, avg(CAST(y_true = y_pred AS INTEGER)) AS s FROM ap GROUP BY split)) - avg(s)')} AS score FROM (SELECT split, rep, feature, avg(CAST(y_true = y_pred AS INTEGER)) AS s FROM sh GROUP BY ALL) GROUP BY feature"""
)
def decrease_accuracy_perm(spark, sf_dir):
    obs = emb(spark, sf_dir).where("feature_pos < 8")
    return rounded(evaluate.mean_decrease(obs, splits3(obs), 2), "score")


LOO = f"sp AS (SELECT a.sample_id, b.sample_id AS split, a.sample_id = b.sample_id AS is_test FROM {SAMPLES} a, {SAMPLES} b)"


@query(f"WITH {OBS8.replace('FROM embeddings,', 'FROM (SELECT * FROM embeddings WHERE vec_id < 60),')}, {LOO}, {DIST}, {ALL_PRED} SELECT sample_id, y_true, y_pred FROM ap")
def leave_one_out_centroid(spark, sf_dir):
    obs = emb(spark, sf_dir).where("feature_pos < 8 and sample_id < 60")
    return evaluate.leave_one_out(obs)


@query()
def leave_one_out_centroid_whole(spark, sf_dir):
    return evaluate.leave_one_out(emb(spark, sf_dir))


@query(f"WITH {BASE}, {CANDIDATES}, {UNIQUE} SELECT DISTINCT sig_id, estimator, split FROM uniq, (SELECT unnest(['centroid', 'lda']) AS estimator), (SELECT CAST(unnest(range(3)) AS INTEGER) AS split)")
def work_items(spark, sf_dir):
    unique = signatures.catalogue(signatures.prefixes(ranked_of(spark, sf_dir), 5)).select("sig_id").distinct()
    return evaluate.work_items(unique, ["centroid", "lda"], 3)


# The search


def searched(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return plan.search(emb(spark, sf_dir), SEARCH, RANKS)


SCORE_COLUMNS = ("mean_freq", "mean_p")


@query(f"WITH {SEARCHED} SELECT fold, sig_id, cv_mean, cv_std FROM scored")
def signature_cv(spark, sf_dir):
    return searched(spark, sf_dir)[1].select("fold", "sig_id", "cv_mean", "cv_std")


@query(f"WITH {SEARCHED} SELECT fold, sig_id, {rnd('mean_freq')} AS mean_freq, {rnd('mean_p')} AS mean_p, adjusted FROM scored")
def adjusted_score(spark, sf_dir):
    return rounded(searched(spark, sf_dir)[1].select("fold", "sig_id", "mean_freq", "mean_p", "adjusted"), "mean_freq", "mean_p")


@query(f"WITH {SEARCHED}, {cascade_sql('scored', 'near', [('cv_mean', 'max', 0.10, 3, '>')])} SELECT fold, sig_id, cv_mean FROM near")
def near_best_filter(spark, sf_dir):
    return signatures.near_best(searched(spark, sf_dir)[1]).select("fold", "sig_id", "cv_mean")


@query(f"WITH {SEARCHED}, {cascade_sql('scored', 'better', [('adjusted', 'max', 0.05, 3, '>'), ('cv_mean', 'max', 0.05, 3, '>')])} SELECT fold, sig_id, adjusted, cv_mean FROM better")
def better_cascade(spark, sf_dir):
    return signatures.even_better(searched(spark, sf_dir)[1]).select("fold", "sig_id", "adjusted", "cv_mean")


@query(f"WITH {SEARCHED}, {BEST} SELECT fold, sig_id, cv_mean, cv_std FROM best")
def best_cascade(spark, sf_dir):
    return signatures.best(searched(spark, sf_dir)[1]).select("fold", "sig_id", "cv_mean", "cv_std")


FREQ = "sf AS (SELECT fold, feature, count(*) AS n, count(*) / CAST(any_value(t) AS DOUBLE) AS freq FROM (SELECT fold, sig_id, unnest(genes) AS feature FROM near) JOIN (SELECT fold, count(*) AS t FROM near GROUP BY fold) USING (fold) GROUP BY ALL)".replace("GROUP BY ALL)", "GROUP BY fold, feature)")
NEAR = cascade_sql("scored", "near", [("cv_mean", "max", 0.10, 3, ">")])


@query(f"WITH {SEARCHED}, {NEAR}, {FREQ} SELECT fold, feature, n, {rnd('freq')} AS freq FROM sf")
def feature_freq_in_signatures(spark, sf_dir):
    return rounded(signatures.feature_frequency(signatures.near_best(searched(spark, sf_dir)[1])), "freq")


@query(f"WITH {SEARCHED}, {NEAR}, {FREQ} SELECT feature, {rnd('sum(freq) / 4')} AS mean_freq FROM sf GROUP BY feature")
def mean_freq_over_folds(spark, sf_dir):
    freq = signatures.feature_frequency(signatures.near_best(searched(spark, sf_dir)[1]))
    return rounded(signatures.mean_frequency(freq, len(FOLDS)), "mean_freq")


@query(f"WITH {SEARCHED}, m AS (SELECT method, " + ", ".join(f"max(CASE WHEN fold = {k} THEN cv_mean END) AS fold_{k}" for k in FOLDS) + f" FROM cand JOIN scored USING (fold, sig_id) GROUP BY method) SELECT *, {rnd('(fold_0 + fold_1 + fold_2 + fold_3) / 4')} AS mean FROM m")
def max_score_per_rank(spark, sf_dir):
    found, scored = searched(spark, sf_dir)
    return rounded(signatures.max_per_rank(found, scored, FOLDS), "mean")


GLOBAL = f"""SELECT sig_id, array_to_string(list_sort(list(DISTINCT CAST(fold AS VARCHAR))), '|') AS folds, count(*) AS n, {rnd('avg(mean_freq)')} AS mean_freq, {rnd('avg(cv_mean)')} AS cv_mean, {rnd('stddev_pop(cv_mean)')} AS cv_mean_std,
{rnd('avg(cv_std)')} AS cv_std, {rnd('avg(adjusted)')} AS adjusted, {rnd('stddev_pop(adjusted)')} AS adjusted_std, array_to_string(list_sort(list_distinct(flatten(list(methods)))), '|') AS methods FROM {{src}} GROUP BY sig_id"""
GLOBAL_COLUMNS = ("mean_freq", "cv_mean", "cv_mean_std", "cv_std", "adjusted", "adjusted_std")


@query(f"WITH {SEARCHED}, {NEAR} " + GLOBAL.format(src="near"))
def global_good_signatures(spark, sf_dir):
    return rounded(joined(signatures.global_table(signatures.near_best(searched(spark, sf_dir)[1])), "folds", "methods"), *GLOBAL_COLUMNS)


@query(f"WITH {SEARCHED}, {BEST} " + GLOBAL.format(src="best"))
def global_best_signatures(spark, sf_dir):
    return rounded(joined(signatures.global_table(signatures.best(searched(spark, sf_dir)[1])), "folds", "methods"), *GLOBAL_COLUMNS)


@query(f"WITH {SEARCHED}, {NEAR}, has AS (SELECT DISTINCT sig_id, unnest(genes) AS feature FROM near), n AS (SELECT feature, count(*) AS n FROM has GROUP BY feature) SELECT n.feature, s.sig_id, CAST(h.sig_id IS NOT NULL AS INTEGER) AS present, n.n FROM n CROSS JOIN (SELECT DISTINCT sig_id FROM near) s LEFT JOIN has h ON h.sig_id = s.sig_id AND h.feature = n.feature")
def signature_incidence(spark, sf_dir):
    return signatures.incidence(signatures.near_best(searched(spark, sf_dir)[1]))


OUTER_SPLITS = "osp AS (SELECT sample_id, fold, is_outer AS is_test FROM outer_folds)"
DCV = (
    f"{OUTER_SPLITS}, " + distance_sql("od", "osp", "fold") + ", op AS "
    + nearest_sql("(SELECT fold, sig_id, sample_id, y, c, sum(d) AS d FROM od JOIN (SELECT fold, sig_id, unnest(genes) AS feature FROM best) USING (fold, feature) GROUP BY ALL)", "fold, sig_id")
    + ", os AS (SELECT fold, sig_id, avg(CAST(y_true = y_pred AS INTEGER)) AS score FROM op GROUP BY ALL), oe AS (SELECT fold, avg(score) AS mean, stddev_pop(score) AS std, count(*) AS n FROM os GROUP BY fold)"
)


@query(f"WITH {SEARCHED}, {BEST}, {DCV} SELECT CAST(fold AS VARCHAR) AS fold, {rnd('mean')} AS mean, {rnd('std')} AS std, n FROM oe UNION ALL SELECT 'all', {rnd('avg(mean)')}, {rnd('stddev_pop(mean)')}, CAST(sum(n) AS BIGINT) FROM oe")
def double_cross_validation(spark, sf_dir):
    """The flagship: rank, propose, score inside, select, and test outside, for all folds in one plan."""
    return rounded(plan.double_cross_validation(emb(spark, sf_dir), SEARCH, RANKS), "mean", "std")


# Look-ups and files


@query("WITH keys AS (SELECT DISTINCT l_partkey + 1000000 * (l_linenumber % 2) AS key FROM lineitem WHERE l_quantity > 45) SELECT key, p_name, p_type FROM keys LEFT JOIN part ON p_partkey = key")
def annotation_lookup(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 45").select((F.col("l_partkey") + 1000000 * (F.col("l_linenumber") % 2)).alias("key")).distinct()
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), "p_name", "p_type")
    return keys.join(part, "key", "left")


@query("SELECT o_orderkey AS row_id, unnest(string_split(s, ',')) AS feature FROM (SELECT l_orderkey AS o_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)")
def signature_file_scan(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    baskets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("l_orderkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("p_brand"))).alias("s"))
    return baskets.select(F.col("l_orderkey").alias("row_id"), F.explode(F.split("s", ",")).alias("feature"))


@query(
    f"""WITH {OBS3}, t AS (SELECT feature FROM {bh_sql(kruskal_sql('obs'))} WHERE p < 0.3), r AS (SELECT feature, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM obs GROUP BY feature),
    s AS (SELECT feature, (value - b) / CASE WHEN c = a THEN 1 ELSE c - a END AS v FROM obs JOIN r USING (feature) WHERE feature IN (SELECT feature FROM t)) SELECT feature, count(*) FILTER (v >= 0.5) AS n_up, count(*) FILTER (v <= -0.5) AS n_down FROM s GROUP BY feature"""
)
def tree_filter(spark, sf_dir):
    obs = emb(spark, sf_dir)
    good = stats.passing(stats.benjamini_hochberg(stats.kruskal(obs)), 0.3, "p").select("feature")
    masked = scaling.bands(scaling.robust(obs.join(good, "feature", "left_semi")))
    return masked.groupBy("feature").agg(F.count("up").alias("n_up"), F.count("down").alias("n_down"))


# Fitted models: results depend on the optimiser, so these have no twin


@query()
def mlr_weights_rank(spark, sf_dir):
    return models.weight_rank(emb(spark, sf_dir), "ridge").unionByName(models.weight_rank(emb(spark, sf_dir), "lasso"))


@query()
def tree_importance_rank(spark, sf_dir):
    return models.weight_rank(emb(spark, sf_dir), "forest")


@query()
def svm_weights_rank(spark, sf_dir):
    return models.weight_rank(emb(spark, sf_dir), "svm")


@query()
def rfe_rank(spark, sf_dir):
    return models.elimination_rank(emb(spark, sf_dir))


@query()
def rfa_rank(spark, sf_dir):
    return models.addition_rank(emb(spark, sf_dir))


@query()
def rfa_cv(spark, sf_dir):
    return models.addition_cv(emb(spark, sf_dir))


@query()
def stability_selection(spark, sf_dir):
    return models.stability_selection(emb(spark, sf_dir))


@query()
def lda_rank(spark, sf_dir):
    return models.lda_rank(emb(spark, sf_dir))


@query()
def bagging_vote(spark, sf_dir):
    obs = emb(spark, sf_dir)
    return models.bagged_centroids(obs, splits3(obs))


@query()
def soft_vote(spark, sf_dir):
    return models.soft_vote(emb(spark, sf_dir))


@query()
def rbf_classifier(spark, sf_dir):
    obs = emb(spark, sf_dir)
    split = obs.join(resample.stratified_folds(resample.samples_of(obs), 4).select("sample_id", "fold"), "sample_id")
    each = [models.kernel_classifier(split.where(F.col("fold") != k).drop("fold"), split.where(F.col("fold") == k).drop("fold")) for k in range(4)]
    return reduce(DataFrame.union, each)


@query()
def ridge_grid_search(spark, sf_dir):
    return models.grid_search(emb(spark, sf_dir))


@query()
def knn_mutual_info(spark, sf_dir):
    return models.neighbour_information(emb(spark, sf_dir))


@query()
def nj_trees(spark, sf_dir):
    return trees.feature_trees(emb(spark, sf_dir))
