"""Queries of the library's operators over the test tables, and their DuckDB twins, by name.

Spark and DuckDB sides are written apart: a query composes operators, its twin composes common table expressions.
Results are rounded at the end; random choices are md5 orders, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.columns import clean
from .operators import evaluate, ranking, resample, scaling, signatures, stats
from .plans import search as plan
from .sources import matrix

QUERIES: dict = {}
ORACLE_SQL: dict = {}

METHODS = ["t1_anova", "t1_chi2", "t1_kruskal", "t1_mutual_information", "t3_centroid"]
FOLDS = [0, 1, 2, 3]
RANKS, SEARCH = plan.RankConfig(), plan.SignatureConfig()


def query(sql: str | None = None):
    """Register a query under its function's name, with its twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: clean(F.col(c), digits) for c in columns})


# Common table expressions of the twins


def obs_sql(classes: int) -> str:
    return f"""obs AS (SELECT vec_id AS sample_id, 'c' || (label % {classes}) AS label, CAST(label % {classes} AS INTEGER) AS y,
    'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, CAST(i AS INTEGER) AS feature_pos, CAST(embedding[i + 1] AS DOUBLE) AS value
    FROM embeddings, (SELECT unnest(range(64)) AS i))"""


LI = "li AS (SELECT label, feature, value FROM (SELECT l_returnflag AS label, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR feature IN (l_quantity, l_extendedprice, l_discount, l_tax)))"
DOC2 = "doc2 AS (SELECT doc_id AS sample_id, CAST(quality AS VARCHAR) AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def ranks_sql(src: str, by: str = "") -> str:
    """by, feature, s0.., n0.., n, tied."""
    k = f"{by}feature"
    return f"""(SELECT {k}, sum(CASE WHEN y = 0 THEN r ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS s1, sum(CASE WHEN y = 2 THEN r ELSE 0 END) AS s2,
    CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 2) AS DOUBLE) AS n2, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1) AS tied
    FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY value) + (t - 1) / 2 AS r FROM (SELECT *, CAST(count(*) OVER (PARTITION BY {k}, value) AS DOUBLE) AS t FROM {src})) GROUP BY {k})"""


def kruskal_sql(src: str, by: str = "") -> str:
    return f"""(SELECT *, exp(-h / 2) AS p FROM (SELECT {by}feature, CASE WHEN n0 > 0 AND n1 > 0 AND n2 > 0 AND 1 - tied / (n * n * n - n) > 0 THEN
    (12 / (n * (n + 1)) * (s0 * s0 / n0 + s1 * s1 / n1 + s2 * s2 / n2) - 3 * (n + 1)) / (1 - tied / (n * n * n - n)) END AS h FROM {ranks_sql(src, by)}))"""


def bh_sql(src: str, by: str = "", name: str = "feature") -> str:
    part = f"PARTITION BY {by[:-2]}" if by else ""
    return f"""(SELECT *, min(least(1, p * m / rn)) OVER ({part} ORDER BY p, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q
    FROM (SELECT *, count(p) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY p, {name}) AS rn FROM {src}))"""


def normal_sql(z: str) -> str:
    from .functions.columns import ERFC

    t = f"(1 / (1 + 0.5 * abs({z}) / sqrt(2)))"
    poly = f"({ERFC[-1]!r})"
    for c in reversed(ERFC[:-1]):
        poly = f"({c!r} + {t} * {poly})"
    return f"(CAST({t} AS DOUBLE) * exp(-{z} * {z} / 2 + {poly}))"


def moments_sql(src: str, by: str = "") -> str:
    return f"(SELECT {by}feature, y, CAST(count(*) AS DOUBLE) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM {src} GROUP BY {by}feature, y)"


def anova_sql(src: str, by: str = "") -> str:
    return f"""(SELECT {by}feature, CASE WHEN sum((n - 1) * v) > 0 THEN (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) END AS score
    FROM (SELECT *, sum(n * m) OVER (PARTITION BY {by}feature) / sum(n) OVER (PARTITION BY {by}feature) AS g FROM {moments_sql(src, by)}) GROUP BY {by}feature)"""


def chi2_sql(src: str, by: str = "", shift: bool = False) -> str:
    value = f"value - min(value) OVER (PARTITION BY {by}feature)" if shift else "value"
    return f"""(SELECT {by}feature, sum(CASE WHEN e > 0 THEN pow(o - e, 2) / e END) AS score FROM (SELECT *, n / sum(n) OVER (PARTITION BY {by}feature) * sum(o) OVER (PARTITION BY {by}feature) AS e
    FROM (SELECT {by}feature, y, sum(v) AS o, CAST(count(*) AS DOUBLE) AS n FROM (SELECT *, {value} AS v FROM {src}) GROUP BY {by}feature, y)) GROUP BY {by}feature)"""


def mutual_sql(src: str, by: str = "", bins: int = 8) -> str:
    k = f"{by}feature"
    return f"""(SELECT {k}, sum(c / t * ln(c * t / (cb * cy))) AS score FROM (SELECT *, sum(c) OVER (PARTITION BY {k}) AS t, sum(c) OVER (PARTITION BY {k}, bin) AS cb, sum(c) OVER (PARTITION BY {k}, y) AS cy
    FROM (SELECT {k}, bin, y, CAST(count(*) AS DOUBLE) AS c FROM (SELECT *, ntile({bins}) OVER (PARTITION BY {k} ORDER BY value, sample_id) AS bin FROM {src}) GROUP BY {k}, bin, y)) GROUP BY {k})"""


def zscore_sql(src: str, by: str = "") -> str:
    w = f"OVER (PARTITION BY {by}feature)"
    return f"(SELECT * REPLACE ((value - avg(value) {w}) / CASE WHEN stddev_pop(value) {w} = 0 THEN 1 ELSE stddev_pop(value) {w} END AS value) FROM {src})"


def spread_sql(src: str, by: str = "") -> str:
    return f"(SELECT {by}feature, sum(abs(m)) AS score FROM (SELECT {by}feature, y, avg(value) AS m FROM {zscore_sql(src, by)} GROUP BY {by}feature, y) GROUP BY {by}feature)"


SAMPLES = "(SELECT DISTINCT sample_id, label FROM obs)"
OUTER = f"outer_folds AS (SELECT sample_id, label, s.fold, f.own = s.fold AS is_outer FROM (SELECT *, ntile(4) OVER (PARTITION BY label ORDER BY sample_id) - 1 AS own FROM {SAMPLES}) f, (SELECT CAST(unnest(range(4)) AS INTEGER) AS fold) s)"
TRAIN0 = "train0 AS (SELECT o.*, f.fold FROM obs o JOIN outer_folds f USING (sample_id) WHERE NOT is_outer)"
TRAIN = f"kr AS {kruskal_sql('train0', 'fold, ')}, train AS (SELECT t.* FROM train0 t JOIN kr USING (fold, feature) WHERE p < 0.5)"
SCORES = (
    "raw AS (SELECT fold, 't1_anova' AS method, feature, score FROM " + anova_sql("train", "fold, ") + " UNION ALL SELECT fold, 't1_chi2', feature, score FROM " + chi2_sql("train", "fold, ", True)
    + " UNION ALL SELECT fold, 't1_kruskal', feature, h FROM " + kruskal_sql("train", "fold, ") + " UNION ALL SELECT fold, 't1_mutual_information', feature, score FROM " + mutual_sql("train", "fold, ")
    + " UNION ALL SELECT fold, 't3_centroid', feature, score FROM " + spread_sql("train", "fold, ") + ")"
)
RANKED = """ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold, method ORDER BY round(score, 8) DESC, feature) - 1 AS INTEGER) AS pos FROM
    (SELECT fold, method, feature, CASE WHEN hi = lo THEN score ELSE (score - lo) / (hi - lo) END AS score
     FROM (SELECT *, min(score) OVER (PARTITION BY fold, method) AS lo, max(score) OVER (PARTITION BY fold, method) AS hi FROM raw)))"""
BASE = ", ".join([obs_sql(3), OUTER, TRAIN0, TRAIN, SCORES, RANKED])
CANDIDATES = """cand AS (SELECT *, array_to_string(genes, '|') AS sig_id, CAST(len(genes) AS INTEGER) AS size FROM (SELECT fold, method, list_sort(list(feature) OVER (PARTITION BY fold, method ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS genes FROM ranked WHERE pos < 5))"""
UNIQUE = "uniq AS (SELECT fold, sig_id, any_value(genes) AS genes, any_value(size) AS size, list_sort(list(DISTINCT method)) AS methods, min(method) AS owner FROM cand GROUP BY fold, sig_id)"
INNER = """inner_splits AS (SELECT i.fold, i.sample_id, s.split, i.own = s.split AS is_test FROM
    (SELECT fold, sample_id, ntile(3) OVER (PARTITION BY fold, label ORDER BY sample_id) - 1 AS own FROM outer_folds WHERE NOT is_outer) i, (SELECT CAST(unnest(range(3)) AS INTEGER) AS split) s)"""


def distance_sql(name: str, splits: str, keys: str) -> str:
    """CTEs: name_z, name_m and name (keys, sample_id, y, feature, c, d)."""
    w = f"OVER (PARTITION BY {keys}, feature)"
    value = "CASE WHEN NOT is_test THEN value END"
    return f"""{name}_z AS (SELECT {keys}, sample_id, y, feature, is_test, (value - avg({value}) {w}) / CASE WHEN stddev_pop({value}) {w} = 0 THEN 1 ELSE stddev_pop({value}) {w} END AS value FROM obs JOIN {splits} USING (sample_id)),
    {name}_m AS (SELECT {keys}, feature, y AS c, avg(value) AS m FROM {name}_z WHERE NOT is_test GROUP BY {keys}, feature, y),
    {name} AS (SELECT {keys}, sample_id, t.y, feature, c, pow(value - m, 2) AS d FROM {name}_z t JOIN {name}_m USING ({keys}, feature) WHERE is_test)"""


def nearest_sql(src: str, keys: str) -> str:
    return f"(SELECT {keys}, sample_id, y AS y_true, c AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, sample_id, y ORDER BY round(d, 9), c) AS rn FROM {src}) WHERE rn = 1)"


SCORED = (
    distance_sql("dist", "inner_splits", "fold, split")
    + ", preds AS "
    + nearest_sql("(SELECT fold, split, sig_id, sample_id, y, c, sum(d) AS d FROM dist JOIN (SELECT fold, sig_id, unnest(genes) AS feature FROM uniq) USING (fold, feature) GROUP BY ALL)", "fold, split, sig_id")
    + """, cvs AS (SELECT fold, sig_id, round_even(avg(s), 3) AS cv_mean, round_even(stddev_pop(s), 3) AS cv_std FROM (SELECT fold, sig_id, split, avg(CAST(y_true = y_pred AS INTEGER)) AS s FROM preds GROUP BY ALL) GROUP BY ALL),
    freq AS (SELECT fold, feature, n / CAST(m AS DOUBLE) AS freq FROM (SELECT fold, feature, count(*) FILTER (pos < 10) AS n FROM ranked GROUP BY ALL) JOIN (SELECT fold, count(DISTINCT method) AS m FROM ranked GROUP BY ALL) USING (fold)),
    means AS (SELECT g.fold, sig_id, avg(coalesce(freq, 0)) AS mean_freq, avg(p) AS mean_p FROM (SELECT fold, sig_id, unnest(genes) AS feature FROM uniq) g LEFT JOIN freq USING (fold, feature) LEFT JOIN kr USING (fold, feature) GROUP BY ALL),
    scored AS (SELECT *, round_even((mean_freq / 10 + 0.9) * (cv_mean - 2 * cv_std), 3) AS adjusted FROM uniq JOIN cvs USING (fold, sig_id) JOIN means USING (fold, sig_id))"""
)
SEARCHED = ", ".join([BASE, CANDIDATES, UNIQUE, INNER, SCORED])


def cascade_sql(src: str, out: str, steps: list[tuple], gate: int = 0) -> str:
    """CTEs of chained filters, each against the best of what is left; the last is ``out``."""
    parts = []
    for i, (column, agg, tolerance, digits, sign) in enumerate(steps):
        unit = 10 ** max(digits, 3)
        x = f"CAST(round(round_even({column}, {digits}) * {unit}) AS BIGINT)"
        name = out if i == len(steps) - 1 else f"{out}_{i}"
        edge = f"{agg}(x) OVER (PARTITION BY fold) + {round((-tolerance if agg == 'max' else tolerance) * unit)}"
        parts.append(f"{name} AS (SELECT * EXCLUDE (x, edge, nn) FROM (SELECT *, {edge} AS edge, count(*) OVER (PARTITION BY fold) AS nn FROM (SELECT *, {x} AS x FROM {src})) WHERE x {sign} edge OR nn <= {gate})")
        src = name
    return ", ".join(parts)


FIRST_STEPS = [("cv_std", "min", 0.025, 3, "<"), ("cv_mean", "max", 0.025, 3, ">")]
BEST = cascade_sql("scored", "first_best", FIRST_STEPS) + ", " + cascade_sql("first_best", "best", signatures.BEST_STEPS, 10)

from . import queries as _queries  # noqa: E402, F401
from . import final_queries as _final_queries  # noqa: E402, F401
