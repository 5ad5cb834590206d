"""Command line: ``python -m sigstab rank`` and ``python -m sigstab search`` over a matrix file or a tree of folds."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import ranking, signatures, stats
from .plans import search as plan
from .sources import matrix


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="sigstab", description=__doc__)
    ap.add_argument("stage", choices=("rank", "search"))
    ap.add_argument("--train", required=True, help="matrix file: features in rows")
    ap.add_argument("--out", required=True, help="folder for the result tables")
    ap.add_argument("--no-filter", action="store_true", help="rank all features")
    ap.add_argument("--only-stats", action="store_true", help="stop after the tests")
    ap.add_argument("--p-value", type=float, default=0.05)
    ap.add_argument("--fdr", action="store_true", help="filter by adjusted p-values")
    ap.add_argument("--fdr-p-value", type=float, default=0.05)
    ap.add_argument("--min-fdr", type=int, default=4, help="features that must pass, else --p-value filters")
    ap.add_argument("--test", choices=sorted(plan.TESTS), default="kruskal")
    ap.add_argument("--outer-k", type=int, default=4)
    ap.add_argument("--inner-k", type=int, default=3)
    ap.add_argument("--correlation", action="store_true", help="leave out features that correlate with earlier ones")
    ap.add_argument("--corr-threshold", type=float, default=0.9)
    ap.add_argument("--fitted", action="store_true", help="add the rankings of fitted estimators")
    ap.add_argument("--subsamples", type=int, default=8)
    ap.add_argument("--trees", type=int, default=plan.RankConfig.trees)
    ap.add_argument("--max-n-features", type=int, default=20)
    ap.add_argument("--max-size-all-combinations", type=int, default=1)
    ap.add_argument("--max-size-random-combinations", type=int, default=1)
    ap.add_argument("--n-splits-searching", type=int, default=3)
    ap.add_argument("--n-splits-candidates", type=int, default=5)
    ap.add_argument("--n-splits-final", type=int, default=8)
    ap.add_argument("--bags", type=int, default=16)
    ap.add_argument("--smote", action="store_true", help="score with balanced training rows too")
    return ap


def configs(args: argparse.Namespace) -> tuple[plan.RankConfig, plan.SignatureConfig]:
    ranks = plan.RankConfig(
        outer_folds=args.outer_k, p_value=None if args.no_filter else args.p_value, fdr=args.fdr_p_value if args.fdr and not args.no_filter else None, least_features=args.min_fdr,
        correlation_cut=args.corr_threshold if args.correlation else None, test=args.test, fitted=args.fitted, inner_parts=args.inner_k, subsamples=args.subsamples, trees=args.trees,
    )
    large = args.max_size_all_combinations
    found = plan.SignatureConfig(
        most_features=args.max_n_features, inner_splits=args.n_splits_searching, candidate_splits=args.n_splits_candidates, final_splits=args.n_splits_final, bags=args.bags,
        combinations=tuple(range(2, large + 1)), sampled=tuple(range(max(1, large) + 1, args.max_size_random_combinations + 1)),
    )
    return ranks, found


def _joined(df: DataFrame) -> DataFrame:
    """Arrays as text, for files."""
    return df.select(*[F.concat_ws("|", c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sigstab").getOrCreate()
    obs = plan.stored(matrix.with_positions(matrix.read_csv(spark, args.train)))
    ranks, found = configs(args)
    save = lambda df, name, *order: matrix.write_table(_joined(df), f"{args.out}/{name}", order)
    train = obs.join(plan.folds(obs, ranks.outer_folds), "sample_id").where("not outer")
    save(stats.benjamini_hochberg(plan.TESTS[ranks.test](train, ("fold",)), ("fold",)), "tests", "fold", "p")
    if args.only_stats:
        return
    ranked = plan.rank(obs, ranks)
    save(ranked, "ranks", "fold", "method", "pos")
    means = ranking.mean_std(ranked)
    save(ranking.lower_confidence(means), "stability", "method", "feature")
    counts = ranking.top_counts(ranked)
    methods = ranked.select("method").distinct().count()
    save(ranking.stable(counts, methods, ranks.outer_folds), "stable_features", "feature")
    if args.stage == "rank":
        return
    _, scored = plan.search(obs, found, ranks, ranked)
    save(scored, "signatures", "fold", "sig_id")
    chosen = plan.stored(signatures.best(plan.candidates(obs, scored, found, ranks)))
    save(chosen, "best_signatures", "fold", "sig_id")
    save(plan.model_scores(obs, chosen, found, ranks), "estimators", "fold", "sig_id", "estimator")
    save(plan.final_evaluation(obs, chosen, found, ranks), "final_evaluation", "fold", "sig_id", "estimator", "part")
    save(signatures.double_cv(plan.outer_scores(obs, chosen, ranks)), "double_cross_validation", "fold")
    if args.smote:
        save(plan.double_cross_validation_oversampled(obs, chosen, ranks), "double_cross_validation_oversampled", "fold")


if __name__ == "__main__":
    main()
