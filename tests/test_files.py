"""Files of matrices, ranks, groups, signatures and annotations, written and read again."""

import random

import pytest

from sigstab.operators import ranking, stats
from sigstab.sources import matrix

HEAD = "﻿,s1, s2,s3\nprotein,B,A ,B\n"


def cells(df):
    return {(r["feature"], r["sample_id"]): r["value"] for r in df.collect()}


def test_matrix_with_blank_cells(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEAD + "f1,1.5,,3\nf2, 2,x,0\nf3,7\n\n")
    got = matrix.read_csv(spark, str(tmp_path / "m.csv"))
    assert cells(got) == {("f1", "s1"): 1.5, ("f1", "s2"): None, ("f1", "s3"): 3.0, ("f2", "s1"): 2.0, ("f2", "s2"): None, ("f2", "s3"): 0.0, ("f3", "s1"): 7.0}
    assert {(r["sample_id"], r["label"], r["y"]) for r in got.collect()} == {("s1", "B", 1), ("s2", "A", 0), ("s3", "B", 1)}


def test_matrix_without_head_raises(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",a,b\n")
    with pytest.raises(ValueError, match="lacks"):
        matrix.read_csv(spark, str(tmp_path / "m.csv"))


def test_matrix_in_many_splits_with_many_samples(spark, tmp_path):
    rng = random.Random(5)
    names = [f"s{k:04d}" for k in range(2000)]
    want = {(f"f{j}", n): float(rng.randrange(1000)) for j in range(40) for n in names}
    lines = [",".join(["", *names]), ",".join(["p", *(f"c{k % 3}" for k in range(2000))])]
    lines += [",".join([f"f{j}", *(str(want[f"f{j}", n]) for n in names)]) for j in range(40)]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = matrix.read_csv(spark, str(tmp_path / "m.csv"))
        assert got.rdd.getNumPartitions() > 4
        assert cells(got) == want
        assert {r["y"] for r in got.where("label = 'c2'").select("y").distinct().collect()} == {2}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_matrix_round_trip(spark, small, tmp_path):
    obs = matrix.embeddings(spark, small, 3).where("sample_id < 30")
    matrix.write_csv(obs, str(tmp_path / "m"))
    back = matrix.read_csv(spark, str(tmp_path / "m"))
    assert cells(back) == {(f, str(s)): v for (f, s), v in cells(obs).items()}
    assert {(r["sample_id"], r["y"]) for r in back.collect()} == {(str(r["sample_id"]), r["y"]) for r in obs.collect()}


def test_rank_and_p_value_files(spark, tmp_path):
    ranks = spark.createDataFrame([(0, "a", 0.25), (1, "b", 1.0), (2, "c", 0.125)], "index int, name string, score double")
    matrix.write_rank(ranks, str(tmp_path / "r"))
    assert [tuple(r) for r in matrix.read_rank(spark, str(tmp_path / "r")).collect()] == [(1, "b", 1.0), (0, "a", 0.25), (2, "c", 0.125)]


def test_tables_by_method(spark, tmp_path):
    scores = spark.createDataFrame([(0, "m1", "a", 1.0), (0, "m1", "b", 0.5), (0, "m2", "a", 0.25)], "fold int, method string, feature string, score double")
    ranked = ranking.positions(scores)
    matrix.write_table(ranking.scores_wide(ranked, ["m1", "m2"]).drop("fold"), str(tmp_path / "s"), ("feature",))
    got = {tuple(r) for r in matrix.read_scores(spark, str(tmp_path / "s")).select("feature", "method", "score").collect()}
    assert got == {("a", "m1", 1.0), ("b", "m1", 0.5), ("a", "m2", 0.25)}
    matrix.write_table(ranking.scores_wide(ranked, ["m1", "m2"], "pos").drop("fold"), str(tmp_path / "p"), ("feature",))
    assert (spark.read.csv(str(tmp_path / "p"), header=True).columns) == ["feature", "m1", "m2"]
    matrix.write_table(ranking.names_wide(ranked, ["m1", "m2"]).drop("fold"), str(tmp_path / "n"), ("pos",))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "n"), header=True).collect()] == [("0", "a", "a"), ("1", "b", None)]


def test_correlation_groups_round_trip(spark, tmp_path):
    rows = [("a", ["x", "y"]), ("b", ["z"]), ("c", [f"d{k}" for k in range(1500)])]
    matrix.write_ragged(spark.createDataFrame(rows, "kept string, dropped array<string>"), str(tmp_path / "g"))
    assert sorted((r["kept"], r["dropped"]) for r in matrix.read_groups(spark, str(tmp_path / "g")).collect()) == rows
    assert matrix.read_groups(spark, str(tmp_path / "absent")).count() == 0


def test_signature_file_keeps_equal_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\na,b\nc, d,\n")
    got = matrix.read_ragged(spark, str(tmp_path / "s.csv"))
    per_row = sorted(tuple(x["feature"] for x in sorted(g, key=lambda x: x["pos"])) for g in _by(got.collect(), "row_id").values())
    assert per_row == [("a", "b"), ("a", "b"), ("c", "d")]


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_annotations_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,GO,Gene\nP1,x; y,G1\nP2,,\n")
    got = {r["ID"]: (r["GO"], r["Gene"]) for r in matrix.read_annotations(spark, str(tmp_path / "a.csv"), ("GO",)).collect()}
    assert got == {"P1": (["x", "y"], "G1"), "P2": (None, None)}
    matrix.write_lines(spark.createDataFrame([("(a,b);",)], "tree string"), "tree", str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["(a,b);"]


def test_p_values_of_a_file_matrix(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",1,2,3,4,5,6,7,8,9\np,A,A,A,B,B,B,C,C,C\ng1,1,2,3,4,5,6,7,8,9\n")
    h = stats.kruskal(matrix.read_csv(spark, str(tmp_path / "m.csv"))).first()
    assert h["h"] == pytest.approx(7.2)


def test_a_data_line_like_the_line_of_labels_is_data(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",s1,s2,s3\np,1,2,1\nq,5,6,7\np,1,2,1\n")
    got = matrix.read_csv(spark, f"file://{tmp_path}/m.csv").select("feature", "sample_id", "label", "value").collect()
    assert sorted(map(tuple, got)) == [("p", "s1", "1", 1.0), ("p", "s2", "2", 2.0), ("p", "s3", "1", 1.0), ("q", "s1", "1", 5.0), ("q", "s2", "2", 6.0), ("q", "s3", "1", 7.0)]
