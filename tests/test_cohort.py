import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.operators import encode, splits
from hazardframe.sources import tables as st

GRADE = {"low": 1, "mid": 2, "high": 3, "top": 4}


@pytest.fixture(scope="module")
def features(spark):
    rows = [(7, 0.25, -1.0), (8, 0.5, -2.5), (9, None, 4.0), (12, 1.75, None)]
    return spark.createDataFrame(rows, "unit int, load double, drift double")


@pytest.fixture(scope="module")
def clinical(spark):
    rows = [(7, "mid", "female", "Oak", 310.0, 0), (8, None, "male", "Ash", 95.5, 1), (9, "top", None, "Ash", 12.0, 1), (12, "low", "female", None, 640.0, 0)]
    return spark.createDataFrame(rows, "unit int, grade string, sex string, wood string, days double, failed int")


def test_join_and_encoding(features, clinical):
    merged = encode.merge_cohort(features, clinical, "unit")
    enc = encode.CohortEncoder("grade", "sex", "wood", GRADE).fit(merged)
    rows = {r.unit: r for r in enc.transform(merged).collect()}
    # Ranks and binary codes; a missing one takes the most frequent value (of equal ones the last rank).
    assert len(rows) == 4 and (rows[7].grade, rows[9].grade, rows[12].grade) == (2, 4, 1)
    assert rows[8].grade is not None and rows[9].sex is not None and rows[7].sex != rows[8].sex
    cols = enc.transform(merged).columns
    assert "wood_Oak" in cols and "wood_Ash" not in cols and sum(c.startswith("wood_") for c in cols) == 2
    missing = next(c for c in cols if c.startswith("wood_") and c != "wood_Oak")
    assert rows[12][missing] == 1 and rows[12].wood_Oak == 0 and rows[7].wood_Oak == 1 and rows[8][missing] == 0
    names = st.numeric_features(enc.transform(merged), ["unit", "days", "failed", "absent"])
    assert sorted(names) == sorted(["load", "drift", "grade", "sex", "wood_Oak", missing])
    # New data with unseen and missing categories gets the same columns.
    later = merged.where("unit = 7").withColumn("wood", F.lit("new"))
    assert enc.transform(later).columns == cols


def test_missing_columns_are_left_alone(features):
    enc = encode.CohortEncoder("grade", "sex", "wood").fit(features)
    assert enc.transform(features).columns == features.columns


def test_shared_columns_get_suffixes(spark):
    a = spark.createDataFrame([(1, "x", 2)], "id int, `v.w` string, z int")
    b = spark.createDataFrame([(1, "y")], "id int, `v.w` string")
    assert encode.merge_cohort(a, b, "id").columns == ["id", "v.w_x", "z", "v.w_y"]


def test_repeated_subjects_multiply_and_are_reported(spark):
    a = spark.createDataFrame([(u, float(k)) for u, n in ((3, 3), (5, 1), (6, 2)) for k in range(n)], "unit int, f double")
    b = spark.createDataFrame([(3, 8.0, 1), (3, 9.0, 1), (5, 2.0, 0), (6, 4.0, 1), (6, 4.5, 0), (6, 5.0, 0)], "unit int, t double, e int")
    merged = encode.merge_cohort(a, b, "unit")
    row = encode.cohort_counts(merged, "unit").first()
    assert (row.n_rows, row.n_subjects, row.has_duplicates) == (3 * 2 + 1 + 2 * 3, 3, True)
    split = splits.train_test_split(merged, "unit", "t", "e", 0.67).select("unit", "is_train").distinct().collect()
    assert len(split) == 3 and sum(r.is_train for r in split) == 2


def test_stratified_split_sizes_and_fallback(spark):
    rows = [(i, float(i), i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, t double, e boolean")
    out = splits.stratified_split(df, "id", "t", "e", 0.8).collect()
    assert sum(r.is_train for r in out) == 80
    for e in (True, False):
        for late in (True, False):
            part = [r for r in out if r.e == e and (r.t > 49.5) == late]
            assert abs(sum(r.is_train for r in part) - 0.8 * len(part)) <= 1
    five = spark.createDataFrame([("a", 3.0, True), ("b", 71.0, False), ("c", 8.0, True), ("d", 2.0, True), ("e", 66.0, False)],
                                 "id string, t double, e boolean")
    assert sum(r.is_train for r in splits.stratified_split(five, "id", "t", "e", 0.6).collect()) == 3
    with pytest.raises(ValueError):
        splits.stratified_split(five.where("id <> 'b'"), "id", "t", "e", 0.6)


def test_split_is_the_same_for_any_partitioning(spark):
    df = spark.createDataFrame([(i, float(i % 17), i % 2 == 0) for i in range(300)], "id int, t double, e boolean")
    picks = [{r.id for r in splits.stratified_split(d, "id", "t", "e").where("is_train").collect()} for d in (df.coalesce(1), df.repartition(16))]
    assert picks[0] == picks[1]


def test_folds_are_even_and_cover_all_rows(spark):
    df = spark.range(103).withColumnRenamed("id", "sid")
    long = splits.kfold_long(df, ["sid"], 5, 2)
    sizes = {(r["repeat"], r["fold"]): r["count"] for r in long.groupBy("repeat", "fold").count().collect()}
    assert sorted(sizes.values()) == [20] * 4 + [21] * 6 and len(sizes) == 10
    assert len(splits.default_alphas()) == 20
    assert splits.default_alphas()[0] == pytest.approx(0.1) and splits.default_alphas()[-1] == pytest.approx(10 ** -0.1)


def test_medians_and_scaling_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7000, 3)).round(2)
    x[:, 2] = 4.0
    x[rng.random((7000, 3)) < 0.1] = np.nan
    df = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x], "features array<double>").repartition(5)
    names = ["a", "b", "c"]
    imp = encode.MedianImputer(names).fit(df)
    np.testing.assert_allclose(imp.medians, np.nanmedian(x, axis=0), rtol=1e-12)
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = encode.ZScore(names).fit(imp.transform(df))
    np.testing.assert_allclose(z.means, filled.mean(0), rtol=1e-9)
    np.testing.assert_allclose(z.deviations, [filled[:, 0].std(), filled[:, 1].std(), 1.0], rtol=1e-9)
    got = np.stack([r.features for r in z.transform(imp.transform(df)).collect()])
    assert got[:, :2].std() == pytest.approx(1.0, abs=1e-6) and (got[:, 2] == 0).all()


def test_medians_under_masks(spark):
    x = np.arange(40, dtype=float)
    df = spark.createDataFrame([([float(v)], [int(v) % 2]) for v in x], "features array<double>, folds array<int>")
    masks = [None, F.col("folds")[0] != 0, F.col("folds")[0] != 1]
    assert encode.masked_medians(df, "features", ["a"], masks) == [[19.5], [20.0], [19.0]]


def test_column_without_values_is_an_error(spark):
    df = spark.createDataFrame([([1.0, None],), ([2.0, None],)], "features array<double>")
    with pytest.raises(ValueError, match="b"):
        encode.MedianImputer(["a", "b"]).fit(df)


def test_small_training_set_stops(spark):
    with pytest.raises(ValueError, match="too small"):
        encode.require_min_rows(spark.range(14))
    encode.require_min_rows(spark.range(15))


def test_complete_subjects(spark):
    rows = [("A", "CT", "s1"), ("A", "RTSTRUCT", "s2"), ("B", "CT", "s3"), ("C", "RTSTRUCT", "s4")]
    df = spark.createDataFrame(rows, "PatientID string, Modality string, Series string")
    pick = lambda d, n: sorted(r.Series for r in st.select_complete_subjects(d, "PatientID", "Modality", ["CT", "RTSTRUCT"], n).collect())
    assert pick(df, 100) == ["s1", "s2"]  # more than there are: all
    with pytest.raises(ValueError):
        pick(df.where("PatientID <> 'A'"), 1)
    assert [r.PatientID for r in st.subjects_with_all(df, "PatientID", "Modality", ["CT", "RTSTRUCT"]).collect()] == ["A"]


def test_regroup_and_rejects(spark, tmp_path):
    rows = [("d1", "a.dcm", "P1", "CT"), ("d1", "b.dcm", None, None), ("d2", "a.dcm", "P1", "RTSTRUCT"), ("d3", "a.dcm", None, "CT"), ("d3", "b.dcm", "P9", "CT")]
    files = spark.createDataFrame(rows, "folder string, path string, PatientID string, Modality string")
    placed, rejects = st.regroup_manifest(files, "folder", "path", "PatientID", "Modality")
    assert sorted((r.folder, r.path, r.PatientID, r.Modality) for r in placed.collect()) == [
        ("d1", "a.dcm", "P1", "CT"), ("d1", "b.dcm", "P1", "CT"), ("d2", "a.dcm", "P1", "RTSTRUCT")]
    assert [(r.folder, r.n_files) for r in rejects.collect()] == [("d3", 2)]
    st.write_manifest(placed, str(tmp_path / "m"), "PatientID", "Modality")
    back = spark.read.parquet(str(tmp_path / "m"))
    assert back.where("PatientID = 'P1' and Modality = 'CT'").count() == 2


def test_pairs_pending_and_validation(spark):
    files = spark.createDataFrame([("P1", "image"), ("P1", "label"), ("P2", "image"), ("P3", "label")], "id string, kind string")
    got = {r.id: r.status for r in st.complete_pairs(files, "id", "kind").collect()}
    assert got == {"P1": "ok", "P2": "label missing", "P3": "image missing"}
    left = st.pending_only(files, spark.createDataFrame([("P1",)], "id string"), "id")
    assert {r.id for r in left.collect()} == {"P2", "P3"}
    meta = spark.createDataFrame([("a", False, 0, False, [10, 10, 5], None), ("b", True, 0, False, [10, 10, 5], None),
                                  ("c", True, 2, False, [10, 10, 5], None), ("d", True, 1, True, [10, 10, 5], [12, 12, 5]),
                                  ("e", True, 1, True, [10, 10, 5], [10, 10, 5])],
                                 "id string, has_label boolean, n_rois int, has_target boolean, image_size array<int>, mask_size array<int>")
    assert [r.status for r in st.validate_images(meta).orderBy("id").collect()] == [
        "no label file", "no region in the label file", "target region missing", "size mismatch", "ok"]
    with pytest.raises(ValueError, match="12"):
        st.validate_images(meta, strict=True)


def test_csv_with_missing_values(spark, tmp_path):
    header = "PatientID,age,clinical.T.Stage,Clinical.N.Stage,Clinical.M.Stage,Overall.Stage,Histology,gender,Survival.time,deadstatus.event\n"
    (tmp_path / "c.csv").write_text(header + "L1,78.7,2,3,0,IIIb,large cell,male,2165,1\nL2,NA,NA,0,0,NA,NA,female,155,0\n")
    rows = st.read_clinical(spark, str(tmp_path / "c.csv")).orderBy("PatientID").collect()
    assert rows[0]["Survival.time"] == 2165 and rows[0].age == 78.7
    assert [rows[1][c] for c in ("age", "clinical.T.Stage", "Overall.Stage", "Histology")] == [None] * 4
    (tmp_path / "f.csv").write_text("PatientID,f.1,note\nL1,1.5,x\nL2,NaN,y\n")
    feats = st.read_features(spark, str(tmp_path / "f.csv"))
    assert [r["f.1"] for r in feats.orderBy("PatientID").collect()] == [1.5, None]
    assert st.numeric_features(feats, ["PatientID"]) == ["f.1"]


def test_wide_table_reports_and_staleness(spark, tmp_path):
    long = spark.createDataFrame([("P1", "b", 1.0), ("P1", "a", 2.0), ("P2", "a", 3.0)], "id string, feature string, value double")
    wide = st.features_long_to_wide(long, "id", names=["b", "a"])
    assert wide.columns == ["id", "b", "a"] and {r.id: r.b for r in wide.collect()} == {"P1": 1.0, "P2": None}
    with pytest.raises(ValueError):
        st.features_long_to_wide(long.where("id = 'none'"), "id")
    assert st.drop_prefixed(spark.createDataFrame([(1, 2)], "diagnostics_x int, y int")).columns == ["y"]
    st.write_report(spark.createDataFrame([("P1", 1.23456)], "id string, v double"), str(tmp_path / "r"), 4)
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().v == "1.2346"
    one, two = wide.select("id"), wide.select("id").where("id = 'P1'")
    assert st.cohort_differences(one, one, "id").count() == 0
    st.require_cohort_match(one, one, "id")
    with pytest.raises(ValueError, match="outdated"):
        st.require_cohort_match(one, two, "id")
