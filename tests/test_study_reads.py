from hazardframe.plans.workflow import StudyConfig, prepare


def test_the_cohort_is_read_once(spark):
    n, seen = 60, spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    features = spark.createDataFrame([(f"P{i}", float(i % 7)) for i in range(n)], "PatientID string, f double").mapInArrow(count, "PatientID string, f double")
    clinical = spark.createDataFrame([(f"P{i}", float(i % 11 + 1), i % 2, "I", "male" if i % 3 else "female", "nos" if i % 5 else "large cell") for i in range(n)],
                                     "PatientID string, time double, event int, stage string, gender string, histology string")
    data = prepare(features, clinical, StudyConfig("PatientID", "time", "event", "stage", "gender", "histology"))
    assert data.train.count() + data.test.count() == n
    assert seen.value == n
