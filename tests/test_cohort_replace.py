from cohortlens.plans.cohort import replace_mismatched


def test_flagged_stays_without_candidate_stay(spark):
    cols = "hadm_id long, gender string, race string, actual_age int"
    sample = spark.createDataFrame([(1, "F", "A", 50), (2, "F", "A", 50), (3, "F", "A", 50), (4, "M", "B", 60)], cols)
    pool = sample.union(spark.createDataFrame([(10, "F", "A", 50), (11, "F", "A", 51), (12, "M", "B", 60)], cols))
    notes = spark.createDataFrame([(1, "Sex: F"), (2, "Sex: M"), (3, "Sex: M"), (10, "Sex: F"), (11, "Sex: F"),
                                   (12, "Sex: F")], "hadm_id long, text string")
    got = replace_mismatched(sample, pool, notes)
    assert sorted((r.hadm_id, r.replaced, r.mismatched) for r in got.collect()) == [
        (1, False, False), (3, False, True), (4, False, True), (10, True, False)]
