"""Ridge by folds against the closed form; the audit chain against its parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import gram as G
from cohortlens.operators import models as ML
from cohortlens.plans import audit as A
from cohortlens.plans import counterfactuals as CF
from cohortlens.plans import reports as RP
from cohortlens.plans import variants as V
from cohortlens.plans.embed import embed


def closed_form(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    s = x / scale
    c = s - s.mean(axis=0)
    w = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - y.mean())) / scale
    return w, y.mean() - w @ x.mean(axis=0)


@pytest.mark.parametrize("block,task_bytes", [(256, G.TASK_BYTES), (4, 1)])  # one strip in all, and a pass for each
def test_ridge_folds_equal_the_closed_form(spark, monkeypatch, block, task_bytes):
    monkeypatch.setattr(G, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 9)) * rng.uniform(0.1, 50, 9)
    x[:, 4] = 0
    y = x @ rng.normal(size=9) + rng.normal(size=300) * 20
    fold = rng.integers(0, 4, 300)
    rows = [(int(f), float(t), v.tolist()) for f, t, v in zip(fold, y, x)]
    train = spark.createDataFrame(rows, "fold int, target double, embedding array<double>").repartition(5)
    alphas = [0.001, 1.0, 100.0]
    scores, model = G.ridge_folds(train, "target", alphas=alphas, task_bytes=task_bytes)
    mean = dict.fromkeys(alphas, 0.0)
    for r in scores.collect():
        w, b = closed_form(x[fold != r.fold], y[fold != r.fold], r.alpha)
        t, f = y[fold == r.fold], x[fold == r.fold] @ w + b
        assert np.isclose(r.r2, 1 - ((t - f) ** 2).sum() / ((t - t.mean()) ** 2).sum(), rtol=1e-8)
        assert np.isclose(r.mae, np.abs(t - f).mean(), rtol=1e-8) and r.n == len(t)
        mean[r.alpha] += r.r2 / 4
    assert model.alpha == max(alphas, key=mean.get)
    w, b = closed_form(x, y, model.alpha)
    assert np.allclose(model.weights, w, rtol=1e-7, atol=1e-9) and np.isclose(model.intercept, b, rtol=1e-7)
    got = train.select("embedding", model.predict("embedding").alias("f")).collect()
    assert all(np.isclose(r.f, np.array(r.embedding) @ w + b) for r in got)
    means = {r.alpha: (r["mean"], r.n_folds, len(r.folds)) for r in G.cv_summary(scores).collect()}
    assert all(np.isclose(means[a][0], mean[a]) and means[a][1:] == (4, 4) for a in alphas)
    assert G.ridge_folds(train.where("false"), "target")[1] is None


def test_nested_curve(spark):
    """Every share's model is the closed form on its prefix, scored on the rest."""
    rng = np.random.default_rng(3)
    x, u = rng.normal(size=(400, 5)), rng.uniform(size=400)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(t), v.tolist()) for a, t, v in zip(u, y, x)], "u double, y int, embedding array<double>").repartition(4)
    found = {r.train_share: r for r in G.nested_curve(df, "y", F.col("u"), [0.2, 0.5, 0.9]).collect()}
    assert set(found) == {0.2, 0.5, 0.9}
    for share, r in found.items():
        w, b = closed_form(x[u < share], y[u < share].astype(float), 1.0)
        p, t = x[u >= share] @ w + b, y[u >= share]
        wins = (p[t == 1][:, None] > p[t == 0][None, :]).mean()
        assert abs(r.auroc - wins) < 1e-9 and (r.n_train, r.n_test) == ((u < share).sum(), (u >= share).sum())
    assert G.nested_curve(df.where("false"), "y", F.col("u"), [0.5]).count() == 0


def test_listed_files(spark, tmp_path):
    from cohortlens.sources.files import read_listed

    for name, text in (("a/1.annotated.txt", "one\ntwo"), ("b/c/2.annotated.txt", ""), ("3.txt", "other"), ("x/4.annotated.txt", "p"), ("y/4.annotated.txt", "q")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    wanted = spark.createDataFrame([("1",), ("2",), ("4",), ("9",), ("1",)], "note_key string")
    got = sorted((r.note_key, r.status, r.n_bytes, r.text) for r in read_listed(spark, str(tmp_path), wanted, glob="*.annotated.txt").collect())
    assert got[:2] == [("1", "read", 7, "one\ntwo"), ("2", "missing", None, None)]  # empty files are not listed
    assert got[2:] == [("4", "twice", 1, "p"), ("4", "twice", 1, "q"), ("9", "missing", None, None)]


def test_generation_prompt_example(spark):
    from cohortlens.functions import prompts as PR

    row = spark.range(1).select(PR.generation_prompt(F.lit("t.csv"), F.lit("a,b")).alias("plain"),
                                PR.generation_prompt(F.lit("t.csv"), F.lit("a,b"), "Example: x,y").alias("shown")).first()
    head = "\n".join(PR.GENERATION_PROMPT_LINES)
    assert row.shown == row.plain.replace(head, head + "\n\nExample: x,y")


def test_multinomial_tuning_refits(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 4)) * 4
    rows = [(i, i % 3, i % 5 % 2, (centres[i % 3] + rng.normal(size=4)).tolist()) for i in range(180)]
    train = ML.with_features(spark.createDataFrame(rows, "id long, label int, fold int, embedding array<double>"))
    found = ML.tune_cv(train, "label", grid=[{"C": c, "class_weight": None} for c in (0.001, 1.0)], family="multinomial", refit=True)
    assert len(found["cv"]) == 2 and all(len(r["folds"]) == 2 and 0.8 < r["mean"] <= 1 for r in found["cv"])
    assert found["best"]["C"] in (0.001, 1.0)
    assert found["model"].transform(train).where("prediction = label").count() > 160


def notes_of(spark) -> tuple:
    return V.cohort_notes(spark, "/root/testdata/sf0.01")


def test_audit_of_the_base_and_its_parts(spark):
    """The unswapped run's delta is 0 and every run is what its model gives its texts."""
    notes, splits = notes_of(spark)
    models = A.fitted_models(notes, splits, dim=16)
    test = notes.join(splits.filter("split = 'test'").drop("split"), "hadm_id")
    shift = CF.age_shift(test)
    rows = A.scored(shift, models, "age_shift", dim=16)
    runs = A.run_metrics(rows, ["mean_proba"]).collect()
    values = {(r.variant, r.model): r.value for r in runs}
    assert len(values) == 2 * shift.select("variant").distinct().count() > 2
    plain = ML.with_features(embed(shift.filter("variant = 'age'"), "text", ["hadm_id"], 16))
    for name, model in models.items():
        mean = ML.score(model, plain).agg(F.avg("p")).first()[0]
        assert abs(values["age", name] - mean) < 1e-12
    every = RP.delta_to_baseline(A.run_metrics(rows, ["mean_proba"]), ["family", "model"], F.col("variant") == "age", ["value"]).collect()
    assert all(r.value_delta == 0 for r in every if r.variant == "age")
    assert any(abs(r.value_delta) > 0 for r in every if r.variant != "age" and r.model == "full")
    none = A.audit(notes.where("false"), splits, ["age_shift"])
    assert none.count() == 0


def test_texts_of_a_family_cross_one_exchange(spark):
    """Pairing moves keys; the rewritten text meets them in one exchange of the notes' text."""
    notes, splits = notes_of(spark)
    test = notes.join(splits.filter("split = 'test'").drop("split"), "hadm_id")
    for family in (CF.gender_counterfactuals, CF.race_counterfactuals, CF.age_counterfactuals):
        plan = family(test)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1  # the notes, by stay id
        found = family(test).groupBy("variant").count().collect()
        assert len(found) > 8


def test_race_effects_have_bases_of_their_own(spark):
    runs = spark.createDataFrame([("A", "anon", 0.5), ("A_race", "anon", 0.7), ("A_to_B_name", "anon", 0.6), ("A_to_B_race", "anon", 0.9),
                                  ("B", "anon", 0.1), ("B_race", "anon", 0.2), ("B_to_A_name_address", "anon", 0.4)],
                                 "variant string, model string, mean_proba double")
    got = {(r.orig, r.new, r.kind): round(r.delta, 9) for r in RP.race_effects(RP.race_parts(runs)).collect()}
    assert got == {("A", "A", ""): 0, ("A", "A", "race"): 0, ("A", "B", "name"): 0.1, ("A", "B", "race"): 0.2,
                   ("B", "B", ""): 0, ("B", "B", "race"): 0, ("B", "A", "name_address"): 0.3}


def test_importance_scores_counts_of_kinds(spark):
    """equal to permuting every copy; the model sees kinds of rows and no row of its own."""
    import hashlib

    rows = [(i, i % 3 == 0, "FM"[i % 2], None if i % 17 == 0 else "abc"[i * i % 3]) for i in range(60)]
    df = spark.createDataFrame([(i, int(y), g, r) for i, y, g, r in rows], "id long, y int, g string, r string")
    points = {"F": 0.5, "M": 0.0, "a": 0.1, "b": 0.2, "c": 0.4, None: 0.0}
    seen = []

    class Model:
        def transform(self, d):
            seen.append(d.columns)
            cost = lambda c: sum(F.when(F.col(c) == k, v).otherwise(0.0) for k, v in points.items() if k)
            return d.withColumn("prediction", cost("g") + cost("r"))

    got = {r["column"]: r for r in ML.permutation_importance(Model(), df, ["g", "r"], "y", "id", lambda d: d, 5, 3).collect()}
    assert not any("id" in c for c in seen)

    def auc(pairs):
        pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))

    def order(rep, col, tag):
        return sorted(range(60), key=lambda i: int(hashlib.md5(f"{i}|{rep}|{col}|{tag}".encode()).hexdigest()[:13], 16))
    base = auc([(round(points[g] + points[r], 6), y) for _, y, g, r in rows])
    for k, col in ((2, "g"), (3, "r")):
        values = []
        for rep in range(5):
            moved = dict(zip(order(rep, col, "3-to"), order(rep, col, "3")))
            other = 5 - k
            values.append(auc([(round(points[rows[moved[i]][k]] + points[rows[i][other]], 6), rows[i][1]) for i in range(60)]))
        assert got[col].importance_mean == pytest.approx(base - np.mean(values), abs=1e-12)
        assert got[col].importance_std == pytest.approx(np.std(values), abs=1e-12)


def test_words_that_variants_share_are_counted_once_a_note(spark):
    """the same vectors as from whole texts; a variant's own text is a few chunks."""
    from cohortlens.plans.embed import word_counts
    head = ("Name:\t<name>___</name>.Sex <sex>F</sex>\n<form_of_address>Ms.</form_of_address> is <age>7</age>year <dob>x</dob> "
            "<gendered_noun>woman</gendered_noun> ΑΣ Σ.<race>r</race>Β old old words in the head <address>___</address>")
    tails = ["", "tail", " ΟΣ.Σ a tail", "Été x x\n" + "many many words " * 90]
    heads = [head, head + "<", "K <5 and " + head, "<other>no</other> slot", "", head.replace("\t", "")]
    rows = []
    for i, (h, t) in enumerate((h, t) for h in heads for t in tails):
        rows.append((i, "FM"[i % 2], "AB"[i // 2 % 2], "AB"[i // 2 % 2], f"{'FM'[i % 2]}_{'AB'[i // 2 % 2]}",
                     None if i == 3 else f"Ann {i} Σ", f"{i} Road", 20 + i * 2, 1990 + i, i % 3 == 0, h + t))
    notes = spark.createDataFrame(rows, "hadm_id long, gender string, race string, race_abbrev string, abbrev string, name string, "
                                  "address string, actual_age int, dob int, thirty_day_readmission boolean, text string")
    day = F.lit("2025-01-02").cast("timestamp")
    notes = notes.select("*", day.alias("admittime_today"), day.alias("dischtime_today")).coalesce(1)
    made = {"gender": CF.gender_counterfactuals, "race": CF.race_counterfactuals, "explicit": CF.race_counterfactuals_explicit,
            "shift": lambda n, count=None: CF.age_shift(n, count=count, lo=0),
            "swap": lambda n, count=None: CF.age_counterfactuals(n, 3, count=count),
            "level": lambda n, count=None: V.anonymisation_levels(n, count=count).withColumnRenamed("level", "variant")}
    for name, make in made.items():
        whole, parts = make(notes), make(notes, count=A.counter(16))
        want = embed(whole, "text", ["variant", "hadm_id"], 16).collect()
        got = embed(parts, "text", ["variant", "hadm_id"], 16, counts="counts").collect()
        assert len(got) > 20 and sorted(map(tuple, got)) == sorted(map(tuple, want)), name
        assert parts.where("hadm_id = 23").agg(F.max(F.length("text"))).first()[0] < 250  # of more than 1,500
    df = spark.createDataFrame([(None,), ("a A b",)], "t string")
    assert [sum(r[0]) for r in word_counts(df, F.col("t"), "n", 4).select("n").collect()] == [0, 3]
