import numpy as np
from pyspark.sql import functions as F

from presswork.llm import common, ordinal, quality, toxicity

SF = "/root/testdata/sf0.1"


def _split(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    return docs, labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")


def test_quality_keeps_good_and_drops_bad(spark):
    docs, train, test = _split(spark)
    got = quality.grade_documents(docs, train).join(test, "doc_id").toPandas()
    assert got["selected"][got["quality"] == 1].mean() > 0.98 and got["selected"][got["quality"] == 0].mean() < 0.15
    assert got["expected_grade"].between(0, 2).all()


def test_toxicity_on_held_out_labels(spark):
    docs, train, test = _split(spark)
    got = toxicity.grade_toxicity(docs, train).withColumnRenamed("toxic", "flag").join(test, "doc_id").toPandas()
    assert got["flag"][got["toxic"] == 1].mean() > 0.75 and got["flag"][got["toxic"] == 0].mean() < 0.02


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(0)
    lists, grade = [], []
    for _ in range(600):
        f = np.unique(rng.integers(0, 30, 6)).astype(np.int32)
        x = (f < 10).sum() - (f >= 20).sum() + rng.logistic() * 0.3
        lists.append(f)
        grade.append(int(x > 2) + int(x > 0) + int(x > -2))
    m = ordinal.fit_features(np.array(grade), lists, False, 3, 1.0, 300, 1.0)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[:10].mean() > 0.8 > -0.8 > m.weights[20:30].mean()
    expected = m.expected(np.array([m.weights[f].sum() for f in lists]))
    assert np.corrcoef(expected, grade)[0, 1] > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "an idiot")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.grade_toxicity(docs, labels).collect()
    assert len(got) == 4 and not any(r.toxic for r in got)
    assert all(r.selected for r in quality.grade_documents(docs, labels.limit(0)).collect())
    assert quality.grade_documents(docs.limit(0), labels).collect() == []
    assert toxicity.severities(docs, labels.withColumn("text", F.lit("clash"))).count() == 2


def test_a_hot_text_does_not_pass_the_bound(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(ordinal, "fit_features", lambda grade, lists, *_: seen.append(len(lists)))
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit("one hot text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"), (F.col("id") % 3).alias("grade"))
    ordinal.fit(rows, shape=False, max_rows=500)
    assert seen == [500]


def test_scores_match_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = ordinal.fit(docs.select("text", (F.length("text") % 3).alias("grade")), shape=False, min_z=0.5)
    powers = ordinal.textops.Powers()
    for r, t in zip(ordinal.score(docs, model).orderBy("key").collect(), docs.orderBy("doc_id").collect(), strict=True):
        raw = np.frombuffer((t.text or "").encode(), np.uint8)
        f, _ = ordinal.features(raw, np.array([0, len(raw)]), powers, False)
        x = sum(float(model.weights[k]) for k in f.tolist())
        tails = [1 - 1 / (1 + np.exp(-(th - x))) for th in model.thresholds]
        assert np.allclose(r.tails, tails, atol=1e-5) and abs(r.expected - sum(tails)) < 1e-4


def test_fit_is_the_optimum_of_the_plain_likelihood():
    rng = np.random.default_rng(4)
    lists = [np.unique(rng.integers(0, 12, 4)).astype(np.int32) for _ in range(400)]
    grade = [int(x > 1.5) + int(x > -0.5) for x in ((f < 4).sum() - (f >= 8).sum() + rng.logistic() for f in lists)]
    m = ordinal.fit_features(np.array(grade), lists, False, 3, 1.0, 600, 0.0)
    used = sorted(set(np.concatenate(lists).tolist()))

    def loss(weights, thresholds):
        """Penalised negative log likelihood, row by row: P(grade <= k) is logistic in threshold k minus the sum of the row's weights."""
        total = sum(x * x for x in weights.values()) / 2
        for f, y in zip(lists, grade, strict=True):
            s = sum(weights[k] for k in f.tolist())
            upper = 1.0 if y == 2 else 1 / (1 + np.exp(s - thresholds[y]))
            lower = 0.0 if y == 0 else 1 / (1 + np.exp(s - thresholds[y - 1]))
            total -= np.log(upper - lower)
        return total

    weights, thresholds = {k: float(m.weights[k]) for k in used}, m.thresholds.tolist()
    best = loss(weights, thresholds)
    for k in used:
        for d in (0.05, -0.05):
            assert loss(weights | {k: weights[k] + d}, thresholds) > best - 0.01
    for i in range(2):
        for d in (0.05, -0.05):
            assert loss(weights, [t + d * (j == i) for j, t in enumerate(thresholds)]) > best - 0.01
