import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

from dialwise.operators import logit as lg


def drawn(spark, n=6000):
    rng = random.Random(3)
    rows = []
    for _ in range(n):
        age, system, area = rng.randrange(0, 2000) / 365.25, rng.choice("abc"), rng.choice(["11", "21"])
        score = 1.5 - 0.4 * age + {"a": 0, "b": 0.7, "c": -0.5}[system] + (0.3 if area == "21" else 0)
        rows.append((age, system, area, int(rng.random() < 1 / (1 + 2.718281828**-score))))
    return spark.createDataFrame(rows, "age double, system string, area string, y int").repartition(5)


def test_agrees_with_the_library_on_the_same_design(spark):
    rows = drawn(spark)
    fit = lg.logit_fit(rows, "y", ["age"], ["system", "area"])
    assert fit.settled and fit.names == ("const", "age", "system=b", "system=c", "area=21")
    encoded = rows
    for name in ("system", "area"):
        indexer = StringIndexer(inputCol=name, outputCol=f"{name}_i", stringOrderType="alphabetDesc")
        encoded = indexer.fit(encoded).transform(encoded)
        # The encoder drops the last level, which is the first by name.
        coder = OneHotEncoder(inputCol=f"{name}_i", outputCol=f"{name}_v")
        encoded = coder.fit(encoded).transform(encoded)
    design = VectorAssembler(inputCols=["age", "system_v", "area_v"], outputCol="features").transform(encoded)
    library = LogisticRegression(labelCol="y", maxIter=200, tol=1e-12, standardization=False).fit(design)
    age, c, b, area = library.coefficients
    want = [library.intercept, age, b, c, area]
    assert list(fit.values) == pytest.approx(want, abs=2e-5)
    assert fit["age"] == pytest.approx(-0.4, abs=0.1) and fit["system=b"] > 0 > fit["system=c"]


def test_fit_does_not_depend_on_partitions_and_leaves_nulls_out(spark):
    rows = drawn(spark, 800)
    odd = spark.createDataFrame(
        [(None, "a", "11", 1), (1.0, None, "11", 1), (1.0, "a", "11", None)], rows.schema
    )
    one = lg.logit_fit(rows.coalesce(1), "y", ["age"], ["system"])
    many = lg.logit_fit(rows.repartition(9).unionByName(odd.where("age IS NULL OR system IS NULL OR y IS NULL")), "y", ["age"], ["system"])
    assert list(one.values) == pytest.approx(list(many.values), abs=1e-9)


def test_separated_data_without_rows_and_ridge(spark):
    rows = spark.createDataFrame([(float(i), "a", "x", int(i > 5)) for i in range(12)], drawn(spark, 1).schema)
    fit = lg.logit_fit(rows, "y", ["age"], ["system"], ridge=0.1)
    assert fit.settled and fit["age"] > 0
    assert not lg.logit_fit(rows, "y", ["age"], steps=5).settled
    none = lg.logit_fit(rows.limit(0), "y", ["age"], ["system"])
    assert none.values == (0.0, 0.0) and not none.settled and none.steps == 0


def test_too_many_levels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lg, "MOST_UNKNOWNS", 20)
    rows = spark.range(100).selectExpr("CAST(id AS STRING) AS c", "CAST(id % 2 AS INT) AS y")
    with pytest.raises(ValueError, match="more than 20 levels"):
        lg.logit_fit(rows, "y", [], ["c"])
