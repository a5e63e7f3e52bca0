import random
from decimal import Decimal

import pytest

from lakeglass.operators import metrics
from lakeglass.plans.registry import QUERIES

#: Cents whose mean is 50 exactly; summed as doubles they give less in some orders, more in others.
CENTS = [c for x in random.Random(0).choices(range(1, 10000), k=100) for c in (x, 10000 - x)]


@pytest.fixture(scope="module")
def orders(spark):
    """The same values in four orders, as the items 20 to 23."""
    orders = [CENTS, sorted(CENTS), sorted(CENTS, reverse=True), CENTS[::3] + CENTS[1::3] + CENTS[2::3]]
    rows = [(20 + i, c / 100, 1000 * i + j) for i, o in enumerate(orders) for j, c in enumerate(o)]
    return spark.createDataFrame(rows, "user_id long, value double, event_id long").coalesce(1)


def test_latency_by_domain_whatever_the_order(spark, orders, tmp_path):
    orders.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["latency_by_domain"](spark, str(tmp_path)).collect()
    assert [(r["domain"], r["mean_ms"]) for r in sorted(got)] == [(20 + i, 50) for i in range(4)]


def test_ranked_domains_whatever_the_order(spark, orders, tmp_path):
    orders.write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["ranked_domains"](spark, str(tmp_path)).collect()
    assert [(r["domain"], r["millis"], r["rank"]) for r in sorted(got)] == [(20 + i, 50, 1) for i in range(4)]


def test_steady_mean_of_odd_values(spark):
    rows = [("null", None), ("some", 1.5), ("some", None), ("nan", float("nan")), ("nan", 1.0), ("huge", 1e300), ("huge", 1e300), ("fine", 1e-12), ("fine", 3e-12), ("low", -0.1), ("low", -0.3)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(metrics.steady_mean("v").alias("m")).collect()}
    assert got["null"] is None and got["some"] == 1.5 and got["nan"] != got["nan"]
    assert got["huge"] == 1e300 and got["fine"] == pytest.approx(2e-12) and got["low"] == -0.2
    whole = spark.createDataFrame([(1, Decimal("2.50")), (2, Decimal("3.50"))], "i long, d decimal(10,2)").agg(metrics.steady_mean("i"), metrics.steady_mean("d")).first()
    assert [float(x) for x in whole] == [1.5, 3.0]
