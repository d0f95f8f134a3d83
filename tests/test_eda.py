import pytest

from tabloom.functions.expressions import OperatorError
from tabloom.operators.profile import eda_summary


def test_group_comparison_and_trend(spark):
    nan = float("nan")
    t = spark.createDataFrame([("2024-01-03", "a", 1.0, 4), ("2024-01-09", "a", 3.0, None), ("2024-02-01", None, nan, 6), ("2024-02-02", None, 8.0, 2)],
                              "day string, g string, x double, y int").selectExpr("to_timestamp(day) AS day", "g", "x", "y")
    found = eda_summary(t, "day", ["x", "y"], group="g")
    got = {(r["g"], r["measure"]): r for r in found["comparison"].collect()}
    a, none = got["a", "x"], got[None, "x"]
    assert (a["rows"], a["count"], a["mean"], a["min"], a["max"]) == (2, 2, 2.0, 1.0, 3.0)
    assert a["std"] == pytest.approx(2 ** 0.5) and a["share"] == pytest.approx(4 / 12) and a["lift"] == pytest.approx(0.5)
    assert (none["rows"], none["count"], none["mean"], none["std"]) == (2, 1, 8.0, None)
    assert sum(got[g, "y"]["share"] for g in ("a", None)) == pytest.approx(1.0)
    assert {(r["period"].month, r["g"], r["x"], r["rows"]) for r in found["trend"].collect()} == {(1, "a", 2.0, 2), (2, None, 8.0, 2)}
    assert "comparison" not in eda_summary(t, "day", ["x"])
    assert eda_summary(t.filter("false"), "day", ["x"], group="g")["comparison"].collect() == []
    for call in (lambda: eda_summary(t, "day", ["x"], group="nope"), lambda: eda_summary(t.withColumnRenamed("g", "rows"), "day", ["x"], group="rows")):
        with pytest.raises(OperatorError):
            call()
