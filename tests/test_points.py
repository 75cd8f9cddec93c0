import math

import pytest
from pyspark.sql import functions as F

from fixture53 import SCHEMA, points
from pointmill.errors import EngineError
from pointmill.functions.formula import compile_formula
from pointmill.functions.schema import MeasurementSchema
from pointmill.functions.timerange import TimeRange, nanoseconds
from pointmill.operators import integral, scan, transforms, windows
from pointmill.operators.neighbours import with_previous

DATA = points()
GOLDEN = {  # window: per field n, sum, min, max
    100: ((7, 5454046676, 48271, 1368261836), (7, 2.9493274488014425, 0.036930898704501704, 0.9018863769265696), (7, 3.8152957893908024, 0.040271345525979996, 0.8391653299331665)),
    200: ((8, 9741254237, 714099836, 1877713710), (9, 5.3485674521406805, 0.12859901192467568, 0.9559103292002439), (9, 5.666989699006081, 0.12742115557193756, 0.9722397327423096)),
    300: ((6, 5997723542, 59146883, 2096673248), (9, 4.43138744861948, 0.08868869448889857, 0.9177560595960879), (9, 3.5895933657884598, 0.0027115046977996826, 0.9261026382446289)),
    400: ((8, 9106308145, 271717590, 1922522338), (6, 2.6357278061432092, 0.18642736802476212, 0.635499682403635), (7, 2.8501169458031654, 0.015801269561052322, 0.8915110230445862)),
    500: ((7, 6764842731, 6812073, 2003560298), (9, 5.004473178185964, 0.12134091939902018, 0.9001498486848081), (5, 2.7972194105386734, 0.12594427168369293, 0.8600255846977234)),
    600: ((2, 1975471627, 902001726, 1073469901), (2, 0.38126508414863153, 0.1370685860859869, 0.24419649806264462), (1, 0.43771278858184814, 0.43771278858184814, 0.43771278858184814)),
}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("series1", *r) for r in DATA], MeasurementSchema.parse(SCHEMA).struct()).cache()


def frame(spark, rows, fields="value double"):
    return spark.createDataFrame(rows, f"series string, time_ns long, {fields}")


def test_golden_windows(df):
    rows = windows.window_agg(df, ["*"], 100, 700, 100).orderBy("window_ns").collect()
    assert [r.window_ns for r in rows] == list(GOLDEN)
    for r in rows:
        for f, (n, total, low, high) in zip(("field1", "field2", "field3"), GOLDEN[r.window_ns]):
            assert r[f"{f}_n"] == n
            assert r[f"{f}_sum"] == pytest.approx(total, rel=1e-12)
            assert (r[f"{f}_min"], r[f"{f}_max"]) == (low, high)
            assert r[f"{f}_mean"] == pytest.approx(total / n, rel=1e-12)


def test_windows_over_gaps_are_empty(df):
    for t in (81, 301, 631):
        assert windows.window_agg(df, ["*"], t, t + 8, 5).count() == 0


def test_window_rules(spark):
    d = frame(spark, [("a", 0, 1.0), ("a", 12, None), ("a", 31, 4.0), ("b", 25, 2.0)])
    w = {(r.series, r.window_ns): r for r in windows.window_agg(d, ["value"], window_ns=10).collect()}
    assert sorted(w) == [("a", 0), ("a", 10), ("a", 20), ("a", 30), ("b", 20)]
    assert (w["a", 10].value_sum, w["a", 10].value_n, w["a", 10].value_min, w["a", 10].value_mean) == (0.0, 0, None, None)
    # a leading partial window is dropped; a series that lives before t0 starts at t0's window
    assert sorted(r.window_ns for r in windows.window_agg(d, ["value"], 1, 100, 10).where("series='a'").collect()) == [10, 20, 30]
    # the first live point, not the first in range, decides where a series starts
    assert [r.window_ns for r in windows.window_agg(d, ["value"], 0, 100, 10).where("series='b'").collect()] == [20]
    s = windows.window_agg(d, ["value"], window_ns=10, sentinels=True).where("series='a' and window_ns=20").first()
    assert (s.value_min, s.value_max) == (math.inf, -math.inf)
    with pytest.raises(EngineError, match="INVALID_ARGUMENT"):
        windows.window_agg(d, ["value"], window_ns=0)


def test_counts_by_exhaustive_sliding(spark, df):
    """All ranges in one plan: 90..630 by 5."""
    edges = spark.range(90, 631, 5)
    cases = edges.select(F.col("id").alias("t0")).crossJoin(edges.select(F.col("id").alias("t1")))
    got = cases.join(df, (F.col("time_ns") >= F.col("t0")) & (F.col("time_ns") <= F.col("t1"))).groupBy("t0", "t1").count()
    for r in got.collect():
        assert r["count"] == sum(r.t0 <= t <= r.t1 for t, *_ in DATA)
    for t0, t1 in ((81, 89), (91, 100), (545, None), (700, 10)):
        names = spark.createDataFrame([("series1",)], "series string")
        r = scan.count_points(df, t0, t1, names).first()
        want = [t for t, *_ in DATA if t0 <= t <= (10**9 if t1 is None else t1)]
        assert (r.npoints, r.time_first, r.time_last) == ((len(want), want[0], want[-1]) if want else (0, t0, t1))


def test_first_and_last(df):
    for t0, t1, n in ((90, 550, 1), (105, 300, 7), (200, 205, 3), (600, None, 10), (300, 200, 5), (100, 620, 0)):
        times = [t for t, *_ in DATA if t0 <= t <= (10**9 if t1 is None else t1)]
        first = [r.time_ns for r in scan.select_series(df, "series1", ["field2"], t0, t1, first=n).collect()]
        last = [r.time_ns for r in scan.select_series(df, "series1", ["field2"], t0, t1, last=n).collect()]
        assert first == times[:n] and last == (times[-n:] if n else [])
        assert sorted(r.time_ns for r in scan.select_last(df, [], t0, t1, n).collect()) == last


def test_field_resolution(df):
    assert scan.select_range(df, ["field3", "field1"]).columns[2:] == ["field3", "field1"]
    assert scan.select_range(df, []).columns == ["series", "time_ns"]
    assert scan.select_range(df, ["*"]).columns[2:] == ["field1", "field2", "field3"]
    for fields, name in ((["x"], "NO_SUCH_FIELD"), (["field1", "field1"], "DUPLICATE_FIELD")):
        with pytest.raises(EngineError) as e:
            scan.select_range(df, fields)
        assert e.value.name == name
    assert EngineError("NO_SUCH_FIELD").code == -7


def test_schema_rules():
    assert str(MeasurementSchema.parse("a/f64, b/u32")) == "a/f64,b/u32"
    for bad, name in (("a/f64,a/u32", "DUPLICATE_FIELD"), ("a/text", "INVALID_MEASUREMENT"), ("a", "INVALID_MEASUREMENT"), (",".join(f"f{i}/u32" for i in range(65)), "TOO_MANY_FIELDS"), ("x" * 124 + "/f64", "INVALID_MEASUREMENT")):
        with pytest.raises(EngineError) as e:
            MeasurementSchema.parse(bad)
        assert e.value.name == name
    wide = MeasurementSchema.parse(",".join(f"f{i}/u32" for i in range(64)))
    with pytest.raises(EngineError, match="DUPLICATE_FIELD"):
        wide.resolve(["f40", "f40"])
    assert wide.resolve(["f8", "f40"]) == ["f8", "f40"]


def test_time_ranges():
    assert TimeRange.compared("<", 5) == TimeRange(None, 4)
    assert TimeRange.framed(1, "<", "<", 9) == TimeRange(2, 8)
    assert nanoseconds("2024-01-01T00:00:00.5Z") == 1704067200500000000
    with pytest.raises(EngineError):
        TimeRange.compared("!=", 1)


def test_integral(spark, df):
    r = integral.integrate(df, ["field1"]).first()
    assert (r.t0_ns, r.t1_ns, r.field1_integral) == (100, 620, None)
    for i in (0, 2, 7):
        t, *v = DATA[i]
        assert integral.integrate(df, ["field2"], t, t).first().field2_integral == v[1]
        t2, *v2 = DATA[i + 1]
        want = None if v[1] is None or v2[1] is None else (v[1] + v2[1]) * 10 / 2e9
        assert integral.integrate(df, ["field2"], t, t2).first().field2_integral == pytest.approx(want)
    assert integral.integrate(df, ["field2"], 5, 6).count() == 0
    one = integral.integrate(frame(spark, [("a", 0, 3.0)])).first()
    assert (one.value_integral, one.value_average) == (3.0, None)
    zero = integral.integrate(frame(spark, [("a", 0, 2.0), ("a", 10**9, 4.0)])).first()
    assert (zero.t0_ns, zero.value_integral, zero.value_average) == (0, 3.0, 3.0)


def test_previous_across_buckets(spark):
    d = frame(spark, [("a", t, float(t)) for t in (0, 3, 9, 10, 47, 99)] + [("b", 50, 1.0)])
    got = {(r.series, r.time_ns): r["__prev"] and r["__prev"].time_ns for r in with_previous(d, ["value"], 10).collect()}
    assert got == {("a", 0): None, ("a", 3): 0, ("a", 9): 3, ("a", 10): 9, ("a", 47): 10, ("a", 99): 47, ("b", 50): None}


def value(spark, text, **fields):
    d = frame(spark, [("s", 0, *fields.values(), 0.0)], ", ".join([f"{k} double" for k in fields] + ["zz double"]))
    return d.select(compile_formula(text).value.alias("v")).first().v


@pytest.mark.parametrize("text, fields, want", [
    ("-a * sin(12*y + 17) - 5 + a", {"a": 1.23, "y": 3.45}, -4.9519158547031115),
    ("1/x", {"x": 0.0}, math.inf), ("0-1/x", {"x": 0.0}, -math.inf), ("0/x", {"x": 0.0}, math.nan), ("1/0", {}, math.inf),
    ("ln(x)", {"x": 0.0}, -math.inf), ("ln(x)", {"x": -1.0}, math.nan), ("log10(x)", {"x": 1000.0}, 3.0), ("log2(x)", {"x": 8.0}, 3.0),
    ("--3", {}, 3.0), ("+3", {}, 3.0), ("- -3", {}, 3.0), ("2*-3", {}, -6.0), (".5", {}, 0.5), ("1.", {}, 1.0), ("1.5e-3", {}, 0.0015),
    ("pow(1, x)", {"x": math.nan}, 1.0), ("pow(-1, x)", {"x": math.inf}, 1.0), ("pow(2, 10)", {}, 1024.0), ("2-3-4", {}, -5.0), ("2+3*4", {}, 14.0),
    ("min(a, b) - max(a, b)", {"a": 1.0, "b": 4.0}, -3.0), ("pi() + e()", {}, math.pi + math.e), ("cos(0) + exp(0)", {}, 2.0), ("x + 1", {"x": None}, None),
])
def test_formula_values(spark, text, fields, want):
    got = value(spark, text, **fields)
    if want is not None and math.isnan(want):
        assert math.isnan(got)
    else:
        assert got == (want if want is None or math.isinf(want) else pytest.approx(want, rel=1e-14))


@pytest.mark.parametrize("text, name", [
    ("1E3", "INVALID_NUMBER"), (".", "INVALID_NUMBER"), ("1e", "INVALID_NUMBER"), ("3x", "INVALID_NUMBER"), ("a ^ 2", "INVALID_FORMULA_CHARACTER"),
    ("2 3", "UNEXPECTED_TOKEN"), ("(a) b", "UNEXPECTED_TOKEN"), ("sqrt(4)", "UNEXPECTED_TOKEN"), ("a b", "SHUNT_EXTRA_EXPRESSIONS"), ("a, b", "SHUNT_EXTRA_EXPRESSIONS"),
    ("min(1,2,3)", "SHUNT_EXTRA_EXPRESSIONS"), ("", "SHUNT_EXTRA_EXPRESSIONS"), ("(a", "MISSING_PAREN"), ("a)", "MISSING_PAREN"),
    ("a *", "SHUNT_MISSING_OP_ARG"), ("pow(2)", "SHUNT_MISSING_FUNC_ARG"), ("sin()", "SHUNT_MISSING_FUNC_ARG"),
])
def test_formula_errors(spark, text, name):
    with pytest.raises(EngineError) as e:
        compile_formula(text)
    assert e.value.name == name


def test_formula_fields_must_exist(df):
    with pytest.raises(EngineError, match="NO_SUCH_FIELD"):
        scan.compute(df, "nothing + 1")
    got = [r.value for r in scan.compute(df, "field1 * 2", last=5).orderBy("time_ns").collect()]
    assert got == [None if r[1] is None else r[1] * 2.0 for r in DATA[-5:]]


def test_window_compute(df):
    rows = {r.window_ns: r for r in windows.window_compute(df, "field1 + field2", 100, 700, 100).collect()}
    for w, r in rows.items():
        v = [a[1] + a[2] for a in DATA if w <= a[0] < w + 100 and a[1] is not None and a[2] is not None]
        assert r.n == len(v) and r.sum == pytest.approx(sum(v)) and r.min == min(v) and r.max == max(v)


def test_transforms(spark):
    d = frame(spark, [("a", 0, None), ("a", 10**9, 5.0), ("a", 3 * 10**9, 2.0)])
    assert [r.value for r in transforms.tare(d, "value").orderBy("time_ns").collect()] == [None, 0.0, -3.0]
    assert [r.value for r in transforms.difference(d, "value").orderBy("time_ns").collect()] == [None, None, -3.0]
    assert [r.value for r in transforms.derivative(d, "value", "min").orderBy("time_ns").collect()] == [None, None, -90.0]
    for kind, spark_type, size in (("u32", "long", 2**32), ("u64", "decimal(20,0)", 2**64), ("bool", "boolean", 2**8)):
        u = frame(spark, [("a", 0, 1), ("a", 1, 0)], "v int").select("series", "time_ns", F.col("v").cast(spark_type).alias("v", metadata={"kind": kind}))
        assert [r.value for r in transforms.difference(u, "v").orderBy("time_ns").collect()] == [None, size - 1]


def test_envelope_and_downsampling(spark):
    ms = 10**6
    w = 10 * ms
    d = frame(spark, [("a", t * ms, v) for t, v in ((1, None), (11, 1.0), (15, 3.0), (35, 7.0), (36, 9.0))] + [("b", 5 * ms, 1.0)] + [("c", i * ms, None) for i in range(9)])
    got = transforms.downsample(d, "value", 0, 100 * ms, 2, w, "Min/Max").orderBy("series", "time_ns").collect()
    a = [(r.time_ns // ms, r.value) for r in got if r.series == "a"]
    assert a == [(0, None), (1, None), (10, 2.0), (11, 3.0), (12, 1.0), (20, None), (21, None), (30, 9.0), (31, 7.0)]
    assert [(r.time_ns, r.value) for r in got if r.series == "b"] == [(5 * ms, 1.0)]
    assert not [r for r in got if r.series == "c"]
    means = [(r.time_ns // ms, r.value) for r in transforms.downsample(d, "value", 0, 100 * ms, 2, w, "Mean").where("series='a'").orderBy("time_ns").collect()]
    assert means == [(0, None), (10, 2.0), (20, None), (30, 8.0)]
    assert [r.series for r in transforms.downsample(d, "value", max_points=2, zoom=None).collect()] == ["b"]


def test_active_series(spark):
    d = frame(spark, [("b", 1, 1.0), ("a", 5, 1.0), ("c", 9, None)])
    assert [r.series for r in scan.active_series(d, 1, 5).collect()] == ["a", "b"]
    assert [r.series for r in scan.list_series(d).collect()] == ["a", "b", "c"]


def test_predicates_reach_the_scan(spark, tmp_path):
    frame(spark, [("a", i, 1.0) for i in range(100)]).withColumn("other", F.lit(1.0)).write.partitionBy("series").parquet(str(tmp_path / "p"))
    d = spark.read.parquet(str(tmp_path / "p"))
    q = scan.select_series(d, "a", ["value"], 5, 50, last=3)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(time_ns,5)" in plan and "PartitionFilters: [isnotnull(series" in plan
    assert "other" not in plan.split("ReadSchema")[1].split("\n")[0]
