"""Queries against their SQL over events of which some have the same type and time."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pytest

from pointmill.errors import EngineError
from pointmill.operators import transforms
from pointmill.plans.catalogue import CATALOGUE, T0, T1, rounded_binary
from pointmill.plans.client import Client
from pointmill.sources.store import StoreOptions
from test_entry import norm


def rows():
    """Two values at one time, one value twice, both at the bounds of the queries, and at the end four at one time; and a series of two points."""
    at = lambda ns: datetime(1970, 1, 1) + timedelta(microseconds=ns // 1000)
    hour = 3600 * 10**9
    for kind in ("click", "error", "view"):
        times = [T0 - 90 * hour + i * 7 * hour for i in range(80)]
        times += [times[3], times[40], T0, T0, T0 + hour, T0 + hour, T1, T1, T1, *[times[-1] + hour] * 4]
        values = [round(1.5 + 7.25 * i, 2) for i in range(len(times))]
        values[-1] = values[-2] = values[-3]
        yield from sorted((at(t), kind, v) for t, v in zip(times, values))
    yield from ((at(t), "signup", 3.0) for t in (T0 - hour, T1 + hour))


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("ties"))
    c = duckdb.connect()
    c.execute("create table e (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    c.executemany("insert into e values (?, ?, 1, ?, ?, '{}')", [(i, *r) for i, r in enumerate(rows())])
    c.execute(f"copy e to '{d}/events.parquet' (format parquet)")
    return d


def same_as_sql(spark, sf, query, sql):
    got = query(spark, sf)
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = c.sql(sql)
    wanted = sorted((tuple(norm(dict(zip(want.columns, r))[k]) for k in columns) for r in want.fetchall()), key=str)
    assert sorted((tuple(norm(r[k]) for k in columns) for r in got.collect()), key=str) == wanted


@pytest.mark.parametrize("name", ["append_conflict", "command_text_delete", "command_text_active", "append_idempotent", "command_text_select", "command_text_mean", "count_tiers", "delete_front", "delete_then_append", "late_points_refused", "list_stored_series", "snapshot_read", "store_and_forward"])
def test_events_of_one_time(spark, sf, name):
    same_as_sql(spark, sf, *CATALOGUE[name])


@pytest.mark.parametrize("name", ["derivative_hour", "derivative_min", "derivative_sec"])
def test_derivatives_of_events_of_one_time(spark, sf, name):
    """The SQL leaves the order of one time open, and DuckDB takes them as it likes; here in that of their ids."""
    query, sql = CATALOGUE[name]
    for old, new in ((", value from events", ", value, event_id from events"), ("end as value from p", "end as value, event_id from p"), ("order by time_ns", "order by time_ns, event_id")):
        assert old in sql
        sql = sql.replace(old, new)
    same_as_sql(spark, sf, query, sql)


def test_ties_are_repeated_together(spark, tmp_path):
    c = Client(spark, str(tmp_path), StoreOptions(ties=True))
    c.create_database("db")
    c.create_measurement("db", "m", "value/f64")
    write = lambda *p: c.store.append("db", "m", spark.createDataFrame([("s", t, v) for t, v in p], "series string, time_ns long, value double"))
    kept = lambda: sorted(((r.time_ns, r.value) for r in c.store.points("db", "m").collect()), key=str)

    def refused(name, *p):
        before = kept()
        with pytest.raises(EngineError, match=name):
            write(*p)
        assert kept() == before

    one, two = [(1, 1.0), (1, 1.0), (1, 2.0)], [(5, 3.0), (5, None)]
    assert write(*one, *two) == 5
    assert write(*one, *two) == 0 and write(*two) == 0
    refused("TIMESTAMP_OVERWRITE_MISMATCH", *one[1:], *two)  # one point too few
    refused("TIMESTAMP_OVERWRITE_MISMATCH", *one, (1, 2.0), *two)  # one too many, not at the newest time
    refused("TIMESTAMP_OVERWRITE_MISMATCH", (5, 3.0))
    refused("FIELD_OVERWRITE_MISMATCH", (1, 1.0), (1, 2.0), (1, 2.0), *two)
    refused("BITMAP_OVERWRITE_MISMATCH", (5, 3.0), (5, 3.0))
    refused("FIELD_OVERWRITE_MISMATCH", (5, 4.0), (5, None), (5, 6.0))
    assert write(*two, (5, 3.0), (5, 4.0), (6, 1.0)) == 3
    assert kept() == sorted([*one, *two, (5, 3.0), (5, 4.0), (6, 1.0)], key=str)
    with pytest.raises(EngineError, match="OUT_OF_ORDER_TIMESTAMPS"):
        c.write_points("db", "m", "s", [{"time_ns": 7, "value": 1.0}, {"time_ns": 7, "value": 2.0}])
    c.delete_points("db", "m", "s", 4)
    assert [t for t, _ in kept()] == [5, 5, 5, 5, 6]


@pytest.mark.parametrize("files", [1, 5])
def test_derivative_between_points_of_one_time(spark, files):
    """In the order of the column named, however the rows come; also from a day to the next."""
    day = 86_400 * 10**9
    points = [(0, 1, 1.0), (0, 2, 4.0), (0, 3, 4.0), (0, 4, 2.0), (10**9, 5, None), (10**9, 6, 3.0), (day, 8, 5.0), (day, 7, 9.0)]
    d = spark.createDataFrame([("s", t, v, i) for t, i, v in points[::-1]], "series string, time_ns long, value double, id long").repartition(files)
    got = transforms.derivative(d, "value", "min", order="id").collect()
    inf, slow = float("inf"), 60 * 6.0 / 86_399
    assert sorted(str(r.value) for r in got) == sorted(map(str, [None, inf, float("nan"), -inf, None, None, slow, -inf]))


def test_rounded_binary(spark):
    values = [-2409882352.9411765, 2992935483.8709677, 0.5e-6, 1.5e-6, -0.4e-6, 0.49999999999999994e-6, 2.0**52 + 1, 1e300, 1.7e308, float("inf"), float("-inf"), float("nan"), None, 0.0, 123.4567895]
    rng = random.Random(3)
    values += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-8, 12) for _ in range(5000)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").coalesce(1)
    got = [r.v for r in rounded_binary(d, "v", to=6).orderBy("i").collect()]
    c = duckdb.connect()
    c.register("d", pa.table({"i": list(range(len(values))), "v": pa.array(values, pa.float64())}))
    assert list(map(repr, got)) == [repr(v) for (v,) in c.execute("select round(v, 6) from d order by i").fetchall()]


def test_comparisons_broadcast_the_rows_per_series(spark, tmp_path, monkeypatch):
    """Else all points of a series could meet in one task."""
    c = Client(spark, str(tmp_path), StoreOptions(ties=True))
    c.create_database("db")
    c.create_measurement("db", "m", "value/f64")
    batch = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 1.0), ("b", 2, 2.0)], "series string, time_ns long, value double")
    c.store.append("db", "m", batch)
    spans, compare = [], type(c.store)._compare
    monkeypatch.setattr(type(c.store), "_compare", lambda self, schema, fresh, span, *rest: spans.append(span) or compare(self, schema, fresh, span, *rest))
    assert c.store.append("db", "m", batch) == 0
    assert "strategy=broadcast" in spans[0]._jdf.queryExecution().analyzed().toString()
