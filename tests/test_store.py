import random

import pytest
from pyspark.sql import functions as F

from fixture53 import SCHEMA, points
from pointmill.errors import EngineError
from pointmill.plans.client import Client, dashboard
from pointmill.plans.command import run
from pointmill.sources.store import Store, StoreOptions
from pointmill.streaming.ingest import PushQueue, Reflector, ingest


def client(spark, path, schema="value/f64"):
    c = Client(spark, str(path))
    c.create_database("db")
    c.create_measurement("db", "m", schema)
    return c


def rows(values):
    return [{"time_ns": t, "value": v} for t, v in values]


def stored(c):
    return [(r.time_ns, r.value) for r in c.select_points("db", "m", "s").collect()]


def refused(name, f):
    with pytest.raises(EngineError) as e:
        f()
    assert e.value.name == name


def test_catalogue(spark, tmp_path):
    c = client(spark, tmp_path, "a/f64,b/u32")
    c.create_measurement("db", "m", "a/f64,b/u32")
    refused("MEASUREMENT_EXISTS", lambda: c.create_measurement("db", "m", "b/u32,a/f64"))
    refused("NO_SUCH_DATABASE", lambda: c.list_measurements("x"))
    refused("NO_SUCH_MEASUREMENT", lambda: c.get_schema("db", "x"))
    refused("INVALID_MEASUREMENT", lambda: c.create_measurement("db", "a/b", "x/f64"))
    assert c.list_databases() == ["db"] and c.list_measurements("db") == ["m"]
    assert [(r.name, r.type) for r in c.get_schema("db", "m").collect()] == [("a", "f64"), ("b", "u32")]
    for bad in ("series1/dumb/name", "series1 dumb name", "series1\\dumb\\name"):
        refused("INVALID_SERIES", lambda bad=bad: c.write_points("db", "m", bad, [{"time_ns": 1, "a": 1.0, "b": 1}]))
    with pytest.raises(KeyError):
        c.write_points("db", "m", "s", [{"time_ns": 1, "a": 1.0}])
    refused("INVALID_ARGUMENT", lambda: c.write_points("db", "m", "s", [{"time_ns": 1, "a": 1.0, "b": 2**32}]))
    assert StoreOptions.parse("chunk_size 2M # x\nwal_max_entries 1K").chunk_size == 2**21
    refused("INVALID_CONFIG_FILE", lambda: StoreOptions.parse("nothing 1"))
    refused("INVALID_CHUNK_SIZE", lambda: StoreOptions.parse("chunk_size 100"))


def test_append_rules(spark, tmp_path):
    c = client(spark, tmp_path)
    write = lambda v: c.write_points("db", "m", "s", rows(v))
    assert write([(0, 1.0), (10, None), (20, 3.0)]) == 3
    assert write([(10, None), (20, 3.0), (30, 4.0)]) == 1
    refused("OUT_OF_ORDER_TIMESTAMPS", lambda: write([(50, 1.0), (40, 1.0)]))
    refused("OUT_OF_ORDER_TIMESTAMPS", lambda: write([(50, 1.0), (50, 1.0)]))
    refused("FIELD_OVERWRITE_MISMATCH", lambda: write([(30, 5.0), (60, 1.0)]))
    refused("BITMAP_OVERWRITE_MISMATCH", lambda: write([(10, 2.0), (20, 3.0)]))
    refused("TIMESTAMP_OVERWRITE_MISMATCH", lambda: write([(15, 2.0)]))  # in a gap
    refused("TIMESTAMP_OVERWRITE_MISMATCH", lambda: write([(0, 1.0), (20, 3.0)]))  # skips a stored point
    assert stored(c) == [(0, 1.0), (10, None), (20, 3.0), (30, 4.0)]
    c.delete_points("db", "m", "s", 15)
    assert stored(c) == [(20, 3.0), (30, 4.0)]
    assert write([(5, 9.0), (12, 9.0), (20, 3.0), (30, 4.0), (40, 1.0)]) == 1  # what lies below the watermark is dropped
    c.store.compact("db", "m")
    c.store.vacuum("db", "m")
    assert stored(c) == [(20, 3.0), (30, 4.0), (40, 1.0)]
    assert write([(5, 9.0)]) == 0


def test_delete_watermarks(spark, tmp_path):
    c = client(spark, tmp_path)
    mark = lambda: c.store.watermarks("db", "m").first().time_first
    for t, want in ((1000, 1001), (500, 1001), (1500, 1501)):
        c.delete_points("db", "m", "s", t)
        assert mark() == want
    c.write_points("db", "m", "s", rows([(1501, 1.0), (1600, 2.0)]))
    c.delete_points("db", "m", "s", 1550)
    assert mark() == 1600 and stored(c) == [(1600, 2.0)]
    assert c.count_points("db", "m", "s", 1, 5).first().npoints == 0


def test_model_based(spark, tmp_path):
    """Random writes, overlaps and deletes against a list."""
    rng, c, model, first, t = random.Random(5), client(spark, tmp_path), [], 0, 0
    for size in (76, 128, 93, 1, 1, 2, 200, 12):
        fresh = [(t + i, rng.choice([None, rng.random()])) for i in range(size)]
        t += size
        again = model[-rng.randint(0, 20) :] if model else []
        c.write_points("db", "m", "s", rows([p for p in again + fresh]))
        model = model + [p for p in fresh if p[0] >= first]
        if rng.random() < 0.4:
            cut = rng.randint(0, t)
            c.delete_points("db", "m", "s", cut)
            model = [p for p in model if p[0] > cut]
            first = max(first, cut + 1)
        a, b = sorted((rng.randint(0, t), rng.randint(0, t)))
        assert [(r.time_ns, r.value) for r in c.select_points("db", "m", "s", ["value"], a, b, 10).collect()] == [p for p in model if a <= p[0] <= b][:10]
    assert stored(c) == model


def test_client_and_commands(spark, tmp_path):
    c = client(spark, tmp_path, SCHEMA)
    data = points()
    c.write_points("db", "m", "series1", [dict(zip(("time_ns", "field1", "field2", "field3"), r)) for r in data])
    go = lambda text: run(c, text)
    assert [r.time_ns for r in go("select field2 from db/m/series1 where 100 < time_ns <= 150 limit 3").collect()] == [110, 120, 130]
    assert [r.time_ns for r in go("SELECT FROM db/m/series1 WHERE time_ns >= 590 LAST 2").collect()] == [610, 620]
    assert go("SELECT * FROM db/m/series1").count() == 53
    assert go("COUNT FROM db/m/series1 WHERE 81 <= time_ns <= 89").first()[1:] == (0, 81, 89)
    assert go('COMPUTE "field1 / 2" FROM db/m/series1 LAST 1').first().value == data[-1][1] / 2
    assert go("MEAN field1,field2 FROM db/m/series1 WHERE 100 <= time_ns <= 700 window_ns 100").columns == ["window_ns", "field1_mean", "field2_mean"]
    assert go("INTEGRATE * FROM db/m/series1").first().field1_integral is None
    assert [r.series for r in go("LIST ACTIVE SERIES FROM db/m WHERE time_ns < 200").collect()] == ["series1"]
    assert go("LIST DATABASES") == ["db"] and go("list measurements from db") == ["m"]
    assert [r.series for r in go("LIST SERIES FROM db/m").collect()] == ["series1"] and go("LIST SCHEMA FROM db/m").count() == 3
    go("CREATE DATABASE other")
    go("CREATE MEASUREMENT other/x WITH FIELDS a/f64")
    go("DELETE FROM db/m/series1 WHERE time_ns < 300")
    assert go("SELECT FROM db/m/series1 LIMIT 1").first().time_ns == 300
    for bad in ("DELETE FROM db/m/series1 WHERE time_ns > 3", "SELECT * FROM db/m", "LIST ACTIVE SERIES FROM db/m", "MEAN field1 FROM db/m/series1", "NOTHING", "LIST DATABASES now", "SELECT * FROM db/m/series1 WHERE TIME_NS < 3"):
        refused("INVALID_COMMAND", lambda bad=bad: go(bad))
    refused("NO_SUCH_FIELD", lambda: go("SELECT x FROM db/m/series1"))
    assert c.get_all_points_mean("db", "m", window_ns=100).count() == 4
    panel = dashboard(c.store.points("db", "m"), "All", "field1", alias="$series of $series", max_points=10, window_ns=100, transform="Tare")
    assert {r.name for r in panel.collect()} == {"series1 of $series"}
    assert c.sum_compute_points("db", "m", "series1", "field1 * 0 + 1", window_ns=100).count() == 4


def test_all_types_round_trip(spark, tmp_path):
    c = client(spark, tmp_path, "b/bool,u/u32,w/u64,f/f32,d/f64,i/i32,l/i64")
    top = {"time_ns": 7, "b": True, "u": 2**32 - 1, "w": 2**64 - 1, "f": 0.5, "d": -1e300, "i": -(2**31), "l": -(2**63)}
    c.write_points("db", "m", "s", [top, {k: 8 if k == "time_ns" else None for k in top}])
    a, b = c.select_points("db", "m", "s").collect()
    assert a.asDict() == {"series": "s", **top} and all(b[k] is None for k in top if k != "time_ns")
    w = c.sum_points("db", "m", "s", ["b", "w"], window_ns=10).first()
    assert (w.b_sum, w.b_min, w.w_max, w.w_n) == (1.0, 1, 2**64 - 1, 1)


def test_streaming_restart(spark, tmp_path):
    c = client(spark, tmp_path / "store")
    src = str(tmp_path / "in")
    put = lambda n: spark.createDataFrame([("s", n * 10 + i, float(i)) for i in range(10)], "series string, time_ns long, value double").coalesce(1).write.mode("append").parquet(src)
    put(0)
    stream = spark.readStream.schema("series string, time_ns long, value double").parquet(src)
    ingest(stream, c.store, "db", "m", str(tmp_path / "cp"), available_now=True).awaitTermination()
    put(1)
    ingest(stream, c.store, "db", "m", str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert len(stored(c)) == 20
    ingest(stream, c.store, "db", "m", str(tmp_path / "cp2"), available_now=True).awaitTermination()  # all again: nothing new
    assert len(stored(c)) == 20


def test_store_and_forward(spark, tmp_path):
    local, remote = client(spark, tmp_path / "l").store, Store(spark, str(tmp_path / "r"))
    r = Reflector(local, remote, {"db": "far"})
    batch = lambda a, b: spark.createDataFrame([("s", t, float(t)) for t in range(a, b)], "series string, time_ns long, value double")
    assert not r.write("db", "m", batch(0, 5)) and r.pending("db", "m")
    remote.create_database("far")
    remote.create_measurement("far", "m", "value/f64")
    assert not r.write("db", "m", batch(5, 8))  # order: what is kept goes first
    assert r.flush("db", "m") == 8 and not r.pending("db", "m")
    assert r.write("db", "m", batch(8, 9)) and remote.points("far", "m").count() == 9


def test_push_queue():
    now, sent, down = [0.0], [], [True]

    def send(points):
        if down[0]:
            raise OSError
        sent.extend(points)

    q = PushQueue(send, most=2, retry_s=30, clock=lambda: now[0])
    q.append_list([{"time_ns": 1}, {"time_ns": 2}])
    down[0] = False
    q.append({"time_ns": 3})
    assert not sent
    now[0] = 31
    q.append({"time_ns": 4})
    assert [p["time_ns"] for p in sent] == [1, 2, 3, 4] and q.flush()


def _points(spark, rows):
    return spark.createDataFrame(rows, "series string, time_ns long, value double")


def _fresh(spark, tmp_path, **options):
    from pointmill.plans.client import Client
    from pointmill.sources.store import StoreOptions

    c = Client(spark, str(tmp_path / "s"), StoreOptions(**options))
    c.create_database("db")
    c.create_measurement("db", "m", "value/f64")
    return c


def test_series_are_known_from_the_state_alone(spark, tmp_path):
    c = _fresh(spark, tmp_path)
    c.store.append("db", "m", _points(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 5, 1.0)]))
    with pytest.raises(EngineError, match="NO_SUCH_SERIES"):
        c.select_points("db", "m", "c")
    c.store._live = None  # no points are looked at
    assert c.store.series("db", "m").count() == 2
    manifest = c.store._manifest("db", "m")[1]
    assert {(r.series, r.newest) for r in c.store._state("db", "m", manifest).collect()} == {("a", 2), ("b", 5)}


def test_appends_of_later_points_do_not_compare_with_history(spark, tmp_path, monkeypatch):
    c = _fresh(spark, tmp_path)
    c.store.append("db", "m", _points(spark, [("a", 1, 1.0)]))
    seen = []
    compare = type(c.store)._compare
    monkeypatch.setattr(type(c.store), "_compare", lambda *a: seen.append(1) or compare(*a))
    assert c.store.append("db", "m", _points(spark, [("a", 2, 1.0), ("b", 1, 1.0)])) == 2 and not seen
    assert c.store.append("db", "m", _points(spark, [("a", 2, 1.0), ("a", 3, 1.0)])) == 1 and seen


def test_a_full_tail_is_committed(spark, tmp_path):
    c = _fresh(spark, tmp_path, wal_max_entries=32)
    for i in range(4):
        c.store.append("db", "m", _points(spark, [("a", i, 1.0)]))
        manifest = c.store._manifest("db", "m")[1]
        assert len(manifest["tail"]) == (0 if i == 2 else i % 3 + 1)
    assert [c.store.count("db", "m", (t,)).first().npoints for t in ("base", "tail")] == [3, 1]
    c.store.vacuum("db", "m")
    assert c.store.points("db", "m").count() == 4


def test_manifests_appear_whole(spark, tmp_path):
    c = _fresh(spark, tmp_path)
    c.store.append("db", "m", _points(spark, [("a", 1, 1.0)]))
    with pytest.raises(EngineError):
        c.store._commit("db", "m", 0, {})
    assert c.store.points("db", "m").count() == 1
    assert not [x for x in c.store._names(f"{tmp_path}/s/databases/db/m") if x.endswith(".new")]


def test_flush_is_one_commit_and_runs_by_itself(spark, tmp_path):
    import time

    from pointmill.streaming.ingest import Reflector

    local, remote = _fresh(spark, tmp_path / "l"), _fresh(spark, tmp_path / "r")
    local.store.append("db", "m", _points(spark, [(s, t, 1.0) for s in "abcd" for t in (1, 2)]))
    r, before = Reflector(local.store, remote.store), local.store._manifest("db", "m")[0]
    end = r.every("db", "m", 0.2)
    until = time.monotonic() + 120
    while local.store._manifest("db", "m")[0] == before and time.monotonic() < until:
        time.sleep(0.2)
    end()
    assert local.store._manifest("db", "m")[0] == before + 1
    assert not r.pending("db", "m") and remote.store.points("db", "m").count() == 8


def test_sentinels_of_all_kinds(spark):
    from pointmill.functions.schema import LARGEST, SMALLEST
    from pointmill.operators.windows import window_agg

    kinds = {"bool": "boolean", "u32": "long", "u64": "decimal(20,0)", "f32": "float", "f64": "double", "i32": "int", "i64": "long"}
    d = spark.createDataFrame([("a", 0), ("a", 20)], "series string, time_ns long")
    for k, t in kinds.items():
        d = d.withColumn(k, F.lit(None).cast(t)).withMetadata(k, {"kind": k})
    r = window_agg(d, window_ns=10, sentinels=True).first()
    assert (r.bool_min, r.bool_max) == (1, 0)
    assert all((r[f"{k}_min"], r[f"{k}_max"]) == (LARGEST[k], SMALLEST[k]) for k in kinds)
