import json

from pyspark.sql import functions as F

from parapet.config import load
from parapet.queries import sources as queries
from parapet.streaming import requests


def test_serve(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [
        {"method": "GET", "path": "/a/-/a-1.tgz", "sha256": "x", "source_ip": "1", "at": "2024-01-01T10:00:00Z"},
        {"method": "GET", "path": "/a/-/a-1.tgz", "sha256": "old", "source_ip": "1", "at": "2024-01-03T10:00:00Z"},
        {"method": "GET", "path": "/a", "sha256": "x", "source_ip": "1", "at": "2024-01-01T10:00:00Z"},
    ]
    (tmp_path / "in/r.json").write_text("\n".join(map(json.dumps, rows)))
    spark.createDataFrame([("x", "2024-01-01 09:00:00", "warn"), ("x", "2024-01-01 09:30:00", "block"), ("old", "2024-01-01 09:00:00", "block")], "sha256 string, t string, verdict string").select("sha256", F.to_timestamp("t").alias("analyzed_at"), "verdict").write.parquet(str(tmp_path / "cache"))
    got = []
    q = requests.serve(requests.requests(spark, str(tmp_path / "in")), lambda s: s.read.parquet(str(tmp_path / "cache")), lambda df: got.extend(df.select("sha256", "verdict", "response_code").collect()), str(tmp_path / "cp"))
    assert q.awaitTermination(90)
    assert sorted(map(tuple, got)) == [("old", None, None), ("x", "block", 200)]


def test_bursts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"pkg_id": "a", "version": str(i), "ts": f"2024-01-01T0{i}:10:00Z"} for i in range(4)] + [{"pkg_id": "b", "version": "1", "ts": "2024-01-05T00:00:00Z"}]
    (tmp_path / "in/r.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("pkg_id string, version string, ts timestamp").json(str(tmp_path / "in"))
    q = requests.bursts(stream, 3).writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert {(r.pkg_id, r.versions) for r in spark.table("bursts").collect()} == {("a", 4)}


def test_rechecks(spark, tmp_path):
    (tmp_path / "ticks").mkdir()
    (tmp_path / "ticks/t.json").write_text('{"at": "2024-01-01T00:00:00Z"}\n')
    ticks = spark.readStream.schema("at timestamp").json(str(tmp_path / "ticks"))
    up = lambda s: s.createDataFrame([("x", "block")], "sha256 string, verdict string")
    q = requests.rechecks(ticks, up, str(tmp_path / "store"), str(tmp_path / "cp"))
    assert q.awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1


def _asked(folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(json.dumps({"method": "GET", "path": f"/{n}/-/{n}-1.tgz", "sha256": sha, "source_ip": "1", "at": at}) for n, sha, at in rows))


def test_serve_scores_what_is_not_known(spark, tmp_path):
    """Misses are analysed once each, stored and answered; later requests find them; broken archives are refused."""
    store, out = str(tmp_path / "cache"), []
    spark.createDataFrame([("k", "2024-01-01 09:00:00", "block", 1.0, "r")], "sha256 string, t string, verdict string, score double, rules string").select("sha256", F.to_timestamp("t").alias("analyzed_at"), "verdict", "score", "rules").write.parquet(store)
    held = {"clean": queries.PACKAGES["clean"], "piped": queries.PACKAGES["piped"]}
    rows = [(n, bytearray(queries.tgz(f))) for n, f in held.items()] + [("broken", bytearray(b"no archive"))]
    known = spark.createDataFrame(rows, "package_name string, content binary")
    fetch = lambda missed: missed.join(known, "package_name").select(F.col("sha256").alias("pkg_id"), "content")
    scorer = requests.archive_scorer(fetch, load(env={}))

    def run():
        q = requests.serve(requests.requests(spark, str(tmp_path / "in")), lambda s: s.read.parquet(store), lambda df: out.extend(map(tuple, df.select("sha256", "verdict", "response_code").collect())), str(tmp_path / "cp"), 24, scorer, store)
        assert q.awaitTermination(180)
        found = sorted(out, key=repr)
        out.clear()
        return found

    day = "2024-01-01T1{}:00:00Z".format
    _asked(tmp_path / "in", [("known", "k", day(0)), ("clean", "c", day(0)), ("clean", "c", day(1)), ("piped", "p", day(0)), ("broken", "b", day(0))])
    assert run() == [("b", None, 403), ("c", "allow", 200), ("c", "allow", 200), ("k", "block", 200), ("p", "block", 403)]
    assert spark.read.parquet(store).groupBy("sha256").count().filter("count > 1").count() == 0
    _asked(tmp_path / "in", [("piped", "p", day(2)), ("known", "k", "2024-01-02T10:00:00Z")])
    assert run() == [("k", None, 403), ("p", "block", 200)]


def test_lookup_is_of_each_request(spark):
    """An entry that ended before one request still answers an earlier one."""
    entries = spark.createDataFrame([("x", 0, "warn"), ("x", 3600, "block")], "sha256 string, t long, verdict string").select("sha256", F.timestamp_seconds("t").alias("analyzed_at"), "verdict")
    asked = spark.createDataFrame([("x", 7000), ("x", 7200), ("y", 1)], "sha256 string, t long").select("sha256", F.timestamp_seconds("t").alias("at"))
    got = requests.looked_up(asked, entries, 1).select("sha256", F.unix_timestamp("at").alias("t"), "verdict").collect()
    assert sorted(map(tuple, got), key=repr) == [("x", 7000, "block"), ("x", 7200, None), ("y", 1, None)]
