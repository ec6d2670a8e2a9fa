"""Sources, incremental tables, joins, gates."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemark.operators import gates, joins
from pulsemark.sources import files, snapshots, store, tables

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("s", T.StringType())])


def test_strict_csv(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("id,v,s\n1,2.5,a\n2,,b\n")
    assert [tuple(r) for r in tables.read_strict_csv(spark, str(tmp_path / "ok.csv"), SCHEMA).orderBy("id").collect()] == [(1, 2.5, "a"), (2, None, "b")]
    (tmp_path / "bad.csv").write_text("id,s,v\n1,a,2.5\n")
    with pytest.raises(ValueError):
        tables.read_strict_csv(spark, str(tmp_path / "bad.csv"), SCHEMA)
    (tmp_path / "rows.csv").write_text("id,v,s\nx,2.5,a\n")
    with pytest.raises(Exception):
        tables.read_strict_csv(spark, str(tmp_path / "rows.csv"), SCHEMA).collect()


def test_read_formats_prune(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a")], SCHEMA)
    for fmt in ("parquet", "json", "orc"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert tables.read_table(spark, str(tmp_path / fmt), fmt, SCHEMA, ["s"]).collect()[0].s == "a"


def test_offsets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"offsets": {"m1": -12, "m2": 30}, "diagnostics": {"m1": {"n": 4, "median": 0.97}}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"m1": 5}))
    got = {r.map_id: r.offset_ms for r in tables.read_offsets(spark, str(tmp_path / "a.json")).collect()}
    assert got == {"m1": -12, "m2": 30}
    assert {r.map_id: r.offset_ms for r in tables.read_offsets(spark, str(tmp_path / "b.json")).collect()} == {"m1": 5}
    d = tables.read_offset_diagnostics(spark, str(tmp_path / "a.json"), "n:int,median:double").collect()
    assert [(r.map_id, r.n, r.median) for r in d] == [("m1", 4, 0.97)]


def test_booleans(spark):
    df = spark.createDataFrame([("TRUE",), ("0",), ("1 ",), ("x",)], "a string")
    assert [r[0] for r in df.select(tables.parse_bool("a")).collect()] == [True, False, True, None]


def test_files(spark, tmp_path):
    for name, text in (("good/a.txt", "one"), ("good/b.txt", "one"), ("poor/c.txt", "two")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    f = files.read_files(spark, str(tmp_path), "*.txt")
    index = {r.md5: (r.path.rsplit("/", 1)[1], r.copies) for r in files.hash_index(f).collect()}
    assert index[hashlib.md5(b"one").hexdigest()] == ("a.txt", 2)
    cats = {r.path.rsplit("/", 1)[1]: r.category for r in files.categorised(f, "/(good|poor)/").collect()}
    assert cats == {"a.txt": "good", "b.txt": "good", "c.txt": "poor"}
    shas = files.with_sha256(f)
    manifest = shas.where(~F.col("path").endswith("c.txt")).withColumn(
        "sha256", F.when(F.col("path").endswith("b.txt"), "x").otherwise(F.col("sha256"))
    ).unionByName(spark.createDataFrame([("gone", "y")], "path string, sha256 string"))
    got = {r.path.rsplit("/", 1)[-1]: r.status for r in files.audit_manifest(shas, manifest).collect()}
    assert got == {"a.txt": "ok", "b.txt": "changed", "c.txt": "unlisted", "gone": "missing"}


def test_replace_buckets_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, float(i), "old") for i in range(20)], SCHEMA)
    first.withColumn("bucket", store.bucket_of(["id"], 4)).write.partitionBy("bucket").parquet(path)
    batch = spark.createDataFrame([(3, 1.0, "new"), (3, 2.0, "new"), (99, 0.0, "new")], SCHEMA)
    store.replace_buckets(spark, path, batch, ["id"], 4)
    got = spark.read.parquet(path)
    assert got.count() == 22 and got.where("id = 3").count() == 2 and got.where("s = 'new'").count() == 3
    store.append(first, str(tmp_path / "log"), "csv")
    store.append(first, str(tmp_path / "log"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 40


def table_of(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_snapshots_show_the_old_or_the_new_rows(spark, tmp_path, monkeypatch):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"), ["id"], 4)
    with pytest.raises(ValueError):
        t.read()
    old = [(i, float(i), "old") for i in range(20)]
    assert t.replace(spark.createDataFrame(old, SCHEMA)) == 1
    before = t.read()
    new = [(3, 1.0, "new"), (3, 2.0, "new"), (99, 0.0, "new")]
    want = sorted([r for r in old if r[0] != 3] + new)
    seen = []
    commit = snapshots.Snapshots.commit

    def watched(self, manifest):
        seen.append(table_of(self.read()))  # all data is written, the manifest is not: a reader sees the old state
        return commit(self, manifest)

    monkeypatch.setattr(snapshots.Snapshots, "commit", watched)
    assert t.replace(spark.createDataFrame(new, SCHEMA)) == 2
    assert seen == [sorted(old)] and table_of(t.read()) == want
    assert table_of(before) == sorted(old) and table_of(t.read(1)) == sorted(old)

    def dies(self, manifest):
        raise RuntimeError("lost")

    monkeypatch.setattr(snapshots.Snapshots, "commit", dies)
    with pytest.raises(RuntimeError):
        t.replace(spark.createDataFrame([(5, 5.0, "lost")], SCHEMA))
    assert table_of(t.read()) == want and t.versions() == [1, 2]
    gone = t.collect_garbage(1)
    assert len(gone) == 1 and t.versions() == [2] and table_of(t.read()) == want  # the first folder still holds three buckets
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([(5, "x")], "id long, s string"))


def test_a_write_that_is_overtaken_starts_again(spark, tmp_path, monkeypatch):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"), ["id"], 2)
    t.replace(spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a")], SCHEMA))
    commit, calls = snapshots.Snapshots.commit, []

    def overtaken(self, manifest):
        calls.append(manifest["version"])
        if len(calls) == 1:  # another writer commits the same version first
            other = snapshots.Snapshots(spark, self.path, ["id"], 2)
            other.replace(spark.createDataFrame([(2, 9.0, "other")], SCHEMA))
        return commit(self, manifest)

    monkeypatch.setattr(snapshots.Snapshots, "commit", overtaken)
    assert t.replace(spark.createDataFrame([(1, 5.0, "mine")], SCHEMA)) == 3
    assert calls == [2, 2, 3] and table_of(t.read()) == [(1, 5.0, "mine"), (2, 9.0, "other")]


def test_incremental_runs_take_what_is_left(spark, tmp_path):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"), ["id"], 4)
    planned = spark.range(30)
    runs = []

    def run(failing):
        def attempt(cells):
            runs.append(sorted(r.id for r in cells.collect()))
            return cells.select("id", F.when(F.col("id") % 7 == failing, "ERROR").otherwise("OK").alias("status"))

        return attempt

    assert snapshots.incremental_run(t, planned.where("id < 20"), run(3), batches=3) == 3
    assert sorted(sum(runs, [])) == list(range(20))
    runs.clear()
    assert snapshots.incremental_run(t, planned, run(-1)) == 1
    assert runs == [[3, 10, 17, *range(20, 30)]]
    assert snapshots.incremental_run(t, planned, run(-1)) == 0
    assert t.read().where("status = 'OK'").count() == 30


def test_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.csv").write_text("beatmap,player,n\nB1,Ann,1\nB2,,2\nbeatmap,player,n\nB1,Bob,3\n")
    (tmp_path / "a" / "two.csv").write_text('\n"n","username" , "x"\n5,"Eve, the ""second""",y\n6,Ann\n')
    (tmp_path / "three.csv").write_text("n,m\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "note.txt").write_text("beatmap\nB9\n")
    wanted = ["beatmap", "player", "username"]
    got = [(r.file_path.rsplit("/", 1)[1], r.beatmap, r.player, r.username) for r in tables.read_by_header(spark, str(tmp_path), wanted).collect()]
    assert sorted(got, key=str) == sorted(
        [("one.csv", "B1", "Ann", None), ("one.csv", "B2", None, None), ("one.csv", "B1", "Bob", None), ("two.csv", None, None, 'Eve, the "second"'), ("two.csv", None, None, "Ann")],
        key=str,
    )
    ids = files.historical_ids_in(spark, str(tmp_path), {"map": ["beatmap"], "user": ["player", "username"]}, source="/([^/]+)$")
    assert {(r.entity, r.id, tuple(r.sources)) for r in ids.collect()} == {
        ("map", "b1", ("one.csv",)), ("map", "b2", ("one.csv",)), ("user", "ann", ("one.csv", "two.csv")), ("user", "bob", ("one.csv",)), ("user", 'eve, the "second"', ("two.csv",))
    }
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.csv").write_text("id,v,s\n1,2.5,a\n")
    (tmp_path / "b" / "q.csv").write_text("id,s,v\n1,a,2.5\n")
    with pytest.raises(ValueError, match="q.csv"):
        tables.read_strict_csv(spark, str(tmp_path / "b"), SCHEMA)


def test_append_unique_and_schema(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "a")], SCHEMA)
    new = spark.createDataFrame([(2, 1.0, "b"), (2, 5.0, "c"), (3, 0.0, "d")], SCHEMA)
    got = sorted(tuple(r) for r in store.append_unique(old, new, ["id"], ["v"]).collect())
    assert got == [(1, 1.0, "a"), (2, 5.0, "c"), (3, 0.0, "d")]
    with pytest.raises(ValueError):
        store.upsert(old, new.drop("s"), ["id"])


def test_resume(spark):
    res = spark.createDataFrame([("a", "OK"), ("b", "ERROR"), ("c", "SKIP_CAPACITY"), ("d", "OK")], "config_id string, status string")
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("d", 0)], "config_id string, label int")
    done = store.completed_keys(res, "config_id", {"features": (rows, F.count_distinct("label") == 2)})
    assert {r.config_id for r in done.collect()} == {"a", "c"}
    assert {r.config_id for r in store.remaining(res.select("config_id"), done, ["config_id"]).collect()} == {"b", "d"}


def test_rejects(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, -1.0, None), (3, -1.0, "b")], SCHEMA)
    good, bad = store.split_rejects(df, {"no_name": F.col("s").isNull(), "negative": F.col("v") < 0})
    assert [r.id for r in good.collect()] == [1]
    assert {r.id: r.reason for r in bad.collect()} == {2: "no_name", 3: "negative"}


def test_checked_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (2, "q")], "k int, b string")
    assert joins.checked_join(a, b, ["k"]).count() == 3
    with pytest.raises(ValueError):
        joins.checked_join(a, b, ["k"], "one_to_one")
    with pytest.raises(ValueError):
        joins.checked_join(b, a, ["k"])
    with pytest.raises(ValueError):
        joins.lookup_label(a, b.where("k = 1"), ["k"], "b")
    with pytest.raises(ValueError):
        joins.select_assigned(a.withColumn("alpha", F.lit(1.0)), b.withColumn("alpha", F.lit(2.0)), "k")
    pool, rule = joins.select_disjoint(
        spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "series_id int, map_id int"), spark.createDataFrame([(1, 1)], "series_id int, map_id int"), 2
    )
    assert rule == "unit_disjoint" and {r.series_id for r in pool.collect()} == {2, 3}


def test_gates(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, float("nan")), ("c", 0, 1.0), ("c", 0, None)], "k string, label int, v double")
    assert {r.k for r in gates.label_pairs(df, ["k"], "label").collect()} == {"b", "c"}
    assert {r.k for r in gates.not_finite(df, ["k"], ["v"]).collect()} == {"b", "c"}
    assert {r.k for r in gates.varying(df, ["k"], ["v"]).collect()} == {"a"}
    assert gates.unexpected_count(df, 5).count() == 0 and gates.unexpected_count(df, 4).count() == 1
    with pytest.raises(ValueError):
        gates.dataset_gate(df, ["k", "v"], ["k"])
    stored = df.where("k = 'a'").withColumn("v", F.col("v") + 0.5)
    assert gates.drift(df.where("k = 'a'"), stored, ["k", "label"], ["v"], 0.4).count() == 2
    assert gates.drift(df.where("k = 'a'"), stored, ["k", "label"], ["v"], 0.6).count() == 0
