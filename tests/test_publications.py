"""Publications, tables stored by key and the incremental refresh: what a broken
job leaves, what a refresh touches, and whole results."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from learnlens.operators import quality as Q
from learnlens.operators.features import pair_features
from learnlens.operators.panels import format_usage, weekly_activity
from learnlens.plans import refresh
from learnlens.schemas import SCHEMAS
from learnlens.session import scratch_path
from learnlens.sources import keyed, publications, readers
from learnlens.sources.writers import latest_by_key


def local(path: str) -> str:
    return path.removeprefix("file:")


def files(path: str) -> dict[str, float]:
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
        for d, _, names in os.walk(local(path)) for f in names if f.endswith(".parquet")
    }


# --- publications ------------------------------------------------------------


def test_a_job_that_dies_before_the_switch_leaves_the_old_rows(spark, micro, monkeypatch):
    uri = scratch_path(spark, "publication")
    publications.publish_files(micro.scores, uri)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(publications, "switch", killed)
    with pytest.raises(KeyboardInterrupt):
        publications.publish_files(micro.scores.limit(1), uri)
    monkeypatch.undo()
    read = lambda: sorted(readers.read_csv(spark, uri, SCHEMAS["scores"]).collect())
    assert read() == sorted(micro.scores.collect())
    # So does one whose task fails while the files are written.
    with pytest.raises(Exception, match="broken"):
        publications.publish_files(micro.scores.withColumn("final_score", F.raise_error(F.lit("broken")).cast("double")), uri)
    assert read() == sorted(micro.scores.collect())
    # What they left goes when it is old enough, and nothing else.
    assert publications.sweep(spark, uri) == []
    assert len(publications.sweep(spark, uri, older_than=-60)) == 2
    assert read() == sorted(micro.scores.collect())


def test_readers_of_the_version_before_keep_their_files(spark):
    uri = scratch_path(spark, "publication")
    opened = []
    for n in (1, 2, 3):
        publications.publish_files(spark.range(n), uri, "parquet")
        opened.append(spark.read.parquet(publications.published_path(spark, uri)))
    assert len(publications.versions(spark, uri)) == 2
    assert opened[2].count() == 3 and opened[1].count() == 2
    assert len(os.listdir(local(uri) + "/_versions")) == 2


def test_a_folder_of_plain_files_becomes_a_publication(spark, tmp_path):
    uri = str(tmp_path / "plain")
    spark.range(5).write.parquet(uri)
    assert publications.published_path(spark, uri) == uri
    publications.publish_files(spark.range(3), uri, "parquet")
    assert set(os.listdir(uri)) == {"_versions", "_published"}
    assert spark.read.parquet(publications.published_path(spark, uri)).count() == 3
    for other in ("missing", "a.csv", "*.csv"):
        (tmp_path / "a.csv").write_text("x\n1\n")
        assert publications.published_path(spark, str(tmp_path / other)) == str(tmp_path / other)


def test_two_publishers_at_once(spark, tmp_path):
    uri = str(tmp_path / "both")
    a, b = publications.new_version(uri), publications.new_version(uri)
    for version, n in ((a, 1), (b, 2)):
        spark.range(n).write.parquet(version)
    publications.switch(spark, uri, a)
    publications.switch(spark, uri, b)
    assert publications.published_path(spark, uri) == b and publications.versions(spark, uri)[0] == a


# --- tables stored by key ----------------------------------------------------


def test_upsert_touches_only_the_partitions_of_its_keys(spark):
    path = scratch_path(spark, "keyed")
    base = spark.range(2_000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(0).alias("n"))
    keyed.write_keyed(base, path, ["k"], parts=32)
    before = files(path)
    batch = spark.createDataFrame([(5, "a", 1, 1), (5, "b", 2, 2), (7, "c", 3, 1), (9_999, "d", 4, 1)], "k int, v string, n int, seq int")
    out = keyed.upsert_keyed(spark, path, batch, ["k"], ["seq"], parts=32)
    after = files(path)
    touched = {f.split("key_part=")[1].split("/")[0] for f in set(before) ^ set(after)}
    assert 1 <= len(touched) <= 3
    assert {f: t for f, t in before.items() if f.split("key_part=")[1].split("/")[0] not in touched}.items() <= after.items()
    rows = {r.k: (r.v, r.n) for r in out.collect()}
    assert len(rows) == out.count() == 2_001
    assert rows[5] == ("b", 2) and rows[7] == ("c", 3) and rows[9_999] == ("d", 4) and rows[6] == ("old", 0)
    assert out.dtypes == base.dtypes


def test_upsert_of_nothing_of_null_keys_and_of_a_hot_key(spark):
    path = scratch_path(spark, "keyed")
    schema = "k string, v int"
    keyed.write_keyed(spark.createDataFrame([("a", 1), (None, 2)], schema), path, ["k"], parts=4)
    before = files(path)
    keyed.upsert_keyed(spark, path, spark.createDataFrame([], schema), ["k"], parts=4)
    assert files(path) == before
    hot = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").cast("int").alias("v"))
    out = keyed.upsert_keyed(spark, path, hot, ["k"], parts=4)
    assert out.where("k = 'a'").collect()[0].v == 9_999
    out = keyed.upsert_keyed(spark, path, spark.createDataFrame([(None, 5)], schema), ["k"], parts=4)
    assert sorted(r.v for r in out.where("k is null").collect()) == [2, 5]
    assert out.count() == 1 + 2 + 6_666


def test_keys_hash_alike_as_ints_and_longs(spark):
    df = spark.range(50).select(F.col("id"), F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("s"))
    parts = [keyed.key_part([c], 8) for c in ("id", "i", "s")]
    assert df.where((parts[0] != parts[1]) | (parts[1] != parts[2])).count() == 0


# --- incremental refresh -----------------------------------------------------


@pytest.mark.parametrize("cut", ["2026-04-02", "2026-04-06", "2030-01-01"])
def test_refreshed_panels_equal_those_of_all_events(spark, micro, cut):
    uri = scratch_path(spark, "states")
    day = F.col("event_date")
    more = micro.events.unionByName(micro.events.where("event_id = 'E1'").selectExpr(
        "'E9' as event_id", "student_id", "course_id", "null as resource_id", "event_date", "null as duration_minutes",
        "null as progress_percent", "completed", "device",
    ))
    for batch, events in (("a", more.where(day < cut)), ("b", more.where(day >= cut)), ("b", more)):
        refresh.add_events(spark, uri, events, batch)
    assert refresh.batches(spark, uri) == ["a", "b"]
    state = refresh.states(spark, uri)
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(pair_features(more), refresh.pair_features(state["resources"]))
    assert same(format_usage(more, micro.resources), refresh.format_usage(state["resources"], micro.resources))
    assert same(weekly_activity(more), refresh.weekly_activity(state["weeks"]))


def test_a_refresh_reads_the_batch_and_the_states_alone(spark, micro, tmp_path, monkeypatch):
    uri = scratch_path(spark, "states")
    for n in (1, 2):
        micro.events.where(F.col("event_id").isin(f"E{n}")).write.parquet(str(tmp_path / f"batch{n}"))
    refresh.add_events(spark, uri, spark.read.parquet(str(tmp_path / "batch1")), "1")
    second = spark.read.parquet(str(tmp_path / "batch2"))
    current = publications.published_path(spark, uri)
    merged = refresh.merge_states("resources", [spark.read.parquet(f"{current}/resources"), refresh.event_states(second)["resources"]])
    assert not any("batch1" in f for f in merged.inputFiles()) and any("batch2" in f for f in merged.inputFiles())
    # A refresh that dies before the switch changes nothing, and can be run again.
    monkeypatch.setattr(refresh, "switch", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        refresh.add_events(spark, uri, second, "2")
    monkeypatch.undo()
    assert refresh.batches(spark, uri) == ["1"]
    assert refresh.add_events(spark, uri, second, "2") and not refresh.add_events(spark, uri, second, "2")
    assert refresh.states(spark, uri)["resources"].count() == 2


# --- offending rows ----------------------------------------------------------


def test_rows_are_tagged_with_every_rule_they_break(spark):
    schema = "doc_id long, name string, n double, day string, `_note.x` int"
    rows = [(1, "ok", 1.0, "2026-01-01", 1), (2, None, 1.5, "2026-02-30", 2), (3, "far too long", 300.0, None, 3), (4, "ok", float("nan"), "2026-01-01", 4)]
    declared = {"doc_id": ("int",), "name": ("varchar", 5), "n": ("tinyint",), "day": ("date",), "absent": ("int",)}
    df = spark.createDataFrame(rows, schema)
    tagged = {r.doc_id: sorted((b.rule, b.columns, b.value) for b in r._broken) for r in Q.offending_rows(df, "t", declared).collect()}
    assert tagged == {
        2: [("date", "day", "2026-02-30"), ("not_null", "name", None), ("tinyint", "n", "1.5")],
        3: [("not_null", "day", None), ("tinyint", "n", "300.0"), ("varchar", "name", "far too long")],
        4: [("tinyint", "n", "NaN")],
    }
    assert Q.offending_rows(df, "t", declared).columns == [*df.columns, "_broken"]
    assert [r.doc_id for r in Q.clean_rows(df, "t", declared).collect()] == [1]
    cells = Q.offending_cells(df, "t", ["doc_id"], declared)
    assert cells.count() == 7 and {r.key for r in cells.collect()} == {"2", "3", "4"}
    counts = {(r.rule, r.columns): r.violations for r in Q.row_checks(df, "t", declared).where("violations > 0").collect()}
    assert counts == {(r.rule, r.columns): r["n"] for r in cells.groupBy("rule", "columns").agg(F.count("*").alias("n")).collect()}
    assert Q.offending_rows(spark.createDataFrame([], schema), "t", declared).collect() == []
    assert Q.offending_rows(df, "t", {}).collect() == []


def test_offending_rows_are_written_by_rule(spark, tmp_path):
    (tmp_path / "courses.csv").mkdir()
    lines = ["course_id,course_name,category,tag,difficulty,hours", "C1,a,k,t,d,4", "C2,a,k,t,d,four", "C3,a,k,,d,5", "C4,a,k,t,d,5,extra", "C5,,k,t,d,x"]
    (tmp_path / "courses.csv" / "part.csv").write_text("\n".join(lines) + "\n")
    text = readers.read_fs_csv(spark, str(tmp_path), "courses", as_text=True, keep_corrupt=True)
    out = Q.write_offending({"courses": text}, str(tmp_path / "out"))
    rows = spark.read.parquet(publications.published_path(spark, out["courses"]))
    found = sorted((r._rule, r._column, r.course_id) for r in rows.collect())
    assert found == [("corrupt", "_corrupt_record", "C4"), ("int", "hours", "C2"), ("int", "hours", "C5"), ("not_null", "course_name", "C5"), ("not_null", "tag", "C3")]
    assert rows.where("_rule = 'corrupt'").first()._corrupt_record == "C4,a,k,t,d,5,extra"
    plan = rows.where("_rule = 'int'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_rule" in plan


def test_latest_by_key_feeds_a_stored_table_once(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, v int")
    path = keyed.write_keyed(latest_by_key(df, ["k"], ["v"]), scratch_path(spark, "once"), ["k"], parts=2)
    assert sorted(map(tuple, keyed.read_keyed(spark, path).collect())) == [(1, 2), (2, 3)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        keyed.write_keyed(df, path, ["k"])
