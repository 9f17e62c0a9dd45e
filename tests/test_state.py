"""The state's cases as small literal logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import ordering
from tidelog.operators import runs, state
from tidelog.sources import log_store, work

LOG = "idx long, op int, k string, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("records", "expected"), [
    ([(1, 0, "k", "v1"), (2, 0, "k", "v2")], ("value", "v2")),
    ([(1, 0, "k", "v"), (2, 1, "k", "")], ("tombstone", None)),
    ([(1, 1, "k", "")], ("tombstone", None)),
    ([(1, 0, "k", "v"), (2, 1, "k", ""), (3, 1, "k", "")], ("tombstone", None)),
    ([(1, 0, "k", "v1"), (2, 1, "k", ""), (3, 0, "k", "v2")], ("value", "v2")),
    ([], ("not_found", None)),
])
def test_last_record_decides(spark, records, expected):
    log = spark.createDataFrame(records, LOG)
    got = state.multi_get(state.fold(log), spark.createDataFrame([("k",)], "k string"))
    assert rows(got) == [("k", *expected)]
    assert rows(state.fold(log)) == rows(state.fold(log.unionByName(log)))


def test_sizes(spark):
    log = spark.createDataFrame([(1, 0, "key", "small"), (2, 0, "key", "a_much_larger_value"), (3, 0, "key", "x"), (4, 0, "key", "some_value"), (5, 1, "key", "")], LOG)
    assert [r[1] for r in rows(state.running_size(log))] == [17, 31, 13, 22, 12]
    two = spark.createDataFrame([(1, 0, "key1", "value1"), (2, 0, "key2", "value2")], LOG)
    assert state.size(two).first()["size_in_bytes"] == 38


def test_byte_order(spark):
    log = spark.createDataFrame([(i, 0, k, "") for i, k in enumerate(["c", "ba", "b", "bb", "é", "z"], 1)], LOG)
    assert [r[1] for r in rows(state.sorted_entries(log))] == ["b", "ba", "bb", "c", "z", "é"]
    many = spark.createDataFrame([(i, 0, f"user:{(i * 37) % 2000:05d}", "") for i in range(1, 2001)], LOG)
    assert [r[:2] for r in rows(state.sorted_entries(many))] == [(i + 1, f"user:{i:05d}") for i in range(2000)]


def test_as_of_and_diff(spark):
    log = spark.createDataFrame([(1, 0, "a", "1"), (2, 0, "b", "1"), (3, 1, "a", ""), (4, 0, "c", "2"), (5, 0, "b", "3")], LOG)
    assert rows(state.as_of(log, 2).select("k", "v")) == [("a", "1"), ("b", "1")]
    assert rows(state.as_of(log, 5)) == rows(state.fold(log))
    assert rows(state.diff(state.as_of(log, 2), state.fold(log))) == [("a", "removed", "1", None), ("b", "changed", "1", "3"), ("c", "added", None, "2")]


def test_log_in_storage(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log_store.scan(spark, path).count() == 0
    assert log_store.rotate(spark, path) == 1
    log_store.append(spark.createDataFrame([(1, 0, "a", "1")], LOG), path, 1)
    log_store.append(spark.createDataFrame([(2, 1, "a", "")], LOG), path, 1)
    assert log_store.rotate(spark, path) == 2
    log_store.append(spark.createDataFrame([(3, 0, "b", "2")], LOG), path, 2)
    assert rows(log_store.scan(spark, path, 1).select("idx")) == [(1,), (2,)]
    assert rows(state.live(log_store.scan(spark, path))) == [("b", 3, "2")]


def test_catalog_in_storage(spark, tmp_path):
    assert log_store.load_catalog(spark, str(tmp_path / "none")).count() == 0
    cat = spark.createDataFrame([(1, "a", "c", 50, 2), (2, "b", "d", 60, 3)], log_store.CATALOG_SCHEMA)
    log_store.save_catalog(cat, str(tmp_path / "cat"))
    assert rows(log_store.load_catalog(spark, str(tmp_path / "cat"))) == rows(cat)
    (tmp_path / "bad").write_text("{not json")
    assert log_store.load_catalog(spark, str(tmp_path / "bad")).count() == 0


def test_catalog_is_published_in_one_step(spark, tmp_path, monkeypatch):
    """A save that dies before its rename leaves the version before; old versions go."""
    path = str(tmp_path / "cat")
    one = spark.createDataFrame([(1, "a", "c", 50, 2)], log_store.CATALOG_SCHEMA)
    two = one.withColumn("file_id", F.lit(2).cast("long"))
    assert log_store.save_catalog(one, path) == 0

    def dies(folder):
        two.write.json(folder)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        work.publish(spark, path, dies)
    assert rows(log_store.load_catalog(spark, path)) == rows(one)
    # a catalog may be made from the one that it replaces
    assert log_store.save_catalog(log_store.load_catalog(spark, path).unionByName(two), path) == 1
    assert rows(log_store.load_catalog(spark, path)) == rows(one.unionByName(two))
    assert log_store.save_catalog(two, path) == 2 and work.versions(spark, path) == [1, 2]


def test_stored_runs_are_seen_through_the_catalog(spark, tmp_path):
    at = str(tmp_path / "runs")
    run = lambda f, k, v: spark.createDataFrame([(f, k, f, 0, v), (f, k + "z", f, 1, "")], "file_id long, k string, idx long, op int, v string")
    for f, k, v in ((1, "a", "old"), (2, "a", "new"), (3, "q", "x")):
        log_store.write_runs(run(f, k, v), at)
    log_store.save_catalog(runs.catalog(spark.read.schema(log_store.RUN_SCHEMA).parquet(at).where("file_id < 3")), str(tmp_path / "cat"))
    cat = log_store.load_catalog(spark, str(tmp_path / "cat"))
    seen = log_store.read_runs(spark, at, cat)
    assert {r["file_id"] for r in seen.collect()} == {1, 2}
    got = runs.get_stored(seen, cat, ("a", "az", "q"))
    assert rows(got) == [("a", "value", "new"), ("az", "tombstone", None), ("q", "not_found", None)]
    plan = got._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "In(k, [a,az,q])" in plan
    log_store.write_runs(run(2, "a", "newer"), at)
    assert rows(runs.get_stored(log_store.read_runs(spark, at, cat), cat, ("a",))) == [("a", "value", "newer")]


def test_node_state_json(spark):
    lines = spark.createDataFrame([("n1", '{"current_term": 3, "entries": [{"term": 1, "command": "set a b"}], "commit_index": 1}'), ("n2", None)], "node string, state string")
    got = {r["node"]: r for r in log_store.state_from_json(lines).collect()}
    assert got["n1"]["current_term"] == 3 and got["n1"]["voted_for"] is None and got["n1"]["entries"][0]["command"] == "set a b"
    assert got["n2"]["current_term"] == 0 and got["n2"]["entries"] == []


@pytest.mark.parametrize("state", ["{not json", "", "[]", "17", '{"current_term": 3, "entries": [', '{"current_term": "x", "entries": [], "commit_index": 0}', '{"entries": [], "commit_index": 0}'])
def test_corrupt_node_state_is_an_error(spark, state):
    lines = spark.createDataFrame([("n0", None), ("n1", state)], "node string, state string")
    with pytest.raises(Exception, match="corrupt state of node n1"):
        log_store.state_from_json(lines).collect()


def test_replicas_behind_the_log(spark):
    rng = random.Random(2)
    log = [(i, int(rng.random() < 0.2), f"k{rng.randrange(15)}", f"v{i}") for i in range(1, 301)]
    replicas = [(f"r{j}", rng.randrange(0, 320)) for j in range(40)] + [("same", 17), ("same2", 17), ("none", 0)]
    want = []
    for node, last in replicas:
        held = {k: (i, o, v) for i, o, k, v in log if i <= last}
        want += [(node, k, *x) for k, x in held.items()]
    got = state.stale_get(spark.createDataFrame(log, LOG), spark.createDataFrame(replicas, "node string, last_applied long"))
    assert rows(got) == sorted(want)


def test_what_replicas_see_is_not_sent_through_the_driver(spark):
    log = [(i, 0, f"k{i % 15}", f"v{i}") for i in range(1, 301)]
    replicas = [(f"r{j:03d}", j % 7 and j) for j in range(320)] + [(f"e{j:03d}", 300) for j in range(90)] + [("r001", None)]
    want = sorted((node, *x) for node, last in replicas if last for x in {k: (k, i, o, v) for i, o, k, v in log if i <= last}.values())
    for block in (1, 4, 32, 1000):
        got = state.stale_get(spark.createDataFrame(log, LOG), spark.createDataFrame(replicas, "node string, last_applied long"), block)
        assert rows(got) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        repeated = plan[: plan.index("Generate")]
        assert "BroadcastExchange" not in repeated and "SortMergeJoin" in repeated


def test_versions_across_chunks(spark):
    rng = random.Random(4)
    log = spark.createDataFrame([(i, 0, rng.choice(["hot", "hot", "hot", "a", "b"]), f"v{i}") for i in range(1, 200)], LOG)
    cut = lambda n: rows(ordering.versions(log, "k", "idx", F.col("v"), n).select("idx", "k", "version", "before"))
    assert cut(7) == cut(1000)
    assert [r[2] for r in cut(7) if r[1] == "hot"] == list(range(1, 1 + sum(r[1] == "hot" for r in cut(7))))


def test_work_folders_are_shared_or_local_mode(spark, monkeypatch):
    assert work.new_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Cluster()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work.shared_dir(Session())


def test_pushdown_of_point_get(spark, tmp_path):
    path = str(tmp_path / "state")
    state.fold(spark.createDataFrame([(1, 0, "a", "1")], LOG)).write.parquet(path)
    plan = spark.read.parquet(path).where(F.col("k") == "a").select("v")._jdf.queryExecution().toString()
    assert "EqualTo(k,a)" in plan and "ReadSchema: struct<k:string,v:string>" in plan
