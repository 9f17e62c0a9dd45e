"""Runs, reads through layers, pruning, flush boundaries, recovery and the stream."""

import os

import pytest

from tidelog.operators import runs, state
from tidelog.sources import work
from tidelog.streaming.state import maintain, read_state

LOG = "idx long, op int, k string, v string"
RUN = "file_id long, k string, idx long, op int, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def probes(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "k string")


def test_newest_run_wins_and_tombstones(spark):
    r = spark.createDataFrame([(1, "key", 1, 0, "old"), (2, "key", 2, 0, "new"), (1, "only", 3, 0, "x"), (1, "gone", 4, 0, "y"), (2, "gone", 5, 1, "")], RUN)
    p = probes(spark, "key", "only", "gone", "none")
    assert rows(runs.get(r, p)) == [("gone", "tombstone", None), ("key", "value", "new"), ("none", "not_found", None), ("only", "value", "x")]
    assert ("gone", "value", "") in rows(runs.get_raw(r, p))
    assert rows(runs.compact(r)) == [("key", 2, "new"), ("only", 3, "x")]
    assert runs.next_file_id(r).first()[0] == 3 and runs.next_file_id(r.where("false")).first()[0] == 1


@pytest.mark.parametrize(("keys", "indexed"), [("abcde", "ace"), (["k", "k2", "key3", "k4"], ["k", "k4"]), ("a", "a")])
def test_sparse_index(spark, keys, indexed):
    r = spark.createDataFrame([(1, k, i, 0, "v") for i, k in enumerate(keys, 1)], RUN)
    got = [(x["k"], x["off"]) for x in runs.sparse_index(r).orderBy("off").collect()]
    assert [k for k, _ in got] == list(indexed) and got[0][1] == 0
    seek = {x["k"]: x["found"] for x in runs.sparse_seek(r, probes(spark, *keys, "zz")).collect()}
    assert all(seek[k] for k in keys) and "zz" not in seek


def test_pruning(spark):
    r = spark.createDataFrame([(1, "aaa", 1, 0, "v"), (1, "ccc", 2, 0, "v"), (2, "zzz", 3, 0, "v")], RUN)
    assert rows(runs.prune_by_range(runs.catalog(r), probes(spark, "aaa", "bbb", "x", "zzz"))) == [("aaa", 1), ("bbb", 1), ("x", 0), ("zzz", 1)]
    assert rows(runs.prune_by_bloom(r, probes(spark, "aaa", "bbb", "zzz"))) == [(1, "aaa"), (2, "zzz")]


def test_flush_boundaries_match_a_plain_fold(spark):
    records = [(s, i, f"k{(i * 7 + s) % 40}", "v" * (i % 23)) for s in range(3) for i in range(1, 400)]
    expected = {}
    for s in range(3):
        sizes, gen = {}, 1
        for _, i, k, v in [r for r in records if r[0] == s]:
            expected[s, i] = gen
            sizes[k] = len(k) + len(v) + 9
            if sum(sizes.values()) >= 500:
                sizes, gen = {}, gen + 1
    got = runs.flush_generations(spark.createDataFrame(records, "shard long, idx long, k string, v string"))
    assert {(r["shard"], r["idx"]): r["generation"] for r in got.collect()} == expected


def test_layers_recovery_and_stream_agree(spark, tmp_path):
    records = [(i, int(i % 5 == 0), f"k{(i * i) % 17}", "" if i % 5 == 0 else f"v{i}") for i in range(1, 200)]
    log = spark.createDataFrame(records, LOG)
    folded = rows(state.fold(log))
    keys = probes(spark, *{r[2] for r in records}, "none")
    assert rows(runs.get_layered(runs.layers(log, 20, 199), keys)) == rows(state.multi_get(state.fold(log), keys))
    done = runs.runs_by_stride(log.where("idx <= 160"), 20)
    assert rows(runs.recovered(done, log.where("idx > 160 and idx <= 180"), log.where("idx > 180"))) == folded
    src = str(tmp_path / "in")
    for low in (100, 0):  # the later half arrives first
        log.where(f"idx > {low} and idx <= {low + 100}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    assert maintain(stream, out) == 1
    assert rows(read_state(spark, out)) == folded


def test_stream_restarts(spark, tmp_path):
    """Restarts with and without new data go on where the stream ended; runs are merged in tiers, and what nothing names is deleted."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    records = [(i, int(i % 7 == 0), f"k{(i * i) % 23}", f"v{i}") for i in range(1, 131)]
    put = lambda low, high: spark.createDataFrame([r for r in records if low < r[0] <= high], LOG).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([], LOG).write.parquet(src)
    assert maintain(stream(), out, fan=3) <= 0 and read_state(spark, out).count() == 0
    seen = maintain(stream(), out, fan=3)
    for step in range(13):
        put(10 * step, 10 * step + 10)
        now = maintain(stream(), out, fan=3)
        assert now == seen + 1
        assert maintain(stream(), out, fan=3) == now  # nothing new
        seen = now
        assert rows(read_state(spark, out)) == rows(state.fold(spark.createDataFrame(records[: 10 * step + 10], LOG)))
    assert work.versions(spark, f"{out}/manifest") == [seen - 1, seen]
    assert len([p for p in os.listdir(f"{out}/runs") if not p.startswith(".")]) <= 9


def test_a_batch_that_ran_before_gives_the_same(spark, tmp_path):
    """The last batch's commit is lost after its manifest was published: it runs again, over its own manifest."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(src)
    for step in range(4):
        spark.createDataFrame([(step * 5 + i, 0, f"k{i}", f"v{step}") for i in range(1, 6)], LOG).coalesce(1).write.mode("append").parquet(src)
    last = maintain(stream(), out, fan=2)
    before = rows(read_state(spark, out))
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{out}/checkpoint/commits/{name}"):
            os.remove(f"{out}/checkpoint/commits/{name}")
    assert maintain(stream(), out, fan=2) == last and rows(read_state(spark, out)) == before
