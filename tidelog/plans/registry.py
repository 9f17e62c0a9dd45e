"""The registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import bloom, codec, grammar
from tidelog.operators import raft, runs, state
from tidelog.plans import inputs, oracle
from tidelog.sources import log_store, work
from tidelog.sources.tables import log_of, read
from tidelog.streaming.state import state_by_stream


def _on_log(f):
    return lambda spark, d: f(log_of(spark, d))


def _on_runs(f):
    return lambda spark, d: f(runs.runs_by_stride(log_of(spark, d), inputs.STRIDE))


def _probed(f):
    """A query of runs and probes."""
    return lambda spark, d: f(runs.runs_by_stride(log_of(spark, d), inputs.STRIDE), inputs.probes(spark))


def _seen(f):
    """A query of runs and probes that only needs the probed keys' records."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        probes = inputs.probes(spark)
        return f(runs.runs_by_stride(state.of_keys(log_of(spark, d), probes), inputs.STRIDE), probes)

    return run


def _held(f):
    """A query of the probed keys' state and the probes."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        probes = inputs.probes(spark)
        return f(state.fold(state.of_keys(log_of(spark, d), probes)), probes)

    return run


def _raft(f):
    """A query of states and the specs named by f's parameters."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        st = inputs.states(spark, d)
        return f(st, inputs.over(st, inputs.LOG), lambda spec: inputs.over(st, spec))

    return run


def _last(log: DataFrame) -> int:
    """The log's last index, one row."""
    return int(log.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0])


def _wal_append_union(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    return log_store.union_batches(log.where("idx % 2 = 1"), log.where("idx % 2 = 0"))


def _wal_unflushed(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    top = (_last(log) - 1) // inputs.STRIDE + 1
    done = runs.runs_by_stride(log, inputs.STRIDE).where(F.col("file_id") <= top - 2)
    return log_store.unflushed(log_store.with_generation(log, inputs.STRIDE), done).select("generation", "idx", "op", "k", "v")


def _json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    st = inputs.states(spark, d)
    entries = inputs.over(st, inputs.LOG).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("idx", "term", "command"))).alias("e"))
    full = st.join(entries, "node", "left").withColumn("entries", F.transform(F.coalesce("e", F.array().cast("array<struct<idx:long,term:long,command:string>>")), lambda x: F.struct(x["term"].alias("term"), x["command"].alias("command"))))
    back = log_store.state_from_json(log_store.state_to_json(full))
    return back.select("node", "current_term", "voted_for", F.size("entries").cast("long").alias("n_entries"), F.aggregate("entries", F.lit(0).cast("long"), lambda a, x: a + x["term"]).alias("sum_term"), "commit_index", "snapshot_last_index", "snapshot_last_term")


def _codec_decode(log: DataFrame) -> DataFrame:
    """Every seventh record loses its last byte and its prefix is mended, and every next one all but two bytes."""
    x = log.where("op = 0").withColumn("b", codec.encode(F.col("idx"), F.col("op"), F.col("k"), F.col("v")))
    cut = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("b") - 5), 8, "0")), F.substring("b", F.lit(5), F.octet_length("b") - 5))
    x = x.select(codec.decode(F.when(F.col("idx") % 7 == 0, cut).when(F.col("idx") % 7 == 1, F.substring("b", 1, 2)).otherwise(F.col("b"))).alias("x"))
    return x.select("x.status", F.col("x.idx").cast("long").alias("idx"), "x.op", codec.as_text(F.col("x.k")).alias("k"), codec.as_text(F.col("x.v")).alias("v"), "x.consumed")


def _codec_decode_stream(log: DataFrame, segment: int = 65_536) -> DataFrame:
    """A stream for each key, of its encoded records in order, in segments of the log's indices."""
    seg = F.expr(f"idx div {segment}")
    parts = log.groupBy(F.col("k").alias("stream_id"), seg.alias("seg")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("idx", codec.encode_hex(F.col("idx"), F.col("op"), F.col("k"), F.col("v")).alias("h")))).alias("x"))
    earlier = Window.partitionBy("stream_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    data = F.unhex(F.concat_ws("", F.transform("x", lambda e: e["h"])))
    out = codec.decode_streams(parts.select("stream_id", data.alias("data"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")))
    return out.select("stream_id", "status", F.col("pos").cast("int").alias("pos"), F.col("idx").cast("long").alias("idx"), "op", codec.as_text(F.col("k")).alias("k"), codec.as_text(F.col("v")).alias("v"))


def _value_utf8(log: DataFrame) -> DataFrame:
    """Every seventh value is not UTF-8; it reads as none."""
    raw = F.when(F.col("idx") % 7 == 0, F.unhex(F.concat(F.lit("FF"), F.hex(F.encode("v", "utf-8"))))).otherwise(F.encode("v", "utf-8"))
    return log.select("idx", F.try_validate_utf8(raw.cast("string")).alias("v"))


def _cmd_parse(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{inputs.COMMANDS} as command").select("o_orderkey", grammar.parse(F.col("command")).alias("x")).select("o_orderkey", "x.*")


def _get_layered(spark: SparkSession, d: str) -> DataFrame:
    log, probes = log_of(spark, d), inputs.probes(spark)
    return runs.get_layered(runs.layers(state.of_keys(log, probes), inputs.STRIDE, _last(log)), probes)


def _stored_get(spark: SparkSession, d: str) -> DataFrame:
    """Point reads of runs in storage, through their published catalog."""
    at = work.new_folder(spark, "runs")
    log_store.write_runs(runs.runs_by_stride(log_of(spark, d), inputs.STRIDE * 100), f"{at}/runs")
    everything = spark.read.schema(log_store.RUN_SCHEMA).parquet(f"{at}/runs")
    log_store.save_catalog(runs.catalog(everything), f"{at}/catalog")
    cat = log_store.load_catalog(spark, f"{at}/catalog")
    return runs.get_stored(log_store.read_runs(spark, f"{at}/runs", cat), cat, inputs.PROBES)


def _recover(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    top = (_last(log) - 1) // inputs.STRIDE + 1
    gen = log_store.with_generation(log, inputs.STRIDE)
    done = runs.runs_by_stride(log, inputs.STRIDE).where(F.col("file_id") <= top - 2)
    return runs.recovered(done, gen.where(F.col("generation") == top - 1), gen.where(F.col("generation") == top))


def _state_diff(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    return state.diff(state.as_of(log, _last(log) // 2), state.fold(log))


def _stale(spark: SparkSession, d: str) -> DataFrame:
    log = log_of(spark, d)
    replicas = inputs.states(spark, d).select("node", (F.col("s") * inputs.SPREAD % _last(log)).alias("last_applied"))
    return state.stale_get(log, replicas)


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    beats = read(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    return state.heartbeat_gaps(beats, 300_000_000)


def _tally(st: DataFrame, log: DataFrame, over) -> DataFrame:
    return raft.vote_tally(st.selectExpr("node", "current_term", "s % 5 as n_peers"), over(inputs.TALLY))


def _truncate(st: DataFrame, log: DataFrame, over) -> DataFrame:
    req = over(inputs.REQUESTS)
    return raft.append_truncate(req, inputs.entries(req), st, log)


def _acks(st: DataFrame, log: DataFrame, over) -> DataFrame:
    """Each node waits for all entries of its log; every fifth was taken in an earlier term, so it is never acknowledged."""
    pending = log.join(st.select("node", "s"), "node").select((F.col("s") * 100 + F.col("idx")).alias("client"), "node", "idx", (F.col("term") - F.when((F.col("s") + F.col("idx")) % 5 == 0, 1).otherwise(0)).alias("term"))
    return raft.ack_join(pending, raft.apply_range(st, log))


QUERIES = {
    "wal_append_union": _wal_append_union,
    "wal_scan": _on_log(lambda m: m.orderBy("idx")),
    "wal_generations": _on_log(lambda m: log_store.with_generation(m, inputs.STRIDE).groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))),
    "wal_unflushed": _wal_unflushed,
    "sst_runs": _on_runs(lambda r: r),
    "sst_catalog": _on_runs(lambda r: log_store.catalog_roundtrip(runs.catalog(r))),
    "sst_meta": _on_runs(runs.catalog),
    "sst_next_id": _on_runs(runs.next_file_id),
    "state_json_roundtrip": _json_roundtrip,
    "codec_encode": _on_log(lambda m: m.select("idx", codec.encode_hex(F.col("idx"), F.col("op"), F.col("k"), F.col("v")).alias("record"))),
    "codec_decode": _on_log(_codec_decode),
    "codec_decode_stream": _on_log(_codec_decode_stream),
    "bloom_positions": lambda spark, d: bloom.probe_rows(inputs.probes(spark)),
    "bloom_build": _on_runs(bloom.build),
    "cmd_parse": _cmd_parse,
    "cmd_format": _on_log(lambda m: m.where("op = 0").select("idx", grammar.format_set(F.col("k"), F.col("v")).alias("command"))),
    "prune_minmax": _probed(lambda r, p: runs.prune_by_range(runs.catalog(r), p)),
    "prune_bloom": _probed(runs.prune_by_bloom),
    "sparse_index": _on_runs(runs.sparse_index),
    "sparse_seek": _probed(runs.sparse_seek),
    "value_utf8": _on_log(_value_utf8),
    "rpc_get": _held(state.rpc_get),
    "kv_get_mem": _on_log(lambda m: state.fold(m.where("k = 'u42'"))),
    "kv_multi_get": _held(state.multi_get),
    "kv_get_sst": _seen(runs.get),
    "kv_get_sst_raw": _seen(runs.get_raw),
    "sst_stored_get": _stored_get,
    "kv_get_layered": _get_layered,
    "kv_state": _on_log(state.fold),
    "kv_live": _on_log(state.live),
    "kv_tombstones": _on_log(state.tombstones),
    "kv_as_of": _on_log(lambda m: state.as_of(m, 500)),
    "kv_get_stale": _stale,
    "kv_history": _on_log(state.history),
    "kv_range_scan": _on_log(lambda m: state.range_scan(state.fold(m), "u1", "u4")),
    "kv_prefix_scan": _on_log(lambda m: state.prefix_scan(state.fold(m), "u1")),
    "state_diff": _state_diff,
    "replay_idempotent": _on_log(lambda m: state.fold(m.unionByName(m))),
    "recover_state": _recover,
    "kv_state_stream": state_by_stream,
    "mem_size": _on_log(state.size),
    "mem_running_size": _on_log(state.running_size),
    "mem_sorted": _on_log(state.sorted_entries),
    "flush_generations": _on_log(lambda m: runs.flush_generations(m.withColumn("shard", (F.col("idx") - 1) % 4))),
    "compact_runs": _on_runs(runs.compact),
    "leader_gaps": _gaps,
    "raft_last_log": _raft(lambda st, log, over: raft.last_log(st, log).select("node", "last_index", "last_term")),
    "raft_log_match": _raft(lambda st, log, over: raft.log_match(over(inputs.REQUESTS), st, log)),
    "raft_append_decision": _raft(lambda st, log, over: raft.append_decision(over(inputs.REQUESTS), st, log)),
    "raft_append_truncate": _raft(_truncate),
    "raft_ack_join": _raft(_acks),
    "raft_commit_index": _raft(lambda st, log, over: raft.commit_index(st, log, over(inputs.PEERS))),
    "raft_majority": lambda spark, d: read(spark, d, "supplier").select("s_suppkey", raft.majority(F.col("s_suppkey") % 6 + 1, F.col("s_suppkey") % 5).alias("majority")),
    "raft_vote_tally": _raft(_tally),
    "raft_apply_range": _raft(lambda st, log, over: raft.apply_range(st, log)),
    "raft_compacted_log": _raft(lambda st, log, over: raft.compacted_log(st, log)),
    "raft_fanout": _raft(lambda st, log, over: raft.fanout(over(inputs.WRITES), st, log, over(inputs.PEERS))),
    "raft_write_route": _raft(lambda st, log, over: raft.write_route(over(inputs.WRITES), st)),
    "raft_reply_progress": _raft(lambda st, log, over: raft.reply_progress(over(inputs.REPLIES), st, log, over(inputs.PEERS))),
    "raft_heartbeat": _raft(lambda st, log, over: raft.heartbeats(st, log, over(inputs.PEERS))),
    "raft_election_start": _raft(lambda st, log, over: raft.election_start(st, log, over(inputs.PEERS))),
    "raft_leader_init": _raft(lambda st, log, over: raft.leader_init(st, log, over(inputs.PEERS))),
    "raft_vote_decision": _raft(lambda st, log, over: raft.vote_decision(over(inputs.VOTES), st, log)),
    "raft_stuck_followers": _raft(lambda st, log, over: raft.stuck_followers(st, over(inputs.PEERS))),
}


def queries() -> dict:
    """Name to callable(spark, sf_dir)."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
