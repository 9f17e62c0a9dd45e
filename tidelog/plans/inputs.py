"""Inputs that the registered queries derive from the given tables. The select lists are plain SQL that both engines read, so query and oracle start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources.tables import read

#: Records to a run in all run and pruning queries.
STRIDE = 50
#: Keys that hit the newest layer, old runs, tombstones, and nothing, inside and outside the key range.
PROBES = ("u0", "u1", "u7", "u13", "u42", "u77", "u99", "u101", "u120", "u149", "u15x", "u999", "a", "zz")

#: Replica s stands at (s * SPREAD) modulo the log's last index.
SPREAD = 7919

STATES = (
    "concat('s', cast(s_suppkey as string)) as node", "s_suppkey as s",
    "case s_suppkey % 3 when 0 then 'Leader' when 1 then 'Follower' else 'Candidate' end as role",
    "4 + s_suppkey % 9 as current_term", "case when s_suppkey % 4 = 0 then null else concat('s', cast(s_suppkey % 7 as string)) end as voted_for",
    "s_suppkey % 4 + s_suppkey % 2 as commit_index", "s_suppkey % 4 as last_applied", "s_suppkey % 4 as snapshot_last_index", "s_suppkey % 4 as snapshot_last_term",
)
#: Each of these is taken over states and a number j: (numbers, condition, select list).
LOG = ("1, 2, 3, 4, 5, 6", "j <= s % 6", ("node", "s % 4 + j as idx", "1 + (s % 4 + j) - (s % 4 + j) % 3 + s % 2 as term", "concat('SET k', cast(j as string), ' v', cast(s as string)) as command"))
PEERS = ("1, 2, 3, 4", "j <= s % 5", ("node", "concat('p', cast(j as string)) as peer", "1 + (s + j) % 6 as next_index", "(s * j) % 6 as match_index"))
REQUESTS = (
    "0, 1, 2, 3", "true",
    ("s * 10 + j as req_id", "node", "3 + (s + j) % 9 as term", "greatest(s % 4 + j - 1, 0) as prev_log_index",
     "1 + greatest(s % 4 + j - 1, 0) - greatest(s % 4 + j - 1, 0) % 3 + s % 2 + case when (s + j) % 5 = 0 then 1 else 0 end as prev_log_term",
     "(s + 2 * j) % 8 as leader_commit", "'lead' as leader_id", "(s + j) % 3 as n_entries"),
)
VOTES = ("0, 1, 2, 3, 4", "true", ("node as voter", "concat('s', cast(j as string)) as candidate", "3 + (s * 3 + j) % 10 as term", "(s + j) % 9 as last_log_index", "(s + 2 * j) % 9 as last_log_term"))
TALLY = ("1, 2, 3, 4", "j <= s % 5", ("node", "4 + s % 9 + case when (s + j) % 11 = 0 then 1 when (s + j) % 7 = 0 then -1 else 0 end as term", "(s * j) % 3 <> 0 as vote"))
REPLIES = ("1, 2, 3, 4", "j <= s % 5", ("node", "concat('p', cast(j as string)) as peer", "3 + (s + j) % 9 as term", "(s + j) % 2 = 0 as success", "(s + j) % 3 as entries_count"))
WRITES = ("1, 2", "true", ("s * 10 + j as client", "node", "concat('SET c', cast(j as string), ' w', cast(s as string)) as command"))
COMMANDS = "case o_orderkey % 6 when 0 then concat('SET k', cast(o_custkey as string), ' v', cast(o_orderkey as string)) when 1 then concat('  delete  k', cast(o_custkey as string)) when 2 then 'set k' when 3 then '' when 4 then concat('get k', cast(o_custkey as string)) else concat('Set k', cast(o_custkey as string), ' two words') end"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, role, terms and indices): a node for each supplier."""
    return read(spark, sf_dir, "supplier").selectExpr(*STATES)


def over(st: DataFrame, spec: tuple) -> DataFrame:
    """The rows of one of the specs above."""
    numbers, where, columns = spec
    return st.selectExpr("*", f"explode(array({numbers})) as _j").selectExpr("*", "cast(_j as bigint) as j").where(where).selectExpr(*columns)


def entries(requests: DataFrame) -> DataFrame:
    """(req_id, pos, term, command): the new entries of the append requests."""
    return requests.selectExpr("*", "explode(array(0, 1)) as _p").selectExpr("*", "cast(_p as bigint) as pos").where("pos < n_entries").selectExpr("req_id", "pos", "term", "concat('new', cast(pos as string)) as command")


def probes(spark: SparkSession) -> DataFrame:
    """(k): PROBES."""
    return spark.createDataFrame([(k,) for k in PROBES], "k string")
