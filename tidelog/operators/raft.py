"""The decision rules of a replicated log, as joins and projections over tables of node states, logs, requests and replies.

Tables: states (node, role, current_term, voted_for, commit_index, last_applied, snapshot_last_index, snapshot_last_term);
log (node, idx, term, command); peers (node, peer, next_index, match_index). Everything joins on the node, so a cluster's rows stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority(count: Column, peers: Column) -> Column:
    """Whether count is a majority of a node and its peers."""
    return count > F.ceil(peers / F.lit(2))


def last_log(states: DataFrame, log: DataFrame) -> DataFrame:
    """states with last_index and last_term: the log's last entry, or the snapshot where the log is empty."""
    last = log.groupBy("node").agg(F.max_by(F.struct("idx", "term"), "idx").alias("_l"))
    x = states.join(last, "node", "left")
    return x.withColumns({"last_index": F.coalesce("_l.idx", "snapshot_last_index"), "last_term": F.coalesce("_l.term", "snapshot_last_term")}).drop("_l")


def with_term_at(rows: DataFrame, states: DataFrame, log: DataFrame, index: str, into: str) -> DataFrame:
    """rows (with node) and the term of the entry at rows.index: the snapshot's at its end, 0 where there is no such entry."""
    snap = states.select("node", F.col("snapshot_last_index").alias("_si"), F.col("snapshot_last_term").alias("_st"))
    entry = log.select("node", F.col("idx").alias(index), F.col("term").alias("_t"))
    x = rows.join(snap, "node").join(entry, ["node", index], "left")
    return x.withColumn(into, F.when(F.col(index) == F.col("_si"), F.col("_st")).when(F.col(index) > F.col("_si"), F.coalesce("_t", F.lit(0))).otherwise(0).cast("long")).drop("_si", "_st", "_t")


def log_match(requests: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """(req_id, node, matches): whether the entry at prev_log_index has prev_log_term; 0 always matches, an index past the end never."""
    x = with_term_at(requests, states, log, "prev_log_index", "_at")
    last = last_log(states, log).select("node", "last_index")
    ok = (F.col("prev_log_index") <= F.col("last_index")) & ((F.col("prev_log_index") == 0) | (F.col("_at") == F.col("prev_log_term")))
    return x.join(last, "node").select("req_id", "node", ok.alias("matches"))


def append_decision(requests: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """Each append request judged against its node's state: (req_id, node, success, reply_term, role, voted_for, leader, truncates, entries_count, last_index, commit_index, dup_risk).

    A rejection raises the term but keeps the vote; an acceptance with a higher term clears it. Entries after prev_log_index
    are cut only if it isn't 0, lies in the log or at the snapshot's end, more follow, and the request has entries. dup_risk marks entries that a request with prev_log_index 0 appends behind a log that isn't empty.
    """
    x = with_term_at(requests, states, log, "prev_log_index", "_at").join(last_log(states, log).drop("last_term"), "node")
    higher = F.col("current_term") < F.col("term")
    bad = (F.col("current_term") > F.col("term")) | (F.col("last_index") < F.col("prev_log_index")) | ((F.col("prev_log_index") != 0) & (F.col("_at") != F.col("prev_log_term")))
    cuts = ~bad & (F.col("prev_log_index") != 0) & (F.col("last_index") > F.col("prev_log_index")) & (F.col("prev_log_index") >= F.col("snapshot_last_index")) & (F.col("n_entries") > 0)
    end = F.when(bad, F.col("last_index")).otherwise(F.when(cuts, F.col("prev_log_index")).otherwise(F.col("last_index")) + F.col("n_entries"))
    return x.select(
        "req_id", "node", (~bad).alias("success"), F.greatest("current_term", "term").alias("reply_term"),
        F.when(bad & ~higher, F.col("role")).otherwise("Follower").alias("role"),
        F.when(~bad & higher, F.lit(None)).otherwise(F.col("voted_for")).alias("voted_for"),
        F.when(~bad, F.col("leader_id")).alias("leader"), cuts.alias("truncates"),
        F.when(bad, 0).otherwise(F.col("n_entries")).cast("long").alias("entries_count"), end.cast("long").alias("last_index"),
        F.when(~bad & (F.col("leader_commit") > F.col("commit_index")), F.least(end, F.col("leader_commit"))).otherwise(F.col("commit_index")).cast("long").alias("commit_index"),
        (~bad & (F.col("prev_log_index") == 0) & (F.col("n_entries") > 0) & (F.col("last_index") > 0)).alias("dup_risk"),
    )


def append_truncate(requests: DataFrame, entries: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """(req_id, node, idx, term, command): each request's node's log after it, rejected requests included. entries: (req_id, pos from 0, term, command)."""
    judged = append_decision(requests, states, log).select("req_id", "node", "success", "truncates", (F.col("last_index") - F.col("entries_count")).alias("_base"))
    prev = requests.select("req_id", "prev_log_index")
    kept = judged.join(prev, "req_id").join(log, "node").where(~F.col("truncates") | (F.col("idx") <= F.col("prev_log_index"))).select("req_id", "node", "idx", "term", "command")
    new = judged.where("success").join(entries, "req_id").select("req_id", "node", (F.col("_base") + F.col("pos") + 1).alias("idx"), "term", "command")
    return kept.unionByName(new)


def ack_join(pending: DataFrame, applied: DataFrame) -> DataFrame:
    """(client, node, idx, term): pending writes of nodes whose entry the node applied. Node, index and term must agree, so a later leader's entry at the same index acknowledges nothing."""
    return pending.join(applied, ["node", "idx", "term"]).select("client", "node", "idx", "term")


def commit_index(states: DataFrame, log: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, commit_index): the greatest index after the present one that a majority has and whose entry is of the current term.

    An index is held by a majority if enough match indices reach it: that is up to the ceil(peers / 2)-th largest, so no index is compared with every peer.
    """
    m = peers.groupBy("node").agg(F.sort_array(F.collect_list("match_index"), asc=False).alias("_m"))
    need = F.ceil(F.size("_m") / 2).cast("int")
    x = states.join(m, "node", "left").withColumn("_limit", F.when(F.col("_m").isNull() | (need == 0), F.lit(None)).otherwise(F.element_at("_m", need)))
    entry = log.select("node", "idx", "term")
    hit = x.select("node", "current_term", "commit_index", "_limit").join(entry, "node").where((F.col("idx") > F.col("commit_index")) & (F.col("_limit").isNull() | (F.col("idx") <= F.col("_limit"))) & (F.col("term") == F.col("current_term")))
    best = hit.groupBy("node").agg(F.max("idx").alias("_b"))
    return states.join(best, "node", "left").select("node", F.coalesce("_b", "commit_index").alias("commit_index"))


def vote_decision(requests: DataFrame, states: DataFrame, log: DataFrame) -> DataFrame:
    """(voter, candidate, vote, reply_term, voted_for) of (voter, candidate, term, last_log_index, last_log_term), each judged against the voter's state."""
    x = requests.join(last_log(states, log).withColumnRenamed("node", "voter"), "voter")
    term = F.greatest("current_term", "term")
    voted = F.when(F.col("current_term") < F.col("term"), F.lit(None)).otherwise(F.col("voted_for"))
    deny = (voted.isNotNull() & (voted != F.col("candidate"))) | (term > F.col("term")) | ((F.col("last_term") == F.col("last_log_term")) & (F.col("last_index") > F.col("last_log_index"))) | (F.col("last_term") > F.col("last_log_term"))
    deny = F.coalesce(deny, F.lit(False))
    return x.select("voter", "candidate", (~deny).alias("vote"), term.alias("reply_term"), F.when(deny, voted).otherwise(F.col("candidate")).alias("voted_for"))


def vote_tally(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """(node, votes, role): candidates (node, current_term, n_peers) after all replies (node, term, vote). A reply of a higher term makes a follower; replies of other terms don't count; the own vote does."""
    got = replies.join(candidates.select("node", "current_term"), "node").groupBy("node").agg(F.count_if((F.col("term") == F.col("current_term")) & F.col("vote")).alias("_v"), F.bool_or(F.col("term") > F.col("current_term")).alias("_down"))
    x = candidates.join(got, "node", "left").withColumn("votes", F.coalesce("_v", F.lit(0)) + 1)
    return x.select("node", "votes", F.when(F.coalesce("_down", F.lit(False)), "Follower").when(majority(F.col("votes"), F.col("n_peers")), "Leader").otherwise("Candidate").alias("role"))


def apply_range(states: DataFrame, log: DataFrame) -> DataFrame:
    """(node, idx, term, command): the committed entries that were not applied yet."""
    x = log.join(states.select("node", "last_applied", "commit_index"), "node")
    return x.where((F.col("idx") > F.col("last_applied")) & (F.col("idx") <= F.col("commit_index"))).select("node", "idx", "term", "command")


def compacted_log(states: DataFrame, log: DataFrame) -> DataFrame:
    """(node, idx, term, command): what is left of the logs when all committed entries were applied and dropped."""
    return log.join(states.select("node", "commit_index"), "node").where(F.col("idx") > F.col("commit_index")).select("node", "idx", "term", "command")


def write_route(writes: DataFrame, states: DataFrame) -> DataFrame:
    """(client, node, accepted): whether the node a write was sent to is a leader."""
    return writes.join(states.select("node", "role"), "node").select("client", "node", (F.col("role") == "Leader").alias("accepted"))


def fanout(writes: DataFrame, states: DataFrame, log: DataFrame, peers: DataFrame) -> DataFrame:
    """(client, node, peer, term, prev_log_index, prev_log_term, leader_commit, command): the append requests that a leader sends for a write, judged on its log before it. writes: (client, node, command)."""
    lead = last_log(states, log).where("role = 'Leader'").select("node", F.col("current_term").alias("term"), F.col("last_index").alias("prev_log_index"), F.col("last_term").alias("prev_log_term"), F.col("commit_index").alias("leader_commit"))
    return writes.join(lead, "node").join(peers.select("node", "peer"), "node").select("client", "node", "peer", "term", "prev_log_index", "prev_log_term", "leader_commit", "command")


def heartbeats(states: DataFrame, log: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, peer, term, prev_log_index, prev_log_term, leader_commit): a leader's empty append requests."""
    lead = states.where("role = 'Leader'").select("node", F.col("current_term").alias("term"), F.col("commit_index").alias("leader_commit"))
    x = peers.join(lead, "node").withColumn("prev_log_index", F.coalesce("next_index", F.lit(1)) - 1)
    return with_term_at(x, states, log, "prev_log_index", "prev_log_term").select("node", "peer", "term", "prev_log_index", "prev_log_term", "leader_commit")


def reply_progress(replies: DataFrame, states: DataFrame, log: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, peer, action, current_term, role, next_index, match_index, resend_from, resend_count) for each append reply (node, peer, term, success, entries_count).

    Success advances both indices, whatever the reply's term or the node's role. Else a higher term makes a follower, or next_index backs
    off by one, 1 at least, and the log is sent again from there.
    """
    n = log.groupBy("node").agg(F.count(F.lit(1)).alias("_n"))
    x = replies.join(peers, ["node", "peer"]).join(states, "node").join(n, "node", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    down = ~F.col("success") & (F.col("current_term") < F.col("term"))
    matched = F.col("next_index") - 1 + F.col("entries_count")
    back = F.greatest(F.col("next_index") - 1, F.lit(1))
    start = F.least(F.greatest(back - 1 - F.col("snapshot_last_index"), F.lit(0)), F.col("_n"))
    again = ~F.col("success") & ~down
    return x.select(
        "node", "peer", F.when(F.col("success"), "advance").when(down, "step_down").otherwise("resend").alias("action"),
        F.when(down, F.col("term")).otherwise(F.col("current_term")).alias("current_term"), F.when(down, "Follower").otherwise(F.col("role")).alias("role"),
        F.when(F.col("success"), matched + 1).when(again, back).otherwise(F.col("next_index")).cast("long").alias("next_index"),
        F.when(F.col("success"), matched).otherwise(F.col("match_index")).cast("long").alias("match_index"),
        F.when(again, F.col("snapshot_last_index") + start + 1).cast("long").alias("resend_from"), F.when(again, F.col("_n") - start).cast("long").alias("resend_count"),
    )


def election_start(states: DataFrame, log: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, peer, term, last_log_index, last_log_term, role): the vote requests of nodes whose timer ended; a node without peers has one row without a peer, and leads at once."""
    me = last_log(states, log).select("node", (F.col("current_term") + 1).alias("term"), F.col("last_index").alias("last_log_index"), F.col("last_term").alias("last_log_term"))
    return me.join(peers.select("node", "peer"), "node", "left").select("node", "peer", "term", "last_log_index", "last_log_term", F.when(F.col("peer").isNull(), "Leader").otherwise("Candidate").alias("role"))


def leader_init(states: DataFrame, log: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, peer, next_index, match_index) of a new leader: the end of its log, and 0."""
    last = last_log(states, log).select("node", "last_index")
    return peers.select("node", "peer").join(last, "node").select("node", "peer", (F.col("last_index") + 1).alias("next_index"), F.lit(0).cast("long").alias("match_index"))


def stuck_followers(states: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, peer, next_index): peers that lack entries which the leader's log no longer has."""
    lead = states.where("role = 'Leader'").select("node", "snapshot_last_index")
    return peers.join(lead, "node").where(F.col("next_index") - 1 < F.col("snapshot_last_index")).select("node", "peer", "next_index")
