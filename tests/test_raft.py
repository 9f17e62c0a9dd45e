"""The replication rules on literal states."""

import pytest

from tidelog.operators import raft

STATES = "node string, role string, current_term long, voted_for string, commit_index long, last_applied long, snapshot_last_index long, snapshot_last_term long"
LOG = "node string, idx long, term long, command string"
REQ = "req_id long, node string, term long, prev_log_index long, prev_log_term long, leader_commit long, leader_id string, n_entries long"


def node(spark, term, log=(), role="Follower", voted=None, commit=0, snap=(0, 0)):
    st = spark.createDataFrame([("n", role, term, voted, commit, snap[0], *snap)], STATES)
    return st, spark.createDataFrame([("n", snap[0] + i, t, "c") for i, t in enumerate(log, 1)], LOG)


@pytest.mark.parametrize(("state", "request_", "expected"), [
    (dict(term=4, snap=(5, 3)), (4, 5, 3, 10, 1), (True, 4, 6, 6)),
    (dict(term=4, snap=(5, 3)), (4, 5, 9, 10, 1), (False, 4, 5, 0)),
    (dict(term=1, role="Leader"), (2, 0, 0, 0, 0), (True, 2, 0, 0)),
    (dict(term=2, role="Leader"), (1, 0, 0, 0, 0), (False, 2, 0, 0)),
    (dict(term=2), (3, 1, 0, 0, 0), (False, 3, 0, 0)),
    (dict(term=1, log=(1,)), (3, 1, 0, 0, 0), (False, 3, 1, 0)),
    (dict(term=2, log=(1,)), (2, 1, 1, 0, 1), (True, 2, 2, 0)),
    (dict(term=3, log=(1, 2)), (3, 1, 1, 0, 1), (True, 3, 2, 0)),
    (dict(term=1, log=(1, 1)), (1, 2, 1, 2, 0), (True, 1, 2, 2)),
    (dict(term=1, log=(1, 1)), (1, 2, 1, 4, 0), (True, 1, 2, 2)),
    (dict(term=1, log=(1, 1)), (1, 2, 1, 4, 1), (True, 1, 3, 3)),
])
def test_append(spark, state, request_, expected):
    st, log = node(spark, **state)
    req = spark.createDataFrame([(1, "n", *request_[:4], "lead", request_[4])], REQ)
    r = raft.append_decision(req, st, log).first()
    assert (r["success"], r["reply_term"], r["last_index"], r["commit_index"]) == expected
    new = spark.createDataFrame([(1, i, 9, "new") for i in range(request_[4])], "req_id long, pos long, term long, command string")
    after = raft.append_truncate(req, new, st, log).orderBy("idx").collect()
    base = state.get("snap", (0, 0))[0]
    assert [x["idx"] for x in after] == list(range(base + 1, r["last_index"] + 1))
    assert raft.log_match(req, st, log).count() == 1


def test_append_keeps_and_clears_the_vote(spark):
    st, log = node(spark, 2, voted="node2")
    ask = lambda term: raft.append_decision(spark.createDataFrame([(1, "n", term, 0, 0, 0, "lead", 0)], REQ), st, log).first()["voted_for"]
    assert (ask(2), ask(3), ask(1)) == ("node2", None, "node2")


@pytest.mark.parametrize(("state", "ask", "expected"), [
    (dict(term=0), (1, 0, 0), (True, 1)),
    (dict(term=0, voted="node2"), (0, 0, 0), (False, 0)),
    (dict(term=1, log=(1,)), (2, 0, 0), (False, 2)),
    (dict(term=1, log=(1,)), (2, 2, 1), (True, 2)),
    (dict(term=0, voted="node3"), (1, 0, 0), (True, 1)),
    (dict(term=1, log=(1, 1)), (2, 1, 1), (False, 2)),
    (dict(term=1, log=(1,)), (2, 1, 0), (False, 2)),
    (dict(term=2), (1, 0, 0), (False, 2)),
    (dict(term=1, log=(1, 1)), (3, 1, 2), (True, 3)),
])
def test_vote(spark, state, ask, expected):
    st, log = node(spark, **state)
    req = spark.createDataFrame([("n", "node3", *ask)], "voter string, candidate string, term long, last_log_index long, last_log_term long")
    r = raft.vote_decision(req, st, log).first()
    assert (r["vote"], r["reply_term"]) == expected


@pytest.mark.parametrize(("replies", "role"), [([(1, True)], "Leader"), ([(1, False)], "Candidate"), ([(0, True)], "Candidate"), ([(2, False), (1, True)], "Follower"), ([], "Candidate")])
def test_tally(spark, replies, role):
    c = spark.createDataFrame([("n", 1, 2)], "node string, current_term long, n_peers long")
    r = spark.createDataFrame([("n", *x) for x in replies], "node string, term long, vote boolean")
    assert raft.vote_tally(c, r).first()["role"] == role


@pytest.mark.parametrize(("reply", "nxt", "expected"), [((1, True, 2), 3, ("advance", 1, "Leader", 5, 4)), ((2, False, 0), 3, ("step_down", 2, "Follower", 3, 0)), ((1, False, 0), 3, ("resend", 1, "Leader", 2, 0)), ((1, False, 0), 1, ("resend", 1, "Leader", 1, 0))])
def test_reply(spark, reply, nxt, expected):
    st, log = node(spark, 1, log=(1, 1, 1), role="Leader")
    peers = spark.createDataFrame([("n", "p", nxt, 0)], "node string, peer string, next_index long, match_index long")
    r = raft.reply_progress(spark.createDataFrame([("n", "p", *reply)], "node string, peer string, term long, success boolean, entries_count long"), st, log, peers).first()
    assert (r["action"], r["current_term"], r["role"], r["next_index"], r["match_index"]) == expected
    if expected[0] == "resend":
        assert (r["resend_from"], r["resend_count"]) == (expected[3], 3 - expected[3] + 1)


def test_commit_and_apply(spark):
    peers = "node string, peer string, next_index long, match_index long"
    st, log = node(spark, 2, log=(1, 2, 2, 2), role="Leader")
    some = spark.createDataFrame([("n", f"p{i}", 1, m) for i, m in enumerate((3, 1, 4, 0))], peers)
    assert raft.commit_index(st, log, some).first()["commit_index"] == 3
    assert raft.commit_index(st, log, spark.createDataFrame([], peers)).first()["commit_index"] == 4
    old, log1 = node(spark, 3, log=(1, 2, 2, 2), role="Leader")
    assert raft.commit_index(old, log1, some).first()["commit_index"] == 0
    done, log2 = node(spark, 2, log=(1, 2, 2), commit=2)
    assert [r["idx"] for r in raft.apply_range(done, log2).orderBy("idx").collect()] == [1, 2]
    assert [r["idx"] for r in raft.compacted_log(done, log2).collect()] == [3]


def test_acknowledgement_needs_node_and_term(spark):
    pending = spark.createDataFrame([(1, "n", 5, 1), (2, "n", 6, 2), (3, "m", 6, 2)], "client long, node string, idx long, term long")
    applied = spark.createDataFrame([("n", 5, 2, "set a b"), ("n", 6, 2, "set a c")], "node string, idx long, term long, command string")
    assert [tuple(r) for r in raft.ack_join(pending, applied).collect()] == [(2, "n", 6, 2)]
