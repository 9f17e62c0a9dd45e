"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tidelog.functions.bloom import BITS, PROBES
from tidelog.plans import inputs as i

M = """m as (select event_id + 1 as idx, case when event_type = 'error' then 1 else 0 end as op, 'u' || user_id::varchar as k,
  case when event_type = 'error' then '' else event_type || ':' || json_extract_string(props, '$.k') end as v from events)"""
STATE = "st as (select k, max(idx) as idx, arg_max(op, idx) as op, arg_max(v, idx) as v from m group by k)"
RUNS = f"runs as (select (idx - 1) // {i.STRIDE} + 1 as file_id, k, max(idx) as idx, arg_max(op, idx) as op, arg_max(v, idx) as v from m group by all)"
PROBE = "probes as (select unnest([" + ", ".join(f"'{k}'" for k in i.PROBES) + "]) as k)"
POS = """pos as (select *, row_number() over (partition by file_id order by k) - 1 as pos,
  coalesce(sum(21 + strlen(k) + strlen(v)) over (partition by file_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as off from runs)"""
CAT = "cat as (select file_id, min(k) as min_k, max(k) as max_k, sum(21 + strlen(k) + strlen(v))::bigint as size_in_bytes, count(*) as n from runs group by file_id)"
HALF = lambda key, at: f"('0x' || substr(sha256({key}), {at}, 16))::ubigint::hugeint"
BIT = lambda key: f"((({HALF(key, 1)} + p * {HALF(key, 17)}) % 18446744073709551616::hugeint) % {BITS})::integer"
NUMBERS = f"(select unnest(range(1, {PROBES + 1})) as p)"


def over(name: str, spec: tuple) -> str:
    numbers, where, columns = spec
    return f"{name} as (select {', '.join(columns)} from (select *, unnest([{numbers}])::bigint as j from states) where {where})"


STATES = f"states as (select {', '.join(i.STATES)} from supplier)"
LOG, PEERS, REQ = over("log", i.LOG), over("peers", i.PEERS), over("req", i.REQUESTS)
ENTRIES = "entries as (select req_id, pos, term, concat('new', cast(pos as string)) as command from (select *, unnest([0, 1])::bigint as pos from req) where pos < n_entries)"
LAST = "lst as (select states.*, coalesce(l.li, snapshot_last_index) as last_index, coalesce(l.lt, snapshot_last_term) as last_term from states left join (select node, max(idx) as li, arg_max(term, idx) as lt from log group by node) l using (node))"
AT = """req_at as (select req.*, case when prev_log_index = snapshot_last_index then snapshot_last_term when prev_log_index > snapshot_last_index then coalesce(log.term, 0) else 0 end as at_term,
  lst.* exclude (node) from req join lst using (node) left join log on log.node = req.node and log.idx = req.prev_log_index)"""
JUDGED = """judged as (select *, cur_bad as bad, (not cur_bad and prev_log_index <> 0 and last_index > prev_log_index and prev_log_index >= snapshot_last_index and n_entries > 0) as cuts
  from (select *, (current_term > term or last_index < prev_log_index or (prev_log_index <> 0 and at_term <> prev_log_term)) as cur_bad from req_at))"""
DECIDED = """dec as (select *, case when bad then last_index when cuts then prev_log_index + n_entries else last_index + n_entries end as new_last from judged)"""


def w(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


OUTCOME = "case when op is null then 'not_found' when op = 1 then 'tombstone' else 'value' end as status, case when op = 0 then v end as v"
FLUSH = w(M, """e as (select idx, k, strlen(k) + strlen(v) + 9 as sz, (idx - 1) % 4 as shard, row_number() over (partition by (idx - 1) % 4 order by idx) as i from m),
 l as (select *, lag(i) over (partition by shard, k order by i) as pi, lag(sz) over (partition by shard, k order by i) as ps from e),
 mem as (select a.shard, a.i as s, b.i as e, sum(b.sz - case when b.pi >= a.i then b.ps else 0 end) over (partition by a.shard, a.i order by b.i) as mem from l a join l b on a.shard = b.shard and b.i between a.i and a.i + 300)""").replace("with m as", "with recursive m as") + """,
 nxt as materialized (select shard, s, min(e) + 1 as n from mem where mem >= 500 group by shard, s),
 g(shard, s, generation) as (select distinct shard, 1::bigint, 1::bigint from e union all select g.shard, nxt.n, g.generation + 1 from g join nxt on nxt.shard = g.shard and nxt.s = g.s)
select e.shard, e.idx, max(g.generation) as generation from e join g on g.shard = e.shard and g.s <= e.i group by all"""
FULL = f"{w(M, STATE)}select k, idx, op, v from st"

SQL: dict[str, str] = {
    "wal_append_union": f"{w(M)}select idx, op, k, v from m",
    "wal_scan": f"{w(M)}select idx, op, k, v from m",
    "wal_generations": f"{w(M)}select (idx - 1) // {i.STRIDE} + 1 as generation, count(*) as n, min(idx) as first_idx, max(idx) as last_idx from m group by all",
    "wal_unflushed": f"{w(M)}select (idx - 1) // {i.STRIDE} + 1 as generation, idx, op, k, v from m where (idx - 1) // {i.STRIDE} + 1 > (select max((idx - 1) // {i.STRIDE} + 1) - 2 from m)",
    "sst_runs": f"{w(M, RUNS)}select * from runs",
    "sst_catalog": f"{w(M, RUNS, CAT)}select * from cat",
    "sst_meta": f"{w(M, RUNS, CAT)}select * from cat",
    "sst_next_id": f"{w(M, RUNS)}select coalesce(max(file_id), 0) + 1 as next_file_id from runs",
    "state_json_roundtrip": f"{w(STATES, LOG)}select node, current_term, voted_for, coalesce(n, 0) as n_entries, coalesce(ts, 0)::bigint as sum_term, commit_index, snapshot_last_index, snapshot_last_term from states left join (select node, count(*) as n, sum(term) as ts from log group by node) using (node)",
    "codec_encode": f"{w(M)}select idx, lpad(hex(17 + strlen(k) + strlen(v)), 8, '0') || lpad(hex(idx), 16, '0') || lpad(hex(op), 2, '0') || lpad(hex(strlen(k)), 8, '0') || hex(encode(k)) || lpad(hex(strlen(v)), 8, '0') || hex(encode(v)) as record from m",
    "codec_decode": f"{w(M)}select case when idx % 7 = 0 then 'short_value' when idx % 7 = 1 then 'short_prefix' else 'ok' end as status, case when idx % 7 > 1 then idx end as idx, case when idx % 7 > 1 then op end as op, case when idx % 7 > 1 then k end as k, case when idx % 7 > 1 then v end as v, case when idx % 7 > 1 then 21 + strlen(k) + strlen(v) end as consumed from m where op = 0",
    "codec_decode_stream": f"{w(M)}select k as stream_id, 'ok' as status, (row_number() over (partition by k order by idx) - 1)::integer as pos, idx, op, k, v from m",
    "bloom_positions": f"{w(PROBE)}select k, p::integer as i, {BIT('k')} as bit_pos from probes, {NUMBERS}",
    "bloom_build": f"{w(M, RUNS)}select distinct file_id, {BIT('k')} as bit_pos from runs, {NUMBERS}",
    "cmd_parse": f"""with c as (select o_orderkey, {i.COMMANDS} as command from orders), t as (select o_orderkey, list_filter(regexp_split_to_array(command, '\\s+'), lambda x: x <> '') as a from c),
 d as (select *, case when len(a) = 0 then 'noop' when lower(a[1]) = 'set' and len(a) = 3 then 'set' when lower(a[1]) = 'delete' and len(a) = 2 then 'delete' else 'error' end as kind from t)
 select o_orderkey, kind, case when kind in ('set', 'delete') then a[2] end as k, case when kind = 'set' then a[3] end as v from d""",
    "cmd_format": f"{w(M)}select idx, 'SET ' || k || ' ' || v as command from m where op = 0",
    "prune_minmax": f"{w(M, RUNS, CAT, PROBE)}select probes.k, count(file_id) as kept from probes left join cat on k between min_k and max_k group by probes.k",
    "prune_bloom": f"""{w(M, RUNS, PROBE)}, bits as (select distinct file_id, {BIT('k')} as b from runs, {NUMBERS}), pb as (select distinct k, {BIT('k')} as b from probes, {NUMBERS}),
 need as (select k, count(*) as n from pb group by k) select file_id, k from (select file_id, pb.k, count(*) as hit from bits join pb using (b) group by all) join need using (k) where hit = n""",
    "sparse_index": f"{w(M, RUNS, POS)}select file_id, k, off from pos where pos % 2 = 0",
    "sparse_seek": f"""{w(M, RUNS, POS, CAT, PROBE)}, c as (select file_id, probes.k as probe from cat join probes on probes.k between min_k and max_k)
 select file_id, probe as k, coalesce(max(off) filter (pos % 2 = 0 and k <= probe), 0) as start, coalesce(max(off) filter (k = probe) >= coalesce(max(off) filter (pos % 2 = 0 and k <= probe), 0), false) as found from pos join c using (file_id) group by file_id, probe""",
    "value_utf8": f"{w(M)}select idx, case when idx % 7 = 0 then null else v end as v from m",
    "rpc_get": f"{w(M, STATE, PROBE)}select probes.k, case when op = 0 then v else '' end as v from probes left join st using (k)",
    "kv_get_mem": f"{w(M, STATE)}select k, idx, op, v from st where k = 'u42'",
    "kv_multi_get": f"{w(M, STATE, PROBE)}select probes.k, {OUTCOME} from probes left join st using (k)",
    "kv_get_sst": f"{w(M, RUNS, PROBE)}, h as (select k, arg_max(op, file_id) as op, arg_max(v, file_id) as v from runs group by k) select probes.k, {OUTCOME} from probes left join h using (k)",
    "kv_get_sst_raw": f"{w(M, RUNS, PROBE)}, h as (select k, arg_max(op, file_id) as op, arg_max(v, file_id) as v from runs group by k) select probes.k, case when op is null then 'not_found' else 'value' end as status, v from probes left join h using (k)",
    "sst_stored_get": f"{w(M, STATE, PROBE)}select probes.k, {OUTCOME} from probes left join st using (k)",
    "kv_get_layered": f"{w(M, STATE, PROBE)}select probes.k, {OUTCOME} from probes left join st using (k)",
    "kv_state": FULL, "recover_state": FULL, "replay_idempotent": FULL, "kv_state_stream": FULL,
    "kv_live": f"{w(M, STATE)}select k, idx, v from st where op = 0",
    "kv_tombstones": f"{w(M, STATE)}select k, idx from st where op = 1",
    "kv_as_of": w(M) + "select k, max(idx) as idx, arg_max(op, idx) as op, arg_max(v, idx) as v from m where idx <= 500 group by k",
    "kv_get_stale": f"{w(M, STATES)}select node, k, max(m.idx) as idx, arg_max(op, m.idx) as op, arg_max(v, m.idx) as v from (select node, s * {i.SPREAD} % (select max(idx) from m) as last_applied from states) r join m on m.idx <= r.last_applied group by node, k",
    "kv_history": f"{w(M)}select k, row_number() over (partition by k order by idx) as version, idx, op, v, lag(v) over (partition by k order by idx) as before from m",
    "kv_range_scan": f"{w(M, STATE)}select k, v from st where op = 0 and k >= 'u1' and k < 'u4'",
    "kv_prefix_scan": f"{w(M, STATE)}select k, v from st where op = 0 and starts_with(k, 'u1')",
    "state_diff": w(M) + """, h as (select max(idx) // 2 as c from m), a as (select k, arg_max(v, idx) as old from m, h where idx <= c group by k having arg_max(op, idx) = 0), b as (select k, arg_max(v, idx) as new from m group by k having arg_max(op, idx) = 0)
 select k, case when old is null then 'added' when new is null then 'removed' else 'changed' end as change, old, new from a full join b using (k) where old is distinct from new""",
    "mem_size": f"{w(M, STATE)}select coalesce(sum(strlen(k) + strlen(v) + 9), 0)::bigint as size_in_bytes, count(*) as n from st",
    "mem_running_size": w(M) + ", d as (select idx, strlen(k) + strlen(v) + 9 - coalesce(lag(strlen(k) + strlen(v) + 9) over (partition by k order by idx), 0) as d from m) select idx, (sum(d) over (order by idx))::bigint as size_in_bytes from d",
    "mem_sorted": f"{w(M, STATE)}select row_number() over (order by k) as pos, k, idx, op, v from st",
    "flush_generations": FLUSH,
    "compact_runs": f"{w(M, STATE)}select k, idx, v from st where op = 0",
    "leader_gaps": "select source, ts_us, gap_us from (select 'u' || user_id::varchar as source, epoch_us(ts) as ts_us, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by epoch_us(ts)) as gap_us from events) where gap_us > 300000000",
    "raft_last_log": f"{w(STATES, LOG, LAST)}select node, last_index, last_term from lst",
    "raft_log_match": f"{w(STATES, LOG, REQ, LAST, AT)}select req_id, node, prev_log_index <= last_index and (prev_log_index = 0 or at_term = prev_log_term) as matches from req_at",
    "raft_append_decision": w(STATES, LOG, REQ, LAST, AT, JUDGED, DECIDED) + """select req_id, node, not bad as success, greatest(current_term, term) as reply_term, case when bad and current_term >= term then role else 'Follower' end as role,
 case when not bad and current_term < term then null else voted_for end as voted_for, case when not bad then leader_id end as leader, cuts as truncates, case when bad then 0 else n_entries end as entries_count, new_last as last_index,
 case when not bad and leader_commit > commit_index then least(new_last, leader_commit) else commit_index end as commit_index, (not bad and prev_log_index = 0 and n_entries > 0 and last_index > 0) as dup_risk from dec""",
    "raft_append_truncate": w(STATES, LOG, REQ, LAST, AT, JUDGED, DECIDED, ENTRIES) + """select dec.req_id, dec.node, log.idx, log.term, log.command from dec join log on log.node = dec.node where not cuts or log.idx <= prev_log_index
 union all select dec.req_id, dec.node, new_last - n_entries + pos + 1, entries.term, entries.command from dec join entries using (req_id) where not bad""",
    "raft_ack_join": f"{w(STATES, LOG)}select s * 100 + log.idx as client, node, log.idx, log.term from log join states using (node) where log.idx > last_applied and log.idx <= commit_index and (s + log.idx) % 5 <> 0",
    "raft_commit_index": w(STATES, LOG, PEERS) + """, np as (select node, count(*) as n from peers group by node), ack as (select log.node, log.idx, log.term, 1 + count(peer) filter (match_index >= idx) as c from log left join peers using (node) group by all),
 ok as (select ack.node, max(idx) as b from ack join states using (node) left join np using (node) where idx > commit_index and ack.term = current_term and c > ceil(coalesce(n, 0) / 2.0) group by ack.node)
 select node, coalesce(b, commit_index) as commit_index from states left join ok using (node)""",
    "raft_majority": "select s_suppkey, s_suppkey % 6 + 1 > ceil((s_suppkey % 5) / 2.0) as majority from supplier",
    "raft_vote_tally": w(STATES, over("replies", i.TALLY)) + """, x as (select states.node, current_term, s % 5 as n_peers, 1 + count(*) filter (r.term = current_term and vote) as votes, coalesce(bool_or(r.term > current_term), false) as down from states left join replies r using (node) group by all)
 select node, votes, case when down then 'Follower' when votes > ceil(n_peers / 2.0) then 'Leader' else 'Candidate' end as role from x""",
    "raft_apply_range": f"{w(STATES, LOG)}select node, log.idx, log.term, command from log join states using (node) where idx > last_applied and idx <= commit_index",
    "raft_compacted_log": f"{w(STATES, LOG)}select node, log.idx, log.term, command from log join states using (node) where idx > commit_index",
    "raft_fanout": f"{w(STATES, LOG, LAST, PEERS, over('writes', i.WRITES))}select client, node, peer, current_term as term, last_index as prev_log_index, last_term as prev_log_term, commit_index as leader_commit, command from writes join lst using (node) join peers using (node) where role = 'Leader'",
    "raft_write_route": f"{w(STATES, over('writes', i.WRITES))}select client, node, role = 'Leader' as accepted from writes join states using (node)",
    "raft_reply_progress": w(STATES, LOG, PEERS, over("replies", i.REPLIES)) + """, n as (select node, count(*) as n from log group by node), x as (select r.node, r.peer, r.term as rterm, success, entries_count, next_index, match_index, current_term, role, snapshot_last_index as sn, coalesce(n, 0) as n,
  greatest(next_index - 1, 1) as back, not success and current_term < r.term as down from replies r join peers using (node, peer) join states using (node) left join n using (node)), y as (select *, least(greatest(back - 1 - sn, 0), n) as start from x)
 select node, peer, case when success then 'advance' when down then 'step_down' else 'resend' end as action, case when down then rterm else current_term end as current_term, case when down then 'Follower' else role end as role,
  case when success then next_index + entries_count when down then next_index else back end as next_index, case when success then next_index - 1 + entries_count else match_index end as match_index,
  case when not success and not down then sn + start + 1 end as resend_from, case when not success and not down then n - start end as resend_count from y""",
    "raft_heartbeat": w(STATES, LOG, PEERS) + """select peers.node, peer, current_term as term, next_index - 1 as prev_log_index, case when next_index - 1 = snapshot_last_index then snapshot_last_term when next_index - 1 > snapshot_last_index then coalesce(log.term, 0) else 0 end as prev_log_term, commit_index as leader_commit
 from peers join states using (node) left join log on log.node = peers.node and log.idx = next_index - 1 where role = 'Leader'""",
    "raft_election_start": f"{w(STATES, LOG, LAST, PEERS)}select node, peer, current_term + 1 as term, last_index as last_log_index, last_term as last_log_term, case when peer is null then 'Leader' else 'Candidate' end as role from lst left join peers using (node)",
    "raft_leader_init": f"{w(STATES, LOG, LAST, PEERS)}select node, peer, last_index + 1 as next_index, 0::bigint as match_index from peers join lst using (node)",
    "raft_vote_decision": w(STATES, LOG, LAST, over("votes", i.VOTES)) + """, x as (select voter, candidate, greatest(current_term, term) as cur, term, case when current_term < term then null else voted_for end as voted, last_log_index, last_log_term, last_index, last_term from votes join lst on node = voter),
 y as (select *, coalesce((voted is not null and voted <> candidate) or cur > term or (last_term = last_log_term and last_index > last_log_index) or last_term > last_log_term, false) as deny from x)
 select voter, candidate, not deny as vote, cur as reply_term, case when deny then voted else candidate end as voted_for from y""",
    "raft_stuck_followers": f"{w(STATES, PEERS)}select node, peer, next_index from peers join states using (node) where role = 'Leader' and next_index - 1 < snapshot_last_index",
}
