"""Removal of repeated byte strings: shard Burrows-Wheeler transforms are merged by interleave refinement (Holt & McMillan, 2014), which yields the repeated intervals.

Transforms are only built where they decide something. Every string of `length` bytes holds a least gram, and belongs to
that anchor; two equal strings have equal anchors at equal places. An anchor that occurs once has no repeated string. Where all strings of an anchor lie in
a stretch that occurs again as a whole, all are repeated. What is left, the ends of matches, is cut into pieces that share a core; the few bytes on
either side of the core, with the core as one symbol, are the texts whose shard transforms are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, written

GRAM = 64
#: Texts are read in segments of so many bytes, which overlap by length - 1, so that work arrays are bounded.
SEGMENT = 1 << 20
#: Width of a piece, in string starts, and of the parts that transforms are merged over.
PIECE, PART = 64, 16
_B, _M1, _M2 = 0xD6E8FEB86659FD93, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CACHE: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, the powers of _B and of its inverse modulo 2^64; kept per process."""
    if not _CACHE:
        _CACHE["byte"] = np.random.default_rng(41).integers(1, 2**63, size=256, dtype=np.uint64)
        for name, base in (("pow", _B), ("inv", pow(_B, -1, 2**64))):
            x = np.full(SEGMENT + 1, np.uint64(base))
            x[0] = 1
            _CACHE[name] = np.multiply.accumulate(x)
    return _CACHE["byte"], _CACHE["pow"], _CACHE["inv"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Hashes:
    """64-bit names of the stretches of a segment."""

    def __init__(self, x: np.ndarray) -> None:
        byte, power, self.inv = _tables()
        self.sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(byte[x] * power[: len(x)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, salt=0) -> np.ndarray:
        """Names of x[start:end], which depend on the length and the salt too."""
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return _mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def anchors(x: np.ndarray, hashes: Hashes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(p, first, last, name): the anchors of a segment, the first and last start of the strings that each is the least gram of (the leftmost of equal ones), and the gram's name."""
    n = len(x) - length + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    at = np.arange(len(x) - GRAM + 1)
    h = hashes.of(at, at + GRAM)
    m = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    width, done = length - GRAM + 1, 1
    while done * 2 <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    if width > done:
        m = np.minimum(m[: len(m) - (width - done)], m[width - done :])
    p = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    return p[first], first, np.append(first[1:], n) - 1, h[p[first]]


def _segments(raw: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of the segments whose strings together are all strings of the text, each once."""
    x = np.frombuffer(raw, dtype=np.uint8)
    step = SEGMENT - length + 1
    for s in range(0, max(len(x) - length + 1, 0), step):
        yield s, x[s : s + SEGMENT]


def suffix_order(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bwt) of a shard: the sorted suffixes of its texts (rows of symbols above 0, each followed by an end symbol 0), as flat positions, and the symbol before each (0 before a text's first)."""
    full = np.concatenate([texts, np.zeros((len(texts), 1), dtype=texts.dtype)], axis=1)
    n, m = full.shape
    rank = np.unique(full.ravel(), return_inverse=True)[1].astype(np.int64).reshape(n, m)
    step = 1
    while step < m:
        later = np.zeros_like(rank)
        later[:, : m - step] = rank[:, step:] + 1
        rank = np.unique((rank * (int(rank.max()) + 2) + later).ravel(), return_inverse=True)[1].astype(np.int64).reshape(n, m)
        step *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    before = np.concatenate([np.zeros((n, 1), dtype=texts.dtype), texts], axis=1)
    return order, before.ravel()[order]


def merge_transforms(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, block) by merged position: which shard each suffix of the merged order comes from, and the number of its interval of suffixes whose common prefix has at least `depth` symbols.

    All starts in one interval with the shards one after another. A round reads the transforms in the order of the present
    interleave and deals them stably by symbol: then the interleave is right, and intervals are told apart, to one symbol more. No suffix is compared or sorted.
    """
    z = np.repeat(np.arange(len(bwts), dtype=np.int16), [len(b) for b in bwts])
    block = np.zeros(len(z), dtype=np.int64)
    symbols = np.empty(len(z), dtype=bwts[0].dtype if bwts else np.uint16)
    for _ in range(depth):
        for s, b in enumerate(bwts):
            symbols[z == s] = b
        dealt = np.argsort(symbols, kind="stable")
        z, sym, old = z[dealt], symbols[dealt], block[dealt]
        new = np.concatenate([[False], (sym[1:] != sym[:-1]) | (old[1:] != old[:-1])])
        block = np.cumsum(new)
    return z, block


def repeated_windows(left: np.ndarray, core: np.ndarray, right: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For texts left + core + right (PART - 1 bytes each side as symbols from 2 on, 1 where there is none): whether the window of PART symbols with t bytes of the left also starts in another text; a row of t = 0..PART-1 for each."""
    out = np.zeros((len(core), PART), dtype=bool)
    kinds, core = np.unique(core, return_inverse=True)
    for low in range(0, len(kinds), 60_000):
        rows = np.flatnonzero((core >= low) & (core < low + 60_000))
        texts = np.concatenate([left[rows], (core[rows, None] - low + 258), right[rows]], axis=1).astype(np.uint16)
        groups = [g for s in np.unique(shard[rows]) if len(g := np.flatnonzero(shard[rows] == s))]
        made = [suffix_order(texts[g]) for g in groups]
        z, block = merge_transforms([b for _, b in made], PART)
        many = (np.bincount(block) > 1)[block]
        for s, (g, (order, _)) in enumerate(zip(groups, made, strict=True)):
            row, place = np.divmod(order, texts.shape[1] + 1)
            hit = many[z == s]
            keep = place < PART
            out[rows[g[row[keep]]], PART - 1 - place[keep]] = hit[keep]
    return out


def _padded(parts, width: int, at_right: bool) -> np.ndarray:
    """Byte strings as rows of symbols from 2 on, filled up with 1."""
    out = np.ones((len(parts), width), dtype=np.uint16)
    for row, b in zip(out, parts, strict=True):
        if len(b):
            v = np.frombuffer(b, dtype=np.uint8).astype(np.uint16) + 2
            if at_right:
                row[width - len(v) :] = v
            else:
                row[: len(v)] = v
    return out


def _count(*columns) -> np.ndarray:
    """How many rows have the same values as each row."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        _, inv = np.unique(c, return_inverse=True)
        _, code = np.unique(code * (int(inv.max()) + 1 if len(inv) else 1) + inv.ravel(), return_inverse=True)
    return np.bincount(code)[code] if len(code) else code


def _row_names(x: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of symbols."""
    byte = np.concatenate([_tables()[0], np.random.default_rng(43).integers(1, 2**63, size=8, dtype=np.uint64)])
    if not x.shape[1]:
        return np.zeros(len(x), dtype=np.uint64)
    return _mix((byte[x] * _tables()[1][: x.shape[1]]).sum(axis=1, dtype=np.uint64))


def resolve_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """(cls, n, lo, hi): runs of repeated string starts of the pieces (core, cls, n, start, t0, t1, left, right, shard).

    A piece's strings are those with t bytes of `left` before the core and PIECE - 1 - t of `right` after it, t from t0 to t1; start is that of t = 0.
    """
    pdf = pdf[_count(pdf["core"].to_numpy()) > 1].reset_index(drop=True)
    if pdf.empty:
        return pd.DataFrame({"cls": [], "n": [], "lo": [], "hi": []})
    left, right = _padded(pdf["left"], PIECE - 1, True), _padded(pdf["right"], PIECE - 1, False)
    core, t0, t1, shard = (pdf[c].to_numpy() for c in ("core", "t0", "t1", "shard"))
    flags = np.zeros((len(pdf), PIECE), dtype=bool)
    for low in range(0, PIECE, PART):
        a, b = np.maximum(t0, low), np.minimum(t1, low + PART - 1)
        rows = np.flatnonzero(a <= b)
        if not len(rows):
            continue
        inner_l, inner_r = left[rows, PIECE - 1 - low :], right[rows, : PIECE - low - PART]
        inner = _mix(core[rows].astype(np.uint64) + _row_names(inner_l) + _row_names(inner_r) * np.uint64(3))
        near_l, near_r = left[rows, PIECE - low - PART : PIECE - 1 - low], right[rows, PIECE - low - PART : PIECE - 1 - low]
        some = np.flatnonzero(_count(inner) > 1)
        if len(some):
            hit = repeated_windows(near_l[some], inner[some], near_r[some], shard[rows][some])
            t = np.arange(PART)
            at = rows[some]
            flags[at, low : low + PART] |= hit & (t >= a[at, None] - low) & (t <= b[at, None] - low)
    edge = np.diff(np.concatenate([np.zeros((len(flags), 1), dtype=np.int8), flags.astype(np.int8), np.zeros((len(flags), 1), dtype=np.int8)], axis=1), axis=1)
    row, on = np.nonzero(edge == 1)
    _, off = np.nonzero(edge == -1)
    start = pdf["start"].to_numpy()[row]
    return pd.DataFrame({"cls": pdf["cls"].to_numpy()[row], "n": pdf["n"].to_numpy()[row], "lo": start - (off - 1), "hi": start - on})


def resolve_crowded(pieces: DataFrame) -> DataFrame:
    """(cls, n, runs) as resolve_pieces finds them, for pieces of anchors that too many places share.

    A text's equal pieces become one with its starts, then equal pieces of all texts one with a count, both by partial aggregates; then the
    strings are counted one by one with partial sums. So nothing that is shared meets in one task.
    """
    named = pieces.withColumn("piece", F.xxhash64("core", "left", "right", "t0", "t1"))
    own = written(named.groupBy("cls", "n", "piece", "core", "t0", "t1", "left", "right").agg(F.collect_list("start").alias("starts")))
    kinds = own.groupBy("piece", "core", "t0", "t1", "left", "right").agg(F.sum(F.size("starts")).alias("same"))
    one = kinds.select("piece", "core", "same", "left", "right", F.explode(F.sequence(F.col("t0").cast("int"), F.col("t1").cast("int"))).alias("t"))
    l_bytes = F.substring("left", F.length("left") - F.col("t") + 1, F.col("t"))
    one = written(one.select("piece", "same", F.xxhash64("core", "t", l_bytes, F.substring("right", F.lit(1), F.lit(PIECE - 1) - F.col("t"))).alias("string"), "t"))
    many = one.groupBy("string").agg(F.sum("same").alias("total")).where("total > 1").select("string")
    found = one.join(many, "string", "left_semi").groupBy("piece").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    first = F.filter("ts", lambda t: ~F.array_contains("ts", t - 1))
    last = F.filter("ts", lambda t: ~F.array_contains("ts", t + 1))
    runs = found.select("piece", F.arrays_zip(first.alias("a"), last.alias("b")).alias("ts"))
    at = F.flatten(F.transform("starts", lambda s: F.transform("ts", lambda r: F.struct((s - r["b"]).cast("int").alias("lo"), (s - r["a"]).cast("int").alias("hi")))))
    return own.select("cls", "n", "piece", "starts").join(runs, "piece").select("cls", "n", at.alias("runs"))


def _covered(raw: bytes, starts: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, bytes left) for runs (first, last) of repeated string starts."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(starts):
        s, e = lo, hi + length
        if s > end:
            spans += 1
            kept.append(raw[max(at, 0) : s])
            removed += e - s
        elif e > end:
            removed += e - end
        end = max(end, e)
        at = end
    kept.append(raw[at:])
    return removed, spans, b"".join(kept)


def strip_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = 60_000, crowd: int = 50_000, shards: int = 4) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row: kept is the text without each byte covered by a string of `length` bytes that also starts elsewhere.

    Strings are compared as UTF-8 bytes over all rows, and judged on the input. Rows are documents, whatever their ids:
    repeated rows repeat each other's strings. Null and empty texts, and those shorter than `length`, lose nothing. Rows of equal text share a class
    (a 64-bit hash and the length), since they lose the same bytes. Anchors that more than
    `crowd` places share are resolved by partial counts instead of in one task.
    """
    if length < GRAM + PIECE:
        raise ValueError(f"length must be at least {GRAM + PIECE}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"cls": F.xxhash64("text"), "n": F.octet_length("text").cast("int")})

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, n, t in zip(b["cls"], b["n"], b["text"], strict=True):
                for off, x in _segments(t.encode("utf-8", "surrogatepass"), length):
                    hashes = Hashes(x)
                    p, first, last, name = anchors(x, hashes, length)
                    out.append((np.full(len(p), c), np.full(len(p), n), p + off, p - last, p - first, name.view(np.int64), hashes.of(first, last + length, p - last).view(np.int64)))
                if len(out) >= 2000:
                    yield pd.DataFrame(dict(zip(("cls", "n", "p", "a0", "a1", "name", "whole"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out = []
            if out:
                yield pd.DataFrame(dict(zip(("cls", "n", "p", "a0", "a1", "name", "whole"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    marked = written(rows.where(F.col("n") >= length).select("cls", "n", "text").mapInPandas(mark, "cls long, n int, p int, a0 short, a1 short, name long, whole long"))
    wholes = marked.groupBy("name", "whole").agg(F.count(F.lit(1)).alias("same"))
    names = wholes.groupBy("name").agg(F.sum("same").alias("all"), F.min("same").alias("least")).where("all > 1")
    verdict = wholes.join(names, "name").select("name", "whole", (F.col("same") > 1).alias("full"), (F.col("least") == 1).alias("mixed"), (F.col("all") > crowd).alias("crowded"))
    judged = written(marked.join(verdict, ["name", "whole"]).select("cls", "n", "p", "a0", "a1", "full", "mixed", "crowded").distinct())
    full = judged.where("full").select("cls", "n", (F.col("p") - F.col("a1")).alias("lo"), (F.col("p") - F.col("a0")).alias("hi"))
    # one row of a class speaks for its equals: whatever equal texts hold is known to be full
    long_rows = rows.where(F.col("n") >= length)
    speaker = long_rows.groupBy("cls", "n").agg(F.min("id").alias("speaker"))
    n_open = {r["crowded"]: r["n"] for r in judged.where("mixed").groupBy("crowded").agg(F.count(F.lit(1)).alias("n")).collect()}

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, n, t, opened in zip(b["cls"], b["n"], b["text"], b["open"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                at = sorted((x["p"], x["a0"], x["a1"]) for x in opened)
                p, a0, a1 = (np.array(v, dtype=np.int64) for v in zip(*at, strict=True))
                for off, x in _segments(raw, length):
                    s_lo = p - a1
                    mine = np.flatnonzero((s_lo >= off) & (s_lo - off < SEGMENT - length + 1) & (p - a0 + length <= off + len(x)))
                    if not len(mine):
                        continue
                    hashes = Hashes(x)
                    q, lo, hi = p[mine] - off, a0[mine], a1[mine]
                    name = hashes.of(q, q + GRAM)
                    for k in range(0, length - GRAM + 1, PIECE):
                        i = np.flatnonzero((lo < k + PIECE) & (hi >= k))
                        if not len(i):
                            continue
                        # strings with k + t bytes before the anchor; all hold the core
                        c0, c1 = q[i] - k, q[i] + length - k - PIECE + 1
                        core = _mix(hashes.of(c0, c1, k + 1) + name[i])
                        t0, t1 = np.maximum(lo[i] - k, 0), np.minimum(hi[i] - k, PIECE - 1)
                        for j in range(len(i)):
                            out.append((int(core[j].astype(np.int64)), c, n, int(c0[j]) + off, int(t0[j]), int(t1[j]), x[c0[j] - t1[j] : c0[j]].tobytes(), x[c1[j] : c1[j] + PIECE - 1 - t0[j]].tobytes(), (c ^ n) % shards))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["core", "cls", "n", "start", "t0", "t1", "left", "right", "shard"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["core", "cls", "n", "start", "t0", "t1", "left", "right", "shard"])

    def pieces(crowded: bool) -> DataFrame:
        open_ = judged.where(F.col("mixed") & (F.col("crowded") == crowded)).groupBy("cls", "n").agg(F.collect_list(F.struct("p", "a0", "a1")).alias("open"))
        speakers = long_rows.join(open_.join(speaker, ["cls", "n"]), ["cls", "n"]).where(F.col("id").eqNullSafe(F.col("speaker")))
        return speakers.select("cls", "n", "text", "open").mapInPandas(cut, "core long, cls long, n int, start int, t0 short, t1 short, left binary, right binary, shard int")

    groups = max(8, -(-3 * n_open.get(False, 0) // piece_rows))
    found = pieces(False).groupBy(F.pmod(F.col("core"), F.lit(groups)).alias("g")).applyInPandas(resolve_pieces, "cls long, n int, lo int, hi int")
    if n_open.get(True):
        more = resolve_crowded(pieces(True))
        runs = full.unionByName(found).distinct().select("cls", "n", F.array(F.struct("lo", "hi")).alias("runs")).unionByName(more).groupBy("cls", "n").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    else:
        runs = full.unionByName(found).distinct().groupBy("cls", "n").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    final = rows.join(runs, ["cls", "n"], "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, t, r in zip(b["id"], b["text"], b["runs"], strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                out.append((i, len(raw), *_covered(raw, [] if r is None else [(x["lo"], x["hi"]) for x in r], length)))
            x = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])
            yield x.assign(id=x["id"].astype("Int64"))

    return final.select(F.col("id").cast("long").alias("id"), "text", "runs").mapInPandas(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strip_repeats over all documents at 400 bytes; the bytes left are digested."""
    out = strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
with b as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as materialized (select doc_id, i as s, md5(substr(h, (2 * i + 1)::bigint, 800)) as k from (select doc_id, h, unnest(range(0, n - 399)) as i from b where n >= 400)),
rep as (select doc_id, s from w semi join (select k from w group by k having count(*) > 1) using (k)),
gap as (select doc_id, s, case when s > lag(s) over (partition by doc_id order by s) + 400 then 1 else 0 end as cut from rep),
isl as (select doc_id, s, sum(cut) over (partition by doc_id order by s) as g from gap),
sp as (select doc_id, min(s) as a, max(s) + 400 as e from isl group by doc_id, g),
pc as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as pe from sp),
ag as (select doc_id, sum(e - a)::bigint as r, count(*) as c, max(e) as me, string_agg(substr(h, (2 * pe + 1)::bigint, (2 * (a - pe))::bigint), '' order by a) as kp from pc join b using (doc_id) group by doc_id)
select doc_id, n as n_bytes, coalesce(r, 0) as n_removed, coalesce(c, 0) as n_spans, sha256(unhex(coalesce(kp, '') || substr(h, (2 * coalesce(me, 0) + 1)::bigint))) as kept_sha256
from b left join ag using (doc_id)"""
