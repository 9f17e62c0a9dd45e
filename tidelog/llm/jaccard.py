"""N-gram Jaccard join by signature trees: nodes hold OR-combined token bitmaps and size ranges, and a dual traversal prunes node pairs by their greatest possible overlap.

The join is exact. A document can only link if a share of its shingles occurs in other documents; those that can't are
dropped by counts. The rest are cut into parts between which no link is possible (a link needs a common shingle among the
rarest of both), and each part is joined by signature trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import table, written
from tidelog.llm.components import components

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(31)


class _Words(dict):
    """Word to 64-bit hash; forgets all when it holds 150,000 words, so that its memory is bounded: workers live on and keep it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of the word runs of a whole text, A-Z lower-cased and split at ASCII white space; of the whole sequence if it is shorter; none without words."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, split), dtype=np.uint64, count=len(split))
    k = min(words, len(h))
    code = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        code = code * _PRIME + h[i : len(h) - k + 1 + i]
    code ^= code >> _S
    code *= _MIX1
    code ^= code >> _S
    code *= _MIX2
    return np.unique(code ^ (code >> _S))


def _key8(hashes: np.ndarray) -> int:
    """A set's 64-bit name, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def set_keys(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, key) per row of (doc_id, text): the size of its set and the set's 64-bit name (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, words) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(s) for s in sets], "key": pd.array([_key8(s) if len(s) else None for s in sets], dtype="Int64")})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, key long")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; ascending with the hash."""
    return ((h >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _repeated_counts(docs: DataFrame, words: int, buckets: int, parts: int, flush: int = 1_000_000) -> DataFrame:
    """(key, r): in how many of its shingles, at most, a set meets other sets; sets without any are left out. A set that one run of `flush` hashes holds whole is counted exactly; copies of a set in several runs may count a shingle once for each.

    A task first counts among its own sets, in runs of about `flush` hashes: a shingle that several of a run's sets have is known to be met, and goes on once, as a name without sets. So a shingle in
    very many documents is a row a run, not a row a document. All others are dealt into buckets of the hash, packed: a row holds many sets' hashes of one bucket. Equal sets have one key and so never count as others. A bucket's
    counts go on packed too, a row for each of `parts` shares of the keys, so the rows in between don't grow with sets times buckets.
    """

    def shares(keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """(part, keys, counts) of the counts above 0."""
        some = np.flatnonzero(counts)
        keys, counts, part = keys[some], counts[some].astype(np.int32), keys[some] % parts
        order = np.argsort(part, kind="stable")
        cuts = np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []
        return [(int(part[i[0]]), keys[i].tobytes(), counts[i].tobytes()) for i in cuts]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, np.ndarray] = {}
        held = 0

        def rows():
            key, h = np.fromiter(sets, dtype=np.int64, count=len(sets)), np.concatenate(list(sets.values()))
            doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets.values()])
            order = np.argsort(h, kind="stable")
            ordered = h[order]
            same = ordered[1:] == ordered[:-1]
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            out = [(-1 - part, b"", k, c, b"") for part, k, c in shares(key, np.bincount(doc[order[met]], minlength=len(key)))]
            names = ordered[met & np.concatenate([[True], ~same])]
            alone = np.zeros(len(h), dtype=bool)
            alone[order[~met]] = True
            h, doc = h[alone], doc[alone]
            b = _bucket(h, buckets)
            order = np.argsort(b.astype(np.uint16) if buckets <= 65536 else b, kind="stable")
            h, doc, b = h[order], doc[order], b[order]
            of_names = _bucket(names, buckets)
            for bucket in np.union1d(b, of_names):
                s, e = np.searchsorted(b, bucket), np.searchsorted(b, bucket, side="right")
                s2, e2 = np.searchsorted(of_names, bucket), np.searchsorted(of_names, bucket, side="right")
                d = doc[s:e]
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, dtype=np.int64)
                runs = np.diff(np.append(first, len(d))).astype(np.uint32)
                out.append((int(bucket), h[s:e].astype(np.uint32).tobytes(), key[d[first]].tobytes(), runs.tobytes(), names[s2:e2].astype(np.uint32).tobytes()))
            return pd.DataFrame(out, columns=["bucket", "tokens", "keys", "runs", "names"])

        for batch in batches:
            for t in batch["text"]:
                if len(s := shingles(t, words)) and (k := _key8(s)) not in sets:
                    sets[k] = s
                    held += len(s)
                if held >= flush:
                    yield rows()
                    sets, held = {}, 0
        if sets:
            yield rows()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, doc = np.unique(np.frombuffer(b"".join(pdf["keys"]), dtype=np.int64), return_inverse=True)
        runs = np.frombuffer(b"".join(pdf["runs"]), dtype=np.uint32)
        if pdf["bucket"].iloc[0] < 0:  # what tasks counted themselves
            out = shares(keys, np.bincount(doc, weights=runs, minlength=len(keys)))
        else:
            tokens = np.frombuffer(b"".join(pdf["tokens"]), dtype=np.uint32).astype(np.uint64)
            pair = tokens << np.uint64(32) | np.repeat(doc.astype(np.uint64), runs)
            pair.sort()
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
            token = pair >> np.uint64(32)
            same = token[1:] == token[:-1]
            met = np.zeros(len(token), dtype=bool)
            met[1:] |= same
            met[:-1] |= same
            met |= np.isin(token, np.frombuffer(b"".join(pdf["names"]), dtype=np.uint32).astype(np.uint64))
            out = shares(keys, np.bincount((pair[met] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(keys)))
        return pd.DataFrame(out, columns=["part", "keys", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, which = np.unique(np.frombuffer(b"".join(pdf["keys"]), dtype=np.int64), return_inverse=True)
        r = np.bincount(which, weights=np.frombuffer(b"".join(pdf["counts"]), dtype=np.int32))
        return pd.DataFrame({"key": keys, "r": r.astype(np.int64)})

    dealt = docs.select("text").mapInPandas(deal, "bucket int, tokens binary, keys binary, runs binary, names binary")
    counted = dealt.groupBy("bucket").applyInPandas(count, "part int, keys binary, counts binary")
    return counted.groupBy("part").applyInPandas(add, "key long, r long")


def _least_common(n: np.ndarray | int, percent: int):
    """The least number of common shingles with which a set of n can link."""
    return -(-percent * n // 100)


def _rarities(sets: DataFrame, buckets: int, bucket_tokens: int) -> DataFrame:
    """(id, rarity): for each of the set's sorted hashes a byte, 0 if no other set has it, else the rounded log2 of how many have it.

    Hashes are counted by task first and then by bucket, so a hash that very many sets have is a row a task. The sets' own rows then meet their bucket's counts; a bucket that hot hashes
    make large is salted by set, and its counts are repeated for each salt.
    """

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                h, n = np.unique(np.concatenate([np.frombuffer(raw, dtype=np.uint64) for raw in b["hashes"]]), return_counts=True)
                where = _bucket(h, buckets)
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                out = [(int(where[s]), h[s:e].tobytes(), n[s:e].astype(np.int32).tobytes(), int(n[s:e].sum())) for s, e in zip(cuts, np.append(cuts[1:], len(h)), strict=True)]
                yield pd.DataFrame(out, columns=["bucket", "hashes", "counts", "total"])

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        h, which = np.unique(np.frombuffer(b"".join(pdf["hashes"]), dtype=np.uint64), return_inverse=True)
        n = np.bincount(which, weights=np.frombuffer(b"".join(pdf["counts"]), dtype=np.int32))
        level = np.ceil(np.log2(np.maximum(n, 1))).astype(np.uint8)
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "hashes": [h[level > 0].tobytes()], "levels": [level[level > 0].tobytes()], "salts": [max(1, int(pdf["total"].sum() // (2 * bucket_tokens)))]})

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, raw in zip(b["id"], b["hashes"], strict=True):
                h = np.frombuffer(raw, dtype=np.uint64)
                where = _bucket(h, buckets)
                at = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                out += [(i, int(where[s]), h[s:e].tobytes()) for s, e in zip(at, np.append(at[1:], len(h)), strict=True)]
            yield pd.DataFrame(out, columns=["id", "bucket", "part"])

    def look(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame({"id": [], "bucket": [], "level": []})
        h = np.frombuffer(b"".join(own["part"]), dtype=np.uint64)
        names, level = (np.frombuffer(known[c].iloc[0], dtype=kind) for c, kind in (("hashes", np.uint64), ("levels", np.uint8)))
        at = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
        found = np.where(names[at] == h, level[at], 0).astype(np.uint8) if len(names) else np.zeros(len(h), dtype=np.uint8)
        ends = np.cumsum([len(x) // 8 for x in own["part"]])
        return pd.DataFrame({"id": own["id"], "bucket": own["bucket"], "level": [found[s:e].tobytes() for s, e in zip(np.append(0, ends[:-1]), ends, strict=True)]})

    known = written(sets.select("hashes").mapInPandas(tally, "bucket int, hashes binary, counts binary, total long").groupBy("bucket").applyInPandas(levels, "bucket int, hashes binary, levels binary, salts int"))
    own = sets.select("id", "hashes").mapInPandas(deal, "id long, bucket int, part binary").join(known.select("bucket", "salts"), "bucket").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    parts = own.select("id", "bucket", "salt", "part").groupBy("bucket", "salt").cogroup(spread.select("bucket", "salt", "hashes", "levels").groupBy("bucket", "salt")).applyInPandas(look, "id long, bucket int, level binary")
    return parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "level"))).alias("x")).select("id", F.aggregate("x", F.lit(b""), lambda a, e: F.concat(a, e["level"])).alias("rarity"))


def _prefixes(percent: int):
    """The hashes of which linked sets must have one in common: by rarity the first n - least + 1, without those that no other set has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, hashes = [], []
            for i, raw, rare in zip(b["id"], b["hashes"], b["rarity"], strict=True):
                h, level = np.frombuffer(raw, dtype=np.uint64), np.frombuffer(rare, dtype=np.uint8)
                first = np.lexsort((h, level))[: len(h) - _least_common(len(h), percent) + 1]
                first = first[level[first] > 0]
                ids.append(np.full(len(first), i))
                hashes.append(h[first])
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids).astype(np.int64), "h": np.concatenate(hashes).view(np.int64)})

    return run


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set: the bits that its hashes set."""
    maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
    for row, s in zip(maps, sets, strict=True):
        on = np.zeros(bits, dtype=bool)
        on[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(on)
    return maps.view(np.uint64)


def bits_for(largest: int) -> int:
    """Bits of a bitmap that tells sets of up to so many hashes apart: a power of two of four times as many, from 256 to 65,536."""
    return int(np.clip(1 << int(4 * max(largest, 1) - 1).bit_length(), 256, 1 << 16))


class SignatureTree:
    """Levels of nodes over leaves, the leaves first. A node has the OR of the bitmaps below it, the least and greatest size, the greatest number of hashes that share a bit, and the least and greatest class.

    Leaves are sets, or nodes made elsewhere of many sets. Two nodes all of whose sets are of one class can give nothing new.
    """

    def __init__(self, maps: np.ndarray, lo: np.ndarray, hi: np.ndarray, slack: np.ndarray, first: np.ndarray, last: np.ndarray, fanout: int = 4) -> None:
        self.fanout, self.levels, self.visited = fanout, [(maps, lo, hi, slack, first, last)], 0
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            at = np.arange(0, len(below[0]), fanout)
            how = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip(how, below, strict=True)))

    @classmethod
    def of(cls, sets: list[np.ndarray], classes: np.ndarray) -> SignatureTree:
        """The tree whose leaves are these sets."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        maps = bitmaps(sets, bits_for(int(sizes.max())))
        return cls(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), classes, classes)

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether sets below node a and node b can have the overlap that a link needs, and aren't all of one class."""
        m, lo, hi, slack, first, last = self.levels[level]
        self.visited += len(a)
        need = np.maximum(-(-percent * (lo[a] + lo[b]) // (100 + percent)), _least_common(np.maximum(lo[a], lo[b]), percent))
        ok = (np.minimum(hi[a], hi[b]) >= need) & (hi[a] * 100 >= percent * lo[b]) & (hi[b] * 100 >= percent * lo[a])
        ok &= (np.minimum(first[a], first[b]) != np.maximum(last[a], last[b]))
        for s in range(0, len(a), 4096):
            k = np.flatnonzero(ok[s : s + 4096]) + s
            ok[k] = np.bitwise_count(m[a[k]] & m[b[k]]).sum(axis=1, dtype=np.int64) + np.minimum(slack[a[k]], slack[b[k]]) >= need[k]
        return ok

    def candidates(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of different leaves that the dual traversal, from the root against itself, can't prune."""
        a = b = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            keep = self.possible(level, a, b, percent)
            a, b = a[keep], b[keep]
            below = len(self.levels[level - 1][0])
            i, j = np.meshgrid(np.arange(self.fanout), np.arange(self.fanout), indexing="ij")
            a, b = (a[:, None] * self.fanout + i.ravel()).ravel(), (b[:, None] * self.fanout + j.ravel()).ravel()
            keep = (a <= b) & (b < below)
            a, b = a[keep], b[keep]
        keep = a < b
        a, b = a[keep], b[keep]
        keep = self.possible(0, a, b, percent)
        return a[keep], b[keep]


def join_sets(ids: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, classes: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links between classes, class of each set) that connect whatever the links among these sets connect. With sides given, only pairs across them are compared.

    classes: those that earlier links make, by default a set's id; a set's class in the end is the least of those connected. Sets of one class aren't verified again, so a group
    of copies costs a link for each member.
    """
    order = sorted(range(len(ids)), key=lambda i: (int(sets[i][0]), len(sets[i])))
    classes = np.asarray(ids if classes is None else classes, dtype=np.int64)
    tree = SignatureTree.of([sets[i] for i in order], classes[order])
    parent: dict[int, int] = {c: c for c in classes.tolist()}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*(v.tolist() for v in tree.candidates(percent)), strict=True):
        x, y = order[x], order[y]
        if side is not None and side[x] == side[y]:
            continue
        p, q = root(int(classes[x])), root(int(classes[y]))
        if p != q:
            s, t = sets[x], sets[y]
            common = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * common >= percent * (len(s) + len(t) - common):
                parent[max(p, q)] = min(p, q)
                out.append((max(p, q), min(p, q)))
    return out, np.array([root(c) for c in classes.tolist()], dtype=np.int64)


def _blocked(block: int, block_tokens: int):
    """Cuts a task's sets, which come in order, into blocks of at most `block` sets and about block_tokens hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, tokens = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            out = []
            for n in b["n"]:
                if held >= block or tokens >= block_tokens:
                    number, held, tokens = number + 1, 0, 0
                held, tokens = held + 1, tokens + n
                out.append(number)
            yield b[["component", "id", "n", "hashes"]].assign(block=out)

    return run


def _inside(percent: int):
    """The class of each set of a block by the links inside its part and block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["component", "block", "id"]].assign(**{"class": pdf["id"]})
        for _, at in pdf.groupby("component", sort=False).indices.items():
            if len(at) > 1:
                out.iloc[at, 3] = join_sets(pdf["id"].to_numpy()[at], [np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"].to_numpy()[at]], percent)[1]
        return out

    return run


def _across(percent: int):
    """The links between classes across the two blocks of a pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]]
        return pd.DataFrame(join_sets(pdf["id"].to_numpy(), sets, percent, pdf["block"].to_numpy(), pdf["class"].to_numpy())[0], columns=["a", "b"])

    return run


def _node(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's share of a part as one node of the part's tree."""
    n = pdf["n"].to_numpy()
    maps = bitmaps([np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"]], bits_for(int(pdf["largest"].iloc[0])))
    slack = int((n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)).max())
    one = pdf.iloc[0]
    return pd.DataFrame({"component": [one["component"]], "block": [one["block"]], "map": [np.bitwise_or.reduce(maps, axis=0).tobytes()], "lo": [n.min()], "hi": [n.max()], "slack": [slack]})


def _pairs_of_part(percent: int):
    """The pairs of a part's blocks that the dual traversal of the tree over its nodes can't prune."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        maps = np.frombuffer(b"".join(pdf["map"]), dtype=np.uint64).reshape(len(pdf), -1)
        tree = SignatureTree(maps, *(pdf[c].to_numpy().astype(np.int64) for c in ("lo", "hi", "slack", "first", "last")))
        a, b = tree.candidates(percent)
        blocks = pdf["block"].to_numpy()
        return pd.DataFrame({"component": pdf["component"].iloc[0], "low": blocks[a], "high": blocks[b]})

    return run


def _links(sets: DataFrame, parts: DataFrame, percent: int, block: int, block_tokens: int = 1_000_000) -> DataFrame:
    """Edges (a, b) between sets or their classes that connect what links connect. sets: id, n, first (the least hash), hashes. parts: node, component.

    Sets are put in order of part and least hash, so that like sets lie together, and cut into blocks; each block is joined by trees, one for each part it
    holds. Parts of more than one block go on: first all their blocks meet the part's first one. Then a tree over the part's blocks, whose nodes also know the classes that the links so
    far make, gives the pairs of blocks that can still connect anything, and these are joined. A large group of near copies is of one class by then, and costs no pairs.
    """
    x = sets.join(parts, sets["id"] == parts["node"]).select("component", "id", "n", "first", "hashes")
    x = written(x.repartitionByRange("component", "first", "id").sortWithinPartitions("component", "first", "id").mapInPandas(_blocked(block, block_tokens), "component long, id long, n long, hashes binary, block long"))
    of = written(x.groupBy("block").applyInPandas(_inside(percent), "component long, block long, id long, class long"))
    stars = of.where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b"))
    large = written(x.groupBy("component").agg(F.min("block").alias("hub"), F.max("block").alias("end"), F.max("n").alias("largest")).where("hub < end").select("component", "hub", "largest"))
    if not large.limit(1).count():
        return stars
    x = x.join(large, "component")
    nodes = written(x.groupBy("component", "block").applyInPandas(_node, "component long, block long, map binary, lo long, hi long, slack long"))

    def known(classes: DataFrame) -> DataFrame:
        """The nodes with the least and greatest class of their sets."""
        return nodes.join(classes.groupBy("component", "block").agg(F.min("class").alias("first"), F.max("class").alias("last")), ["component", "block"])

    def joined(pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The links between classes across pairs of blocks (component, low, high)."""
        sides = pairs.select("component", "low", "high", F.explode(F.array("low", "high")).alias("block"))
        sets_of = x.select("component", "block", "id", "hashes").join(sides, ["component", "block"]).join(classes.select("id", "class"), "id")
        return written(sets_of.groupBy("component", "low", "high").applyInPandas(_across(percent), "a long, b long"))

    classes = of.join(large.select("component"), "component", "left_semi")
    hubs = known(classes).join(large, "component")
    hub = hubs.where("block = hub").select("component", F.col("first").alias("f"), F.col("last").alias("l"))
    spokes = written(hubs.where("block > hub").join(hub, "component").where("least(first, f) < greatest(last, l)").select("component", F.col("hub").alias("low"), F.col("block").alias("high")))
    if not spokes.limit(1).count():
        return stars
    cross = joined(spokes, classes)
    now = components(cross)
    classes = written(classes.join(now, classes["class"] == now["node"], "left").select(classes["component"], "block", "id", F.coalesce(now["component"], "class").alias("class")))
    pairs = known(classes).groupBy("component").applyInPandas(_pairs_of_part(percent), "component long, low long, high long")
    rest = written(pairs.join(large, "component").where("low > hub").select("component", "low", "high"))
    if rest.limit(1).count():
        cross = cross.unionByName(joined(rest, classes))
    return stars.unionByName(cross)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = 2_000_000, block: int = 256, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs. Components are exact; of the links only so many are made as connect them.

    Two documents link when 100 * |intersection| >= percent * |union| of their sets of word runs; component_id is the smallest id
    reachable by links. Documents without words (null, empty or white space) link with nothing and are their own component. Equal
    sets are one node from the start. Rows that repeat an id are each judged by their own text; a null id is never the
    smallest unless it stands alone, and then its component is null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = written(set_keys(rows, words))
    nodes = written(keys.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    met = _repeated_counts(rows, words, max(16, -(-total // bucket_tokens)), max(8, -(-nodes.count() // 200_000)))
    alive = written(nodes.join(met, "key").where(F.col("r") * 100 >= F.col("n") * percent).select("key", "rep"))
    reps = alive.select("rep").distinct()
    chosen = rows.join(F.broadcast(reps) if alive.count() <= broadcast_rows else reps, rows["doc_id"].eqNullSafe(reps["rep"]), "left_semi")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [s for t in b["text"] if len(s := shingles(t, words))]
            yield pd.DataFrame({"id": [_key8(s) for s in sets], "n": [len(s) for s in sets], "first": [int(s[0].astype(np.int64)) for s in sets], "hashes": [s.tobytes() for s in sets]})

    sets = written(chosen.mapInPandas(full, "id long, n long, first long, hashes binary").join(alive, F.col("id") == F.col("key"), "left_semi").dropDuplicates(["id"]))
    size = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    rare = _rarities(sets, max(16, -(-size // bucket_tokens)), bucket_tokens)
    prefix = written(sets.select("id", "hashes").join(rare, "id").mapInPandas(_prefixes(percent), "id long, h long"))
    least = prefix.groupBy("h").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "m")
    parts = components(prefix.join(least, "h").select(F.col("id").alias("a"), F.col("m").alias("b")))
    joined = components(_links(sets, parts, percent, block))
    inside = nodes.join(joined, nodes["key"] == joined["node"]).select("key", "rep", "component")
    first = inside.groupBy("component").agg(F.min("rep").alias("first"))
    found = inside.join(first, "component").select(F.col("key").alias("_k"), "first")
    of = written(nodes.join(found, nodes["key"] == F.col("_k"), "left").select(F.col("key").alias("_key"), F.coalesce("first", "rep").alias("component")))
    out = keys.join(of, keys["key"] == of["_key"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components over all documents, four words and 85 per cent."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def oracle(words: int, percent: int) -> str:
    """DuckDB SQL for jaccard_components: all shingles, all pairs that share one, and the closure of the links."""
    slices = ", ".join(f"w[i + {k}]" for k in range(words))
    return f"""
with recursive cut as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sh as materialized (select distinct doc_id, s from (
  select doc_id, unnest(list_transform(range(1, len(w) - {words} + 2), lambda i: concat_ws(' ', {slices}))) as s from cut where len(w) >= {words}
  union all select doc_id, array_to_string(w, ' ') as s from cut where len(w) between 1 and {words - 1})),
sz as materialized (select doc_id, count(*) as n from sh group by doc_id),
pair_of as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
lk as materialized (select a, b from pair_of join sz x on x.doc_id = a join sz y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
ed as materialized (select a, b from lk union all select b, a from lk),
reach(doc_id, r) as (select a, a from ed union select reach.doc_id, ed.b from reach join ed on ed.a = reach.r)
select d.doc_id, coalesce(sz.n, 0) as n_shingles, coalesce(m.r, d.doc_id) as component_id
from documents d left join sz using (doc_id) left join (select doc_id, min(r) as r from reach group by doc_id) m using (doc_id)"""
