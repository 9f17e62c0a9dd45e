"""Vector operators against brute force."""

import math
from statistics import NormalDist

import numpy as np

from tidelog.llm import near_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def table_of(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], "clash") for i, v in enumerate(x)] + list(extra), SCHEMA)


ODD = [(1000, None, ""), (1001, [0.0] * 16, ""), (1002, [float("nan")] + [1.0] * 15, ""), (1003, [None] + [1.0] * 15, ""), (1004, [float("inf")] * 16, ""), (1005, [1.0, 2.0], ""), (None, [1.0] * 16, ""), (1006, [], "")]


def sample(seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[100:140] = x[7] + 0.12 * rng.normal(size=(40, 16))
    x[140:150] = x[8] * 3.5
    x[150] = x[8]
    return x.astype(np.float32)


def test_links_are_those_of_brute_force(spark):
    x = sample()
    got = {r["vec_id"]: r for r in near_vectors.link_vectors(table_of(spark, x, ODD), block=16).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(comp, np.where(linked, comp[None, :], 10**9).min(axis=1))
        if (low == comp).all():
            break
        comp = low
    want, have = linked.sum(), sum(got[i]["n_links"] for i in range(len(x)))
    assert have <= want and have >= 0.97 * want
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(len(x)))
    if have == want:
        assert [got[i]["component_id"] for i in range(len(x))] == comp.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(1000, 1007))
    assert got[None]["n_links"] == 0 and len(got) == len(x) + len(ODD)


def test_pairs_at_the_threshold_share_filters_at_any_size():
    """Pairs at a cosine of 0.9 exactly, drawn apart from the pairs that set the number of books; one book finds 92 % of them at 4 million rows."""
    rng = np.random.default_rng(77)
    x, e = rng.normal(size=(500, 64)), rng.normal(size=(500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * e / np.linalg.norm(e, axis=1, keepdims=True)
    for n in (25_000, 1_000_000, 4_000_000, 117_000_000):
        m = math.ceil(math.sqrt(n / 8))
        tau = NormalDist().inv_cdf(1 - 24 / (m * m)) / math.sqrt(64) * math.sqrt(2)
        books = near_vectors.code_books(n, 64, 0.9, m, tau, 12, 8, 24, 15, 29)
        both = zip(near_vectors.decode_all(x, books, m, tau, 12), near_vectors.decode_all(y, books, m, tau, 12), strict=True)
        n_shared = [len(np.intersect1d(a, b)) for a, b in both]
        assert np.mean(n_shared) >= 13 and np.mean([k > 0 for k in n_shared]) >= 0.995, n


def test_several_books_count_each_link_once(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16))
    x[3000:] = x[:3000] + 0.12 * rng.normal(size=(3000, 16))
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.link_vectors(table_of(spark, x.astype(np.float32)), per_filter=2, filters_per_vector=12, shared=40).collect()}
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= linked[i] for i in range(len(x))) and sum(got.values()) >= 0.999 * linked.sum()


def test_a_pair_at_the_threshold_links(spark):
    """Cosines of 90/100 by doubles, and the nearest ones below."""
    a, b, c = np.zeros((3, 64), dtype=np.float32)
    a[0] = 1
    b[:4] = 9, 3, 3, 1
    c[:4] = 9, 3, 3, 1.0001
    rows = [a, b, c, a * 3, b * 0.1]
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.link_vectors(table_of(spark, rows)).collect()}
    u = [[float(v) for v in r] for r in rows]
    cos = lambda x, y: math.fsum(p * q for p, q in zip(x, y)) / (math.sqrt(math.fsum(p * p for p in x)) * math.sqrt(math.fsum(p * p for p in y)))
    want = {i: sum(cos(x, y) >= 0.9 for j, y in enumerate(u) if j != i) for i, x in enumerate(u)}
    assert got == want and cos(u[0], u[1]) == 0.9 and cos(u[0], u[2]) < 0.9


def test_links_at_the_tables_dimension(spark):
    """64 dimensions, where the given tables have no link: clusters at cosines of 0.85 to 1, some vectors copied, repeated ids."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x[500:] = x[rng.integers(0, 60, size=1000)] + rng.uniform(0.2, 0.5, size=(1000, 1)) * rng.normal(size=(1000, 64))
    x[1400:] = x[500:600] * 2
    x = x.astype(np.float32)
    again = [(3, [float(v) for v in x[3]], ""), (4, [float(v) for v in x[900]], "")]
    got = {}
    for r in near_vectors.link_vectors(table_of(spark, x, again)).collect():
        assert got.setdefault(r["vec_id"], r["n_links"]) == r["n_links"]
    u = x.astype(np.float64)
    u[4] = min((x[4], x[900]), key=lambda v: v.astype("<f4").tobytes())
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert linked.sum() > 2000 and sum(got.values()) >= 0.99 * linked.sum() and all(got[i] <= n for i, n in enumerate(linked))


def test_vector_tables_of_nothing(spark):
    for rows in ([], ODD[:2]):
        t = spark.createDataFrame(rows, SCHEMA)
        assert near_vectors.link_vectors(t).count() == len(rows)
        assert nearest.search(t, lambda i: i % 50 == 0).count() == 0


def test_nearest_recall_ties_and_scores(spark):
    x = sample(3, 600)
    got = nearest.search(table_of(spark, x, ODD), lambda i: i % 50 == 0, block=64).collect()
    u = x.astype(np.float64)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        a, b = u[r["query_id"]], u[r["vec_id"]]
        assert abs(r["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(by) == set(range(0, 600, 50))
    n = u / np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q, found in by.items():
        assert found == sorted(found) and len(found) == 5 and q not in [v for _, v in found]
        s = n @ n[q]
        s[q] = -9
        hits += len({v for _, v in found} & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(by)


def test_repeated_ids_and_doubles(spark):
    """An id's vector is the least in byte order; columns of doubles are taken as they are."""
    x = np.random.default_rng(4).normal(size=(80, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(50, [float(c) for c in x[7]]), (0, [float(c) for c in x[0]])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x[50] = min((x[50], x[7]), key=lambda v: v.astype("<f8").tobytes())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[[0, 50]] @ u.T
    s[0, 0] = s[1, 50] = -9
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in nearest.search(t, lambda i: i % 50 == 0, recall=1.0).collect()}
    right = [got[q, r + 1] == int(v) for q, row in zip((0, 50), s, strict=True) for r, v in enumerate(np.argsort(-row, kind="stable")[:5])]
    assert len(got) == 10 and sum(right) >= 9


def test_cells_are_finer_where_neighbours_are_close():
    """Clusters make fine cells, few of which hold a query's neighbours; vectors at random make coarse ones."""
    rng = np.random.default_rng(1)
    for spread, most in ((0.05, 0.2), (1.0, 1.0)):
        x = rng.normal(size=(150, 32))[rng.integers(0, 150, size=3000)] + spread * rng.normal(size=(3000, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x[:40] @ x.T
        s[np.arange(40), np.arange(40)] = -9
        near = [x[np.argsort(-r)[:5]] for r in s]
        projections, width, probes = nearest.fit_shape(x[:40], near, x, 10**6, 20_000, 4, 0.95, 31)
        dirs, off = nearest.family(32, 4, projections, width, 31)
        met = hits = 0
        for i in range(40):
            seen = np.zeros(3000, dtype=bool)
            for t in range(4):
                f = (x @ dirs[t] + off[t]) / width
                seen |= np.isin(nearest._code(np.floor(f).astype(np.int64)), nearest.probed(f[i], probes))
            met += seen.sum()
            hits += seen[np.argsort(-s[i])[:5]].sum()
        assert hits >= 0.9 * 200 and met <= most * 40 * 3000, (spread, projections, width, probes, met / 120_000)


def test_few_candidates_are_all_found(spark):
    x = np.eye(4, 16, dtype=np.float32)
    x[3] = -x[0]
    got = nearest.search(table_of(spark, x), lambda i: i % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]


def test_probe_order_is_by_estimated_success():
    low = np.array([0.1, 0.6, 0.95])
    cost = lambda moves: sum((low[i] if s < 0 else 1 - low[i]) ** 2 for i, s in moves)
    got = nearest.probe_order(low, 30)
    assert got[0] == () and len(set(map(frozenset, got))) == len(got) == 27
    assert [cost(m) for m in got] == sorted(cost(m) for m in got)
