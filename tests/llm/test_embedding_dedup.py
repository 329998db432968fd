import numpy as np
import pytest
from helpers_llm import components

from warung.llm import embedding_dedup as E

INF, NAN = float("inf"), float("nan")


def corpus(dim=24):
    rng = np.random.default_rng(9)
    rows = []
    for g in range(40):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 8) if g else 60):
            v = base + rng.normal(size=dim) * rng.choice([0.0, 0.05, 0.12, 0.16]) * np.linalg.norm(base) / np.sqrt(dim)
            rows.append((len(rows), (v * rng.choice([1.0, 3.0])).tolist(), int(g % 3)))
    zero, good = [0.0] * dim, rows[0][1]
    return rows + [(900, None, 1), (901, zero, 1), (902, zero, 1), (903, good, None), (904, good[:-1] + [NAN], 0), (905, good[:-1] + [INF], 0),
                   (906, good[:-1] + [None], 0), (907, [], 0), (908, good, 0), (909, good, 0), (910, good[:10], 0), (911, good, 2)]


def brute(rows, threshold=0.98):
    ok = [(i, np.array(v, dtype=float), label) for i, v, label in rows
          if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for k, (a, x, lx) in enumerate(ok) for b, y, ly in ok[k + 1:]
             if lx == ly and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, components(list(count), links)


@pytest.mark.parametrize("block,blocks", [(2048, None), (5, 2)])
def test_against_brute_force(spark, block, blocks):
    rows = corpus()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS id", "2 AS cell").repartition(4)
    out = {r.vec_id: r for r in E.near_duplicates(spark, df, block=block, blocks=blocks).collect()}
    count, group = brute(rows)
    assert {i: r.n_links for i, r in out.items()} == count
    assert {i: r.component_id for i, r in out.items()} == group
    assert all(r.kept == (i == r.component_id) for i, r in out.items())


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(3000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    both = np.concatenate([u, 0.98 * u + np.sqrt(1 - 0.98 ** 2) * w])
    tables = E.tables_for(0.98, 64, 1e-4, 0.35, 2, 1, 17)
    found = np.zeros(3000, dtype=bool)
    for t in range(tables):
        home, around = E.cells(both, t, step=E.cell_step(0.98, 64, 0.35), probes=2, blocks=1, seed=17)
        found |= E._meets(home, around, np.arange(3000), np.arange(3000) + 3000)
    assert found.mean() >= 0.999


def test_lattice_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    p = E.nearest_e8(x)
    around = p[:, None, :] + E.shortest_vectors()[None]
    assert E.shortest_vectors().shape == (240, 8)
    assert (((x - p) ** 2).sum(1)[:, None] <= ((x[:, None] - around) ** 2).sum(2) + 1e-9).all()


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(spark, df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert E.near_duplicates(spark, df.where("vec_id > 5")).count() == 0


def test_rows_without_an_id(spark):
    rng = np.random.default_rng(4)
    one, two, three = (rng.normal(size=24) for _ in range(3))
    rows = [(None, one.tolist(), 0), (7, (one + 1e-3).tolist(), 0), (5, (one + 2e-3).tolist(), 0), (None, two.tolist(), 0), (None, (two + 1e-3).tolist(), 0),
            (None, three.tolist(), 1), (8, three.tolist(), 0), (None, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = E.near_duplicates(spark, df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (None, 2, 5, False), (7, 2, 5, False), (5, 2, 5, True), (None, 1, None, True), (None, 1, None, True),
        (None, 0, None, True), (8, 0, 8, True), (None, 0, None, True)]))
