import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from helpers import PAIRS_SCHEMA
from warung.operators import graph


def test_pairs_small(spark):
    p = spark.createDataFrame([("A", "B", 3), ("A", "C", 1)], PAIRS_SCHEMA)
    vol = [(r.category, r.volume, r.ord) for r in graph.category_volume(p).orderBy("ord").collect()]
    assert vol == [("A", 4, 1), ("B", 3, 2), ("C", 1, 3)]
    cells = {(r.y, r.x): r.z for r in graph.co_purchase_matrix(p).collect()}
    assert len(cells) == 4 and ("B", "C") not in cells    # an absent pair means 0
    assert cells[("A", "B")] == cells[("B", "A")] == 3.0
    assert all((k, k) not in cells for k in "ABC")
    dens = graph.graph_density(p).first()
    assert (dens.n_categories, dens.n_pairs, dens.possible) == (3, 2, 3)
    assert abs(dens.density - 200 / 3) < 1e-9 and dens.text == "67%"


def test_matrix_properties(spark):
    p = spark.createDataFrame([("A", "B", 3), ("A", "C", 1), ("B", "D", 5), ("C", "D", 2)],
                              PAIRS_SCHEMA)
    cells = graph.co_purchase_matrix(p).collect()
    total = sum(r.z for r in cells if r.z is not None)
    vol = sum(r.volume for r in graph.category_volume(p).collect())
    assert total == 2 * (3 + 1 + 5 + 2) == vol
    m = {(r.y, r.x): r.z for r in cells}
    assert all(m[(a, b)] == m[(b, a)] for a, b in m)


def test_tile_draws_every_cell(spark):
    p = spark.createDataFrame([("A", "B", 3), ("A", "C", 1), ("B", "D", 5), ("C", "D", 2)], PAIRS_SCHEMA)
    # volumes: B 8, D 7, A 4, C 3
    whole = {(r.y, r.x): r.z for r in graph.co_purchase_tile(p).collect()}
    assert len(whole) == 16
    assert all(whole[(k, k)] is None for k in "ABCD")
    assert whole[("B", "C")] == whole[("C", "B")] == whole[("A", "D")] == whole[("D", "A")] == 0.0
    sparse = {(r.y, r.x): r.z for r in graph.co_purchase_matrix(p).collect()}
    assert {k: z for k, z in whole.items() if z} == sparse
    # a tile off the diagonal, and one that reaches past the last node
    tile = graph.co_purchase_tile(p, y_from=1, x_from=3, size=2).collect()
    assert {(r.y_ord, r.y, r.x_ord, r.x): r.z for r in tile} == {
        (1, "B", 3, "A"): 3.0, (1, "B", 4, "C"): 0.0, (2, "D", 3, "A"): 0.0, (2, "D", 4, "C"): 2.0}
    assert [(r.y, r.x) for r in graph.co_purchase_tile(p, 4, 4, 2).collect()] == [("C", "C")]
    assert graph.co_purchase_tile(spark.createDataFrame([], PAIRS_SCHEMA)).count() == 0


def test_pairs_duplicate_is_an_error(spark):
    p = spark.createDataFrame([("A", "B", 3), ("B", "A", 2)], PAIRS_SCHEMA)
    with pytest.raises((PySparkException, Py4JJavaError)):
        graph.co_purchase_matrix(p).collect()


def test_one_node_density_null(spark):
    p = spark.createDataFrame([], PAIRS_SCHEMA)
    dens = graph.graph_density(p).first()
    assert dens.n_categories == 0 and dens.density is None and dens.text is None


def test_top_pairs_and_texts(spark):
    p = spark.createDataFrame([("A", "B", 3), ("A", "C", 3), ("B", "C", 1500)], PAIRS_SCHEMA)
    top = graph.top_pairs(p, 2).collect()
    assert [(r.label, r.text) for r in top] == [("B  +  C", "1,500"), ("A  +  B", "3")]
    edges = {r.text for r in graph.graph_edges(p).collect()}
    assert "B + C: 1,500 order" in edges
    nodes = {r.text for r in graph.graph_nodes(p).collect()}
    assert "C — 1,503 co-purchase" in nodes


def test_self_pair_counts_twice_in_both_volume_paths(spark):
    p = spark.createDataFrame([("A", "A", 2), ("A", "B", 3)], PAIRS_SCHEMA)
    vol = {r.category: r.volume for r in graph.category_volume(p).collect()}
    assert vol == {"A": 2 + 2 + 3, "B": 3}
    cells = graph.co_purchase_matrix(p).collect()
    order = {r.y: r.y_ord for r in cells}
    assert order == {"A": 1, "B": 2}                      # same volume order as category_volume
    m = {(r.y, r.x): r.z for r in cells}
    assert ("A", "A") not in m and m[("A", "B")] == m[("B", "A")] == 3.0
