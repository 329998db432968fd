import random

import pytest
from helpers_llm import text

from warung.llm import mixing as M


def test_alpha():
    shares = [0.7, 0.2, 0.1]
    a = M.fit_alpha(shares, max_repeat=2.0)
    assert abs(max(M.repetitions(shares, M.tempered(shares, a))) - 2.0) < 1e-6
    b = M.fit_alpha(shares, min_entropy=1.0)
    assert abs(M.entropy(M.tempered(shares, b)) - 1.0) < 1e-6
    assert M.fit_alpha(shares, max_repeat=100) == 0.0 and M.fit_alpha(shares, min_entropy=0.1) == 1.0
    assert M.fit_alpha([], max_repeat=2) == 1.0 and M.fit_alpha([1.0], max_repeat=2) in (0.0, 1.0)
    with pytest.raises(ValueError):
        M.fit_alpha(shares)


def corpus(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, lines=1, words=rng.randint(1, 40)), s) for i in range(400) for s in [rng.choice("aaaaaaabbc")]]
    rows += [(1000, None, "c"), (1001, "", None), (1002, "x", None), (1002, "x", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'k' AS _mix_rest", "'b' AS mix_block", "1 AS _rest")


def test_budgets(spark):
    rows, docs = corpus(spark)
    out = M.mix(docs, max_repeat=1.6, blocks=8).collect()
    tokens = lambda t: max(1, len((t or "").split()))
    total, got = {}, {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + tokens(t)
    for r in out:
        got[r.source] = got.get(r.source, 0) + r.mix_tokens
    assert {(r.doc_id, r.source) for r in out} == {(i, s) for i, _, s in rows}       # nothing is lost
    big = max(total, key=total.get)
    assert got[big] == total[big]
    n = sum(total.values())
    names = sorted(total, key=str)
    alpha = M.fit_alpha([total[s] / n for s in names], max_repeat=1.6)
    times = M.repetitions([total[s] / n for s in names], M.tempered([total[s] / n for s in names], alpha))
    for s, k in zip(names, times):
        assert total[s] <= got[s] <= k * total[s] + 0.5 and got[s] >= k * total[s] - 41
    for r in out:
        assert 0 <= r.mix_epoch <= 1
    again = M.mix(docs.repartition(7), max_repeat=1.6, blocks=8).collect()
    key = lambda rs: sorted((r.doc_id, r.mix_epoch, r.mix_block) for r in rs)
    assert key(out) == key(again)


def test_empty_table_and_too_many_sources(spark):
    _, docs = corpus(spark)
    assert M.mix(docs.where("doc_id < 0"), max_repeat=2.0).count() == 0
    with pytest.raises(ValueError):
        M.mix(docs, max_repeat=2.0, max_sources=2)


def test_more_sources_than_a_driver_table(spark):
    rows = [(i, "w " * (1 + i % 7), f"host{i % 5000}") for i in range(5600)] + [(9000 + i, "w " * 50, "big") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, got, took = {}, {}, {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + len(t.split())
    n, names = sum(total.values()), sorted(total)
    for limit in ({"max_repeat": 1.5}, {"min_entropy": 8.3}):
        got.clear()
        took.clear()
        for r in M.mix(docs, blocks=8, **limit).collect():
            got[r.source] = got.get(r.source, 0) + r.mix_tokens
            took[r.source] = r.mix_weight
            assert r.mix_tokens == len(rows[r.doc_id if r.doc_id < 5600 else r.doc_id - 3400][1].split())
        shares = [total[s] / n for s in names]
        weights = M.tempered(shares, M.fit_alpha(shares, **limit))
        for s, w, k in zip(names, weights, M.repetitions(shares, weights)):
            assert abs(took[s] - w) < 1e-9 and total[s] <= got[s] <= k * total[s] + 0.5001, (s, limit)
            assert got[s] >= k * total[s] - 50
        assert got["big"] == total["big"]


def test_documents_without_an_id_are_blocks_of_their_own(spark):
    wide = spark.range(1000).selectExpr("id AS doc_id", "concat('w', id, ' a b c d e f g h i') AS text", "'large' AS source")
    for key in ("cast(null AS bigint)", "id + 5000"):
        small = spark.range(400).selectExpr(f"{key} AS doc_id", "concat('v', id, ' a b c d e f g h i') AS text", "'small' AS source")
        taken = M.mix(wide.unionByName(small), max_repeat=1.5).where("source = 'small'").agg({"mix_tokens": "sum"}).first()[0]
        assert 5990 <= taken <= 6000
