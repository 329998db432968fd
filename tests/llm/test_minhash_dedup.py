import random

import pytest
from helpers_llm import WORD, components, text

from warung.llm import minhash_dedup as M


def brute(docs, k=4):
    sets = {}
    for d, t in docs:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components(ids, links)


def corpus(copies=6):
    rng = random.Random(6)
    docs = []
    for g in range(12):
        base = text(rng, rng.choice(["en", "de"]), 5).split(" ")
        for _ in range(copies if g else 5 * copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                words[rng.randrange(len(words))] = "w%d" % rng.randrange(99)
            docs.append((len(docs), " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE  two"), (1005, "one"), (1006, docs[0][1].upper())]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("small", [64, 3])
def test_against_brute_force(spark, small):
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS class").repartition(4)
    sizes, groups = brute(docs)
    out = {r.doc_id: r for r in M.near_duplicates(spark, rows, small_node=small, comparisons=1 << 24 if small == 64 else 8, block=8, depth=3).collect()}
    assert {d: r.n_shingles for d, r in out.items()} == sizes
    assert {d: r.component_id for d, r in out.items()} == groups
    assert all(r.kept == (d == r.component_id) for d, r in out.items())


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "f g h i j"), (None, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    got = [tuple(r) for r in M.near_duplicates(spark, rows).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, None, False)] * 2 + [(1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)
    assert M.near_duplicates(spark, rows.where("doc_id > 5")).count() == 0


def test_pairs_lost_by_the_estimate():
    import math
    least = math.ceil(M.least_agreement(0.8) * M.POSITIONS)
    lost = sum(math.comb(M.POSITIONS, k) * 0.8 ** k * 0.2 ** (M.POSITIONS - k) for k in range(least))
    assert lost < 5e-5                             # 1e-4 at four deviations


def alike(n=110, links=8):
    """Texts of one base, nearly all pairs of which are alike but not enough."""
    rng = random.Random(8)
    base = text(rng, "en", 16).split()
    docs = []
    for d in range(n):
        words = list(base)
        for at in rng.sample(range(len(words)), 5):
            words[at] = "v%d" % rng.randrange(10**6)
        docs.append((d, " ".join(words)))
    for d in range(links):
        words = docs[d][1].split(" ")
        words[-1 - d] = "x%d" % d
        docs.append((n + d, " ".join(words)))
    return docs


@pytest.mark.parametrize("items", [1 << 20, 5000])
def test_loosely_alike_texts_make_no_table_of_pairs(spark, monkeypatch, items):
    docs, made = alike(), {}

    def counted(spark, df, name, save=M.saved):
        made[name] = (out := save(spark, df, name)).count()
        return out

    monkeypatch.setattr(M, "saved", counted)
    if hasattr(M, "_bundles"):                    # sets of a bundle cut among tasks
        monkeypatch.setattr(M, "_bundles", lambda *a, cut=M._bundles: cut(*a, items=items))
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.component_id for r in M.near_duplicates(spark, rows).collect()}
    assert out == brute(docs)[1]
    tables = {name: n for name, n in made.items() if not name.startswith(("cps-nodes", "cps-level", "cps-held", "cps-asking"))}
    if items == 1 << 20:                          # parts of a bundle hold its rows again
        assert max(tables.values()) <= made["cps-nodes"], made


def test_bundles_keep_a_class_that_asks_and_is_asked(spark):
    rng = random.Random(9)
    docs, rows = [], []
    for node in range(40):
        words = text(rng, "en", 8).split()
        for d in (2 * node, 2 * node + 1):
            docs.append((d, " ".join(words), d, 0))
            rows += [(node, d, side) for side in ("left", "right")]
            words[40] = "other"
    sets = M._sets(spark.createDataFrame(docs, "doc_id long, text string, k1 long, k2 int"), 4).localCheckpoint()
    held = (spark.createDataFrame(rows, "node long, doc_id long, side string").join(sets, "doc_id")
            .selectExpr("node", "0 AS ga", "0 AS gb", "class", "small", "n", "class AS comp", "side = 'left' AS is_left", "side = 'right' AS is_right"))
    bundles = M._bundles(held, M.least_agreement(0.8), 80).localCheckpoint()
    assert bundles.count() == 80 and bundles.where("is_left and is_right").count() == 80
    items = M._full_sets(spark.createDataFrame(docs, "doc_id long, text string, k1 long, k2 int"), sets.select("k1", "k2", "class"), 4)
    assert M._joined(bundles, items, M.least_agreement(0.8), 80).count() == 40
