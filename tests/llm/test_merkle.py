import hashlib
import zlib

import pytest

from warung.llm import merkle as M

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, _rid int, tree string"


def brute(rows, fanout=8):
    """Expected rows from the definition, with whole lists."""
    def leaf(r, text):
        parts = [r[0], r[3], r[2], r[4], text]
        return H("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))

    def grow(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k:k + fanout])) for k in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            a = k // fanout * fanout
            run = level[a:a + fanout]
            out.append((k - a, run[:k - a] + run[k - a + 1:]))
            k //= fanout
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    made = {}
    for n in names:
        trees[n].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made[n] = grow([leaf(r, r[1]) for r in trees[n]])
    top = grow([made[n][-1][0] for n in names])
    root = top[-1][0] if names else None
    out = []
    for t, n in enumerate(names):
        for k, r in enumerate(trees[n]):
            steps = path(made[n], k) + path(top, t)
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for place, others in steps:
                node = H("".join(others[:place] + [node] + others[place:]))
            out.append((r[0], made[n][0][k], made[n][-1][0], root, H("".join("".join(o) for _, o in steps)), node, node == root))
    return out


def corpus():
    rows = [(i, f"Text {i} É" if i % 5 else f"low {i}", ["en", "de", "é", None][i % 4 if i % 7 else 0], "s" if i % 3 else None, i) for i in range(401)]
    rows += [(None, "Null id", "en", "s", 1)] * 3 + [(5000, None, "xx", None, None), (5001, "", "yy", "s", 0), (7, "Text seven again", "de", "s", 2), (5002, "Ab " * 50_000, "en", "s", 3)]
    return rows + rows[:2]


@pytest.mark.parametrize("levels, fanout", [(3, 8), (1, 8), (1, 2), (2, 3)])
def test_against_brute_force(spark, levels, fanout):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in M.manifest(spark, docs, received=M.tampered_leaf(), levels=levels, fanout=fanout).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, fanout), key=str)
    assert not all(r[-1] for r in got) and sum(r[-1] for r in got) > len(got) / 2


@pytest.mark.parametrize("n", [1, 2, 8, 9, 17, 64, 65, 73, 129])
def test_sizes_around_full_runs(spark, n):
    rows = [(i, f"T{i}", "en", None, i) for i in range(n)]
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], SCHEMA)
    got = [tuple(r) for r in M.manifest(spark, docs, received=M.tampered_leaf(), levels=1).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_every_tree_its_own_and_an_empty_table(spark):
    rows = [(i, f"T{i}", f"lang{i}", None, i) for i in range(90)]
    docs = spark.createDataFrame([(*r, "x", 1, "t") for r in rows], SCHEMA)
    got = [tuple(r) for r in M.manifest(spark, docs, received=M.tampered_leaf(), levels=1).collect()]
    assert sorted(got) == sorted(brute(rows))
    assert M.manifest(spark, docs.where("doc_id < 0")).count() == 0


def test_a_block_gets_few_messages(spark):
    """No block is a hub: in every round each block is sent ``fanout`` rows at most."""
    leaves = spark.range(0, 600, 1, 4).selectExpr("'t' AS tree", "id", "sha2(cast(id AS string), 256) AS leaf", "cast(null AS string) AS other")
    held = M.blocks(spark, leaves, ["id"], 8, 1)
    up = M.butterfly(spark, held, 8, 1).collect()
    assert len(up) == 75 and len({r.digest for r in up}) == 1
    assert all(len(r.path) == 3 and all(len(s) <= 7 for s in r.path) for r in up)
