import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from helpers_llm import text
from pyspark.sql import functions as F

from warung.llm import suffix_dedup as M
from warung.llm.store import CLEANUP, saved


def brute(docs):
    count = Counter()
    for _, t in docs:
        count.update(t[i:i + 200] for i in range(len(t) - 199))
    out = []
    for k, t in docs:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                cover[i] += 1
                cover[i + 200] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    passages = [text(rng, lines=1, words=w) for w in (25, 40, 60, 90)]
    docs = []
    for d in range(60):
        parts = [text(rng, rng.choice(["en", "fr"]), 1, rng.randint(3, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randrange(0, 30)
            parts.insert(rng.randrange(len(parts) + 1), p[a:len(p) - rng.randrange(0, 30)])
        docs.append((d, " ".join(parts)))
    docs += [(100, docs[0][1]), (101, "a" * 500), (102, "xyz" * 150), (103, "xyz" * 70 + "!"), (104, None), (105, ""), (106, "short"),
             (107, "row twice " * 30), (107, "row twice " * 30), (108, "b" * 199), (109, "b" * 200), (110, "c" * 201)]
    return docs


@pytest.mark.parametrize("group", [2048, 1])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setitem(M.repeated_spans.__kwdefaults__, "group", group)
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1L AS rid", "'x' AS key").repartition(4)
    got = sorted(tuple(r) for r in M.remove_repeats(spark, rows).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute([(k, (t or "").encode()) for k, t in docs])


def test_empty_table(spark):
    assert M.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_follow_the_text():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 110, 600).astype(np.uint8)
    a = M.anchors(np.concatenate([rng.integers(97, 110, 333).astype(np.uint8), body]))
    b = M.anchors(np.concatenate([rng.integers(97, 110, 77).astype(np.uint8), body]))
    inner = lambda x, cut: {(int(p) - cut, int(k)) for p, k in zip(x[0], x[1]) if 150 <= p - cut < 400}
    assert inner(a, 333) == inner(b, 77) and inner(a, 333)


def test_levels_merge_geometrically(spark):
    family = M.Family(spark)
    for k in range(6):
        family.add(spark.range(k * 10, k * 10 + 12).withColumnRenamed("id", "key"))
    assert [size for size, _ in family.levels] == [4, 2]
    assert sorted(r.key for r in family.keys().collect()) == sorted(10 * k + j for k in range(1, 6) for j in (0, 1))


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    before, setting = files(), spark.conf.get(CLEANUP)
    table = saved(spark, spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and table.count() == 7
    assert spark.conf.get(CLEANUP) == setting
