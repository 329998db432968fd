import random

import numpy as np
from helpers_llm import WORD, text

from warung.llm import quality_rules as Q


def brute(t):
    words = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            inside |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside))


def test_counts_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a\na\n\nb", "é ü x y", "x " * 30, "#*$ %&|<>", "a b c d e a b c d e"]
    for _ in range(40):
        t = text(rng, rng.choice(["en", "fr"]), rng.randint(1, 6))
        texts.append(t + rng.choice(["", "\n" + t, "\n" + t[: len(t) // 2], " ### |"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in Q.statistics(docs).collect():
        assert tuple(r[c] for c in Q.COUNTS) == brute(texts[r["_id"]]), texts[r["_id"]]


def test_rules_find_what_was_planted(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(("$$%" + w if bad else w) for w in text(rng).split(" "))))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, None), (1001, "short"), (1002, "same five words come again " * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS quality", "'x' AS rule")
    lab = spark.createDataFrame(labels + [(3, 0), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in Q.quality(docs, lab).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept == (i % 3 != 0) for i in range(300))
    assert all(out[i].base_failed and not out[i].kept for i in (1000, 1001, 1002))


def test_without_labels_and_without_rows(spark):
    docs = spark.createDataFrame([(1, "w " * 3 + "a b c d e f g h i j k")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality(docs, lab).first().kept
    assert Q.quality(docs.where("doc_id > 1"), lab).count() == 0


def test_covering_keeps_what_no_rule_covers():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    noise = rng.random(600) < 0.2
    assert Q.learn_rules(x, noise) == []
    rules = Q.learn_rules(x, (x["a"] > 0.7) & (x["b"] <= 0.4))
    assert rules and all(len(r) <= 3 for r in rules)
