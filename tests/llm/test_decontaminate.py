import hashlib
import random
import re

import pytest
from helpers_llm import text

from warung.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = tokens(t)
        for g in [tuple(w[k:k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] * bool(w):
            grams.setdefault(g, set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = tokens(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (who := grams.get(tuple(w[k:k + size]))):
                    hit |= set(range(k, k + size))
                    found |= {str(i) for i in who if i is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fixture():
    rng = random.Random(12)
    items = [(i, text(rng, words=20, lines=2)) for i in range(12)]
    shared = text(rng, words=14, lines=1)
    items += [(20, f"{shared} {text(rng, lines=1)}"), (21, f"{text(rng, lines=1)} {shared}"), (22, "Seven words, ÉTÉ; that are a window"), (23, None), (24, " .\n"),
              (25, items[0][1].upper()), (None, text(rng, words=15, lines=1)), (2, text(rng, words=12, lines=1)), (26, "one")]
    docs = [(k, text(rng, rng.choice(["en", "fr"]), 6)) for k in range(30)]
    for k, (_, t) in enumerate(items):
        if t and t.strip(" .\n"):
            w = t.split()
            a = rng.randrange(max(1, len(w) - 12))
            docs.append((100 + k, f"{text(rng, lines=1)} {'  --\t'.join(w[a:a + 13])}, {text(rng, lines=1)} {shared}"))
    docs += [(200, None), (201, ""), (202, "... !"), (203, "seven WORDS that"), (204, items[1][1]), (204, items[1][1]), (None, items[2][1] * 2), (205, "One"),
             (206, f"{text(rng, lines=40, words=200)} {items[3][1]} {text(rng, lines=200, words=200)}"), (207, f"{shared} " * 300)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"bits_per_window": 1, "max_bits": 64, "broadcast_bytes": 0}])
def test_against_brute_force(spark, how):
    docs, items = fixture()
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS _rid", "'x' AS maybe", "2 AS n_words").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id", "'y' AS gram")
    got = [tuple(r)[:6] for r in D.report(spark, rows, bench, **how).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert D.report(spark, docs.limit(0), bench).count() == 0
    clean = D.report(spark, docs, bench.limit(0)).first()
    assert (clean.n_words, clean.n_hit, clean.n_items, clean.contaminated) == (11, 0, 0, False)


def test_spans_and_documents_go(spark):
    docs = spark.createDataFrame([(1, "Keep this; A b c d e f g h i J, and that!", "x"), (2, "clean, this one", "y"), (3, None, "z"), (4, "a b c d e f g h i j", "w")],
                                 "doc_id long, text string, _row string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    cut = D.decontaminate(spark, docs, bench, remove="spans")
    assert cut.columns == docs.columns
    assert sorted(tuple(r) for r in cut.collect()) == [(1, "Keep this;  , and that!", "x"), (2, "clean, this one", "y"), (3, None, "z"), (4, " ", "w")]
    assert sorted(r.doc_id for r in D.decontaminate(spark, docs, bench).collect()) == [2, 3]
    with pytest.raises(ValueError):
        D.decontaminate(spark, docs, bench, remove="words")


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    windows, _ = D.benchmark_windows(spark, bench, 10, "item_id", "text")
    found = D.scan(docs, windows, sizes=[10], bits=1 << 16, keep=[], id_col="doc_id", text_col="text")
    assert not re.search("Python|Arrow|Pandas|MapPartitions|Exchange", found._jdf.queryExecution().executedPlan().toString())
