import hashlib
import math
import random
import re
import zlib

import pytest
from helpers_llm import text

from warung.llm import resample as R

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(t):
    w = WORD.findall((t or "").encode().lower())
    return len(w), [zlib.crc32(f) % 10000 for f in w + [a + b" " + b for a, b in zip(w, w[1:])]]


def brute(docs, target):
    count = lambda texts: [b for t in texts for b in features(t)[1]]
    s, t = [0] * 10000, [0] * 10000
    for b in count(x for _, x in docs):
        s[b] += 1
    for b in count(target):
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for d, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(enough[:25 * len(enough) // 100]):
        r[5] = k + 1
    return [tuple(r) for r in rows]


def test_against_brute_force(spark):
    rng = random.Random(13)
    docs = [(k, text(rng, rng.choice(["en", "de", "fr"]), rng.randint(1, 5))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, " .\x00\n"), (403, "one"), (404, "ÉTÉ Été"), (None, text(rng)), (None, docs[0][1]), (5, docs[5][1]), (5, docs[6][1]),
             (405, "a\x00b " * 30_000), (406, docs[7][1])]
    target = [text(rng, "fr") for _ in range(20)] + [None, ""]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS rank", "'x' AS _rid").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in R.resample(spark, rows, aim).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, target), key=str)
    assert R.resample(spark, rows.limit(0), aim).count() == 0
    assert R.resample(spark, rows, aim.limit(0)).where("rank IS NOT NULL").count() == 25 * sum(features(t)[0] >= 20 for _, t in docs) // 100


@pytest.mark.parametrize("at_once", [1, 2, 3, 1000])
def test_pairs_do_not_cross_documents(at_once):
    texts = [b"a b", None, b"", b"c", b"D e  f", b"\x00g\x00h"]
    found = {k: [] for k in range(len(texts))}
    words = [0] * len(texts)
    for own, owner, bucket in R.batch_features(texts, 10_000, at_once):
        for k in own.tolist():
            words[k] += 1
        for k, b in zip(owner.tolist(), bucket.tolist(), strict=True):
            found[k].append(b)
    assert words == [2, 0, 0, 1, 3, 2]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(features((t or b"").decode())[1]) for k, t in enumerate(texts)}


def test_the_draw_moves_towards_the_target(spark):
    rng = random.Random(4)
    docs = [(k, text(rng, "fr" if k % 4 == 0 else "en", 8)) for k in range(400)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(text(rng, "fr", 8),) for _ in range(100)], "text string")
    drawn = [r.doc_id for r in R.resample(spark, rows, aim).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(d % 4 == 0 for d in drawn) > 50    # a quarter by chance
