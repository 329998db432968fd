import random

import numpy as np
from helpers_llm import text
from pyspark.sql import functions as F

from warung.llm import language_id as L


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = L.new_network(["a", "b"], 3, rng)
    for part in (net.inputs, net.recur, net.bias):
        part[:] = [x.astype(np.float64) for x in part]
    net.out = net.out.astype(np.float64)
    data, target = rng.integers(0, 256, (7, 5)), rng.integers(0, 2, 5)
    _, grads = L.gradients(net, data, target)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = (int(data[2, 1]), 1) if p.shape[0] == 256 else tuple(rng.integers(0, s) for s in p.shape)
        step = 1e-4
        p[at] += step
        up = L.gradients(net, data, target)[0]
        p[at] -= 2 * step
        down = L.gradients(net, data, target)[0]
        p[at] += step
        assert abs((up - down) / (2 * step) - g[at]) < 1e-5


def test_fast_pass_equals_training_pass():
    rng = np.random.default_rng(1)
    net = L.new_network(["a", "b", "c"], 4, rng)
    lengths = np.array([3, 7, 20])
    data = rng.integers(0, 256, (20, 3))
    fast = L.window_probabilities(net, data, lengths)
    for k, n in enumerate(lengths):
        one = data[:n, k:k + 1]
        states = [L._forward(net.inputs[w], net.recur[w], net.bias[w], one[::1 - 2 * w])[0] for w in (0, 1)]
        logits = np.concatenate([states[0], states[1][::-1]], 2) @ net.out + net.out_bias
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        assert np.allclose(p.sum((0, 1)), fast[:, k], atol=1e-3)


def test_held_out_accuracy_and_defined_results(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang, 3), lang) for i in range(160) for lang in [rng.choice(["en", "fr", "de", "es"])]]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 345 !?", None), (903, rows[0][1], None), (904, "a" * 3000 + rows[0][1] * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in L.identify(docs, steps=120).collect()}
    assert len(out) == len(rows)
    test = [r for r in rows[:160] if out[r[0]].lang_pred]
    held = {r.doc_id for r in docs.where(L.held_out(F.col("doc_id"))).select("doc_id").collect()}
    right = [out[i].lang_pred == lang for i, _, lang in test if i in held]
    assert len(right) > 15 and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 for r in out.values())
    for i in (900, 901, 902):
        assert out[i].lang_pred == "und" and out[i].score == 0
    assert (out[903].lang_pred, out[903].score) == (out[0].lang_pred, out[0].score)


def test_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(docs).count() == 0
    only = spark.createDataFrame([(1, "hello there", None)], "doc_id long, text string, lang string")
    assert L.identify(only).first().lang_pred == "und"
