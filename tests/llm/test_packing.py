import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers_llm import text
from tokenizers import Tokenizer

from warung.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_schedules_place_every_token():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n, window = int(rng.integers(1, 7)), int(rng.integers(2, 30))
        totals = rng.integers(0, 200, n)
        if not totals.sum():
            continue
        for weights in (totals, rng.integers(0, 5, n)):
            phases = K.schedule(totals, weights.astype(float), window)
            layout = K.Layout(totals, phases, window)
            count = sum(p.count for p in phases)
            edges = layout.bounds(np.arange(count + 1))
            assert count == -(-totals.sum() // window) and (np.diff(edges, axis=0) >= 0).all()
            assert (edges.sum(1)[:-1] == np.arange(count) * window).all() and (edges[-1] == totals).all()
            for q in range(n):
                if totals[q]:
                    cuts = np.unique(np.concatenate([[0, totals[q]], rng.integers(0, totals[q] + 1, 4)]))
                    begin, length, win, offset = layout.pieces(q, cuts)
                    assert (begin[1:] == (begin + length)[:-1]).all() and set(cuts[:-1]) <= set(begin) and length.sum() == totals[q]
                    assert (offset + length <= window).all()
                    assert (offset == begin - edges[win, q] + (edges[win + 1, :q] - edges[win, :q]).sum(1)).all()


def test_windows_hold_the_targets():
    totals = np.array([6000, 3000, 1000])
    layout = K.Layout(totals, K.schedule(totals, np.array([1.0, 1.0, 1.0]), 30), 30)
    first = np.diff(layout.bounds(np.arange(90)), axis=0)
    assert (first == 10).all()                     # while no queue is dry
    natural = K.Layout(totals, K.schedule(totals, totals.astype(float), 30), 30)
    per = np.diff(natural.bounds(np.arange(300)), axis=0)
    assert (np.abs(per - np.array([18, 9, 3])) <= 1).all()


def corpus():
    rng = random.Random(8)
    rows = [(i, text(rng, rng.choice(["en", "fr", "de", "es"]), rng.randint(1, 6)), rng.choice(["s0", "s0", "s1", None])) for i in range(120)]
    odd = [None, "", " \n", "It's <|endoftext|> they're <|ENDOFTEXT|> 12 ab34", "İstanbul ΣΑΣ. é x́. ok…. a.b, (c)!  nb sp",
           "word. " * 5000, "日本語。テスト！ 한국어", "\u0000 ​ a‍."]
    return rows + [(500 + k, t, "s2") for k, t in enumerate(odd)] + [(1, rows[1][1], "s1")]


@pytest.mark.parametrize("targets", [None, {"s0": 1.0, "s1": 1.0}])
def test_pieces_are_exact(spark, targets):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(PATH)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n", "2 AS task").repartition(5)
    packed = K.pack(spark, docs, PATH, window=512, targets=targets, keep_ids=True)
    pieces = packed.collect()
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    by = {}
    for p in pieces:
        by.setdefault((p.doc_id, p.source), []).append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for (d, _), some in by.items():
        ids = b"".join(p.ids for p in sorted(some, key=lambda p: p.start))
        assert any(ids == w.tobytes() for w in want[d]), (d, len(ids))
        assert all(p.doc_tokens == len(ids) // 4 for p in some)
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert fill.get(p.sequence_id, 0) == p.offset
        fill[p.sequence_id] = p.offset + p.length
    assert sum(fill.values()) == sum(len(w) for ws in want.values() for w in ws)
    assert sorted(fill) == list(range(len(fill))) and all(fill[k] == 512 for k in range(len(fill) - 1))
    whole = {r.sequence_id: r for r in K.sequences(packed).collect()}
    assert all(len(whole[k].ids) == 4 * n for k, n in fill.items())


def test_cache_turnover_keeps_ids():
    texts = [t.encode() if t else None for _, t, _ in corpus()]
    small, large = K.WordTokenizer(PATH, room=20), K.WordTokenizer(PATH)
    assert [x for t in texts for x in small.batch([t])] == large.batch(texts)


def test_empty_table_and_too_many_sources(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string")
    assert K.pack(spark, docs.where("doc_id < 0"), PATH).count() == 0
    with pytest.raises(ValueError):
        K.pack(spark, docs, PATH, max_sources=2)


def valid(pieces, window):
    """Windows full and without gaps; documents whole.  Tokens by source and window."""
    fill, docs, held = {}, {}, {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert fill.get(p.sequence_id, 0) == p.offset
        fill[p.sequence_id] = p.offset + p.length
        docs[p.doc_id, p.source, p.doc_tokens] = docs.get((p.doc_id, p.source, p.doc_tokens), 0) + p.length
        held[p.source, p.sequence_id] = held.get((p.source, p.sequence_id), 0) + p.length
    assert sorted(fill) == list(range(len(fill))) and all(fill[k] == window for k in range(len(fill) - 1))
    assert all(n % d[2] == 0 for d, n in docs.items())
    return held


def test_sources_that_share_a_queue(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string").repartition(3)
    docs = docs.localCheckpoint()
    one, many = (K.pack(spark, docs, PATH, window=64, keep_ids=True, queues=q).collect() for q in (256, 1))
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(valid(many, 64))
    targets = {"s0": 1.0, "s1": 1.0}
    one, many = (valid(K.pack(spark, docs, PATH, window=64, targets=targets, queues=q).collect(), 64) for q in (256, 1))
    assert {k: n for k, n in one.items() if k[0] in targets} == {k: n for k, n in many.items() if k[0] in targets}
    assert {s for s, _ in many} == {"s0", "s1", "s2", None}


def test_more_sources_than_a_driver_table(spark):
    rows = [(i, "a word", f"host{i}") for i in range(4500)] + [(9000 + i, "b " * 300, "big") for i in range(20)] + [(9999, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = valid(K.pack(spark, docs, PATH, window=512).collect(), 512)
    totals = {}
    for (s, _), n in held.items():
        totals[s] = totals.get(s, 0) + n
    assert len(totals) == 4502 and totals["host7"] == 3 and totals["big"] == 20 * 301


def test_another_vocabulary_gets_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from warung.llm import packing
    texts = ["Two  words, and more.", " leading space\nand lines", "", "\u00c9t\u00e9 13.5"]
    for name, whole in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(name)
        made = packing.WordTokenizer(path)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert made.whole is whole
        assert [np.frombuffer(i, "<u4").tolist() for i in made.batch([t.encode() for t in texts])] == want


def test_words_of_ascii_letters_are_told_apart_from_their_last_mark():
    words, library = K.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = ["Hello, WORLD! a.b, (it), it's, don't. x?! y.. \"quoted,\" 3, 4.5; Été, naïve. z,", "end.", "a ,b , c", ", . ;", "café”, ok, no",
             "<|endoftext|>, Upper, CASE. <|startoftext|>it, x", "tab,\tline.\nnext;\x0bv:\x0cf,\x1cg,\x85h", "thonre stthable qzxv, Qzxv! " * 3, ""]
    for _ in range(2):
        assert words.batch([t.encode() for t in texts]) == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert b"hello" in words.young and b"hello," not in words.young
    assert words.plain is not words.library


def test_workers_keep_no_words_after_a_task(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(k, text(rng), "s") for k in range(200)], "doc_id long, text string, source string").repartition(8)
    assert K.tokenized(docs, PATH, 2, "doc_id", "text", "source").count() == 200

    def kept(batches):
        for batch in batches:
            n = sum(len(t.young) + len(t.old) for t in K._tokenizers.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    assert spark.range(64, numPartitions=64).mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] == 0


def test_each_word_is_looked_up_once_and_runs_of_marks_by_themselves(monkeypatch):
    words, library = K.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = ["Abqu abqu ABQU, abqu. abqu\n" * 50, "zerth*** zerth$$$ veré### zerth.&&& veré!! zerth--\" é*** it's*** <b>***", "", None, "a", "x<| y, <|endoftext|>*** Zerth***, y,"]
    encoded = [None if t is None else t.encode() for t in texts]
    which, found, counts = K._words(encoded[:1])
    assert sorted(found) == [b",", b".", b"abqu"] and len(which) == counts[0] == 7 * 50
    words.forget()                                 # the probe's
    asked, one = [], words._one
    monkeypatch.setattr(words, "_one", lambda some: (asked.extend(some), one(some))[1])
    got = words.batch(encoded)
    assert got == [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert "***" in asked and not {"zerth***", "zerth$$$", "zerth.&&&", "veré###", "veré!!"} & set(asked)
    assert not words.whole and words.batch([]) == []
