import random

from helpers_llm import sentence

from warung.llm import line_dedup as M


def brute(docs):
    """Expected remaining text by (doc_id, text)."""
    key = lambda line: tuple(line.encode().lower().split())
    first = {}
    for d, t in sorted((x for x in docs if x[1] is not None), key=lambda x: x[0]):
        for i, line in enumerate(t.split("\n")):
            if key(line):
                first.setdefault(key(line), (d, i))
    near = {a for a in first for b in first if first[b] < first[a] and max(len(a), len(b)) >= 5 and M.within_one(list(a), list(b))}
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = None
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if not key(x) or (first[key(x)] == (d, i) and key(x) not in near)]
        out[d] = "\n".join(kept)
    return out


def corpus():
    rng = random.Random(1)
    base = [sentence(rng, words=n) for n in (1, 3, 4, 5, 6, 9, 30, 400)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words) + 1)
                what = rng.choice("sid")
                if what == "i":
                    words.insert(at, rng.choice("xyz"))
                elif at < len(words) and (what == "s" or len(words) > 1):
                    words[at:at + 1] = [rng.choice("xyz")] if what == "s" else []
            lines.append(rng.choice([" ", "  ", "\t"]).join(words).upper() if rng.random() < 0.2 else " ".join(words))
        docs.append((d, "\n".join(lines)))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, " \n" + base[6])]


def test_against_brute_force(spark):
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = {r.doc_id: r for r in M.dedup_lines(spark, rows).collect()}
    want = brute(docs)
    assert {d: r.text for d, r in out.items()} == want
    for d, t in docs:
        n = 0 if t is None else len(t.split("\n"))
        kept = 0 if not want[d] else len(want[d].split("\n"))
        assert out[d].n_lines == n
        if want[d]:
            assert n - kept == out[d].n_exact + out[d].n_near


def test_extra_columns_empty_table_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 7, 8, None), (1, "a b c d e f", 7, 8, None), (2, "a b c d e g", 9, 9, None)],
                                 "doc_id long, text string, rid int, n_lines int, h string")
    out = M.dedup_lines(spark, rows)
    assert sorted(out.columns) == sorted(["doc_id", "text", "rid", "h", "n_lines", "n_exact", "n_near"])
    got = sorted((r.doc_id, r.text, r.rid, r.n_near) for r in out.collect())
    assert got == [(1, "a b c d e f", 7, 0), (1, "a b c d e f", 7, 0), (2, "", 9, 1)]
    assert M.dedup_lines(spark, rows.where("doc_id > 9")).count() == 0


def test_within_one():
    w = lambda s: s.split()
    assert M.within_one(w("a b c"), w("a x c")) and M.within_one(w("a b c"), w("a c")) and M.within_one(w("a"), w("a"))
    assert not M.within_one(w("a b c d"), w("b c d e")) and not M.within_one(w("a b c"), w("c b a"))


def test_only_variants_of_several_lines_are_compared_by_place(spark, monkeypatch):
    tables, save = {}, M.saved

    def saved(spark, df, name):
        out = save(spark, df, name)
        tables[name] = out.toPandas()
        return out

    monkeypatch.setattr(M, "saved", saved)
    docs = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.text for r in M.dedup_lines(spark, rows).collect()}
    assert out == brute(docs)
    every, shared = tables["lines-variants"], tables["lines-shared-variants"]
    lines = every.groupby(["group", "key"])["h"].nunique()
    assert (shared.groupby(["group", "key"])["h"].nunique() == lines[lines > 1]).all() and len(shared) < len(every)
    assert tables["lines-words"]["h"].is_unique and len(tables["lines-words"]) == len(tables["lines-candidates"])
