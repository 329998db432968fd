"""The stages on the smallest data, each against what its operator promises."""
import corpus_pipeline as C
import pytest

from warung.llm import queries as Q
from warung.llm.store import saved

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in C.STAGES:
        docs = saved(spark, stage(spark, docs, SF), "test-stage")
        if name != C.STAGES[-1][0]:
            assert docs.columns == C.COLUMNS
        seen.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    for before, after in zip(ids, ids[1:]):
        assert after <= before
    assert len(ids[1]) >= 0.97 * len(ids[0])       # clean documents stay
    near = Q.minhash_dedup.near_duplicates(spark, seen[2], k=5)
    assert ids[3] == {r.doc_id for r in near.where("kept").collect()}
    assert ids[3] == ids[4] == ids[5]
    lines = {r.doc_id: r.text for r in seen[2].select("doc_id", "text").collect()}
    words = [tuple(x.lower().split()) for t in lines.values() for x in t.split("\n") if x.split()]
    assert len(words) == len(set(words))           # no line stands twice


def test_empty_table_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the one without an id, of several words here", "en", None, 5),
                                 (3, "the third of these texts has many words too", None, "s", 9), (3, "the third of these texts has many words too", None, "s", 9)],
                                docs.schema)
    for rows in (docs.limit(0), odd.unionByName(docs.limit(40)).selectExpr("*", "1 AS score", "2 AS rid")):
        now = rows
        for _, stage in C.STAGES:
            now = saved(spark, stage(spark, now, SF), "test-odd")
        now.count()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_queries_run_and_match_their_sql(spark, name):
    import duckdb

    from warung.llm import oracle
    df = Q.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in oracle.SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        rel = con.sql(oracle.SQL[name])
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())


def test_near_copies_go_row_by_row(spark):
    import random

    from helpers_llm import sentence
    rng = random.Random(3)
    one, two, three, four = (sentence(rng, words=60) for _ in range(4))
    near = lambda t: t + " more"
    rows = [(1, one), (2, near(one)), (2, two),              # the id of a near copy also stands on a kept row
            (None, three), (None, near(three)), (None, four), (None, four), (7, near(four))]
    schema = spark.read.parquet(f"{SF}/documents.parquet").select(C.COLUMNS).schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    got = [(r.doc_id, r.text) for r in C.drop_near_copies(spark, docs, SF).collect()]
    third = [x for x in got if x[1] in (three, near(three))]
    assert len(third) == 1 and third[0][0] is None
    assert sorted((x for x in got if x not in third), key=str) == sorted([(1, one), (2, two), (None, four)], key=str)
    # across different sets a null id comes before all others in the operator, too
    found = C.minhash_dedup.near_duplicates(spark, docs.where("doc_id = 7 OR doc_id IS NULL"), k=5).collect()
    assert {r.component_id for r in found} == {None} and [r.kept for r in found if r.doc_id == 7] == [False]
