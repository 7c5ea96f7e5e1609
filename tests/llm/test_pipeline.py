import zlib

import numpy as np

import corpus_pipeline as P
from panelkit.sources.io import materialize
from tests.llm.common import odd, odd_rows, texts
from tests.llm.test_texts import brute_groups, scripts
from tests.llm.test_tokens import check_packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf))
        assert kept.columns == columns, name
        before, after = docs.collect(), kept.collect()
        if name == "n-gram Jaccard join":
            groups = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, c) in groups.items() if i == c)
        elif name.startswith("mixing"):
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
        else:
            assert len(after) > 0.8 * len(before)
        docs = kept
    rows = P.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.length for r in rows) >= docs.count()


def test_stages_of_odd_rows(spark, sf):
    docs = odd(spark)
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf))
        assert docs.columns == odd(spark).columns
    left = {r.doc_id for r in docs.collect()}
    assert 100 not in left and not {104, 105} & left
    P.STAGES[-1][1](spark, docs, sf).collect()


def test_same_rows_again(spark, sf):
    key = lambda r: (r.doc_id, r.start, r.sequence_id, r.offset)
    a = P.run(spark, sf).collect()
    b = P.run(spark, sf).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in a) == sorted((r.doc_id, r.start, r.ids_crc32) for r in b)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_short_texts_keep_their_language(spark, sf):
    some = ["A.", "ok", "a", "of", "am", "the", "Der", "I am", "et la"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    strange = [(-100, "7", None), (-101, "qxzj vwkq " * 40, None)]
    more = spark.createDataFrame([(-i, t, None) for i, t in enumerate(some, 1)] + strange, docs.schema)
    kept = {r.doc_id for r in P.reject_language(spark, docs.unionByName(more), sf).collect()}
    assert set(range(-len(some), 0)) <= kept and not {-100, -101} & kept


def test_rows_without_an_id_of_their_own(spark, sf):
    a, b, c, d = texts(seed=5, n=400)[:4]
    long = [t + " " + " ".join(f"{k}{i}" for i in range(30)) for k, t in zip("abcd", (a, b, c, d))]
    rows = [
        (None, long[0], "en", "a"), (None, long[1], "en", "a"), (None, long[1], "en", None), (7, long[2], "en", "a"), (7, long[3], "en", "a"),
        (7, long[3], "en", "a"), (3, long[2], "en", "b"), (None, "", None, "a"), (None, "", "a", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = P.deduplicate(spark, docs, sf).collect()
    # Of the two null rows of one text either stays, and of the texts under 7 one is a copy of 3's.
    assert sorted(r.text for r in kept) == sorted(["", "", *long])
    assert sorted(r.doc_id for r in kept if r.doc_id) == [3, 7]


def test_mix_takes_rows_of_one_id_apart(spark, sf):
    rows = [(i % 3 if i % 2 else None, f"d{i} " + "w " * (i % 5), None if i % 7 == 0 else "abc"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = lambda t: len(t.split())
    want = sorted((r.size, r.source or "", r.doc_id or -1) for r in P.mixing.mix(docs, digest=P._digest(docs)).collect() for _ in range(r.copies))
    got = sorted((n(r.text), r.source or "", r.doc_id or -1) for r in P.mix_sources(spark, docs, sf).collect())
    assert got == want


def test_texts_of_many_scripts_stay(spark, sf):
    rows = scripts()
    docs = spark.createDataFrame(rows + [(-1, "qxzj vwkq " * 40, None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in P.reject_language(spark, docs, sf).collect()) == [i for i, _, _ in rows]
