import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelkit.llm import merkle, queries
from tests.llm.common import SCHEMA, empty, odd
from tests.llm.sql import same_as_sql


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(digests):
    """Root, and for every digest the segments (left, right) up to it."""
    proofs, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for p, i in zip(proofs, at):
            run = nodes[i // 8 * 8:i // 8 * 8 + 8]
            p.append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
        nodes = [sha("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return (nodes[0] if nodes else None), proofs


def brute(rows):
    """rows: key, group, digest -> subroot, root, proof, as a list of tuples."""
    groups = defaultdict(list)
    for key, group, leaf in rows:
        groups[group].append((key is not None, key or 0, leaf, key))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g], key=lambda r: r[:3]), ) for g in names}
    built = {g: plain_tree([r[2] for r in trees[g][0]]) for g in names}
    root, tops = plain_tree([built[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (_, _, leaf, key), proof in zip(trees[g][0], built[g][1]):
            out.append((key, leaf, built[g][0], root, tuple(proof + top)))
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 2}, {"a": 8}, {"a": 9}, {"a": 65, "b": 1, None: 3}, {"a": 1, "b": 1}, {"a": 600, "é": 7, "": 64, None: 1},
    {f"g{i}": 1 + i % 3 for i in range(70)},
])
def test_proofs(spark, sizes):
    rows = [(i * 7 % 1009 if i % 11 else None, g, f"t{i % 50}") for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "key long, grp string, text string")
    got = merkle.prove(df, "key", "grp", ["text"]).collect()
    want = brute([(k, g, sha(f"{len(t)}:{t}")) for k, g, t in rows])
    plain = [(r.key, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.proof)) for r in got]
    order = lambda r: (str(r[0]), r[1:])
    assert sorted(plain, key=order) == sorted(want, key=order)


def test_fold_finds_changes(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], f"Text {i}") for i in range(100)], "id long, g string, text string")
    changed = F.when(F.col("id") % 9 == 0, F.lower("text")).otherwise(F.col("text"))
    proven = merkle.prove(df, "id", "g", ["id", "text"], {"text": changed})
    rows = proven.withColumn("found", merkle.fold(F.col("given"), F.col("proof")) == F.col("root")).collect()
    assert {r.key for r in rows if not r.found} == set(range(0, 100, 9))


def test_leaf_of_nulls_and_bytes(spark):
    row = spark.createDataFrame([(12, None, "é")], "a long, b string, c string")
    got = row.select(merkle.leaf_digest([F.col("a"), F.col("b"), F.col("c")])).first()[0]
    assert got == sha("2:12-2:é")


def test_odd_rows_and_none(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, str(tmp_path), "op13_merkle_manifest", glob=True)
    empty(spark).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.op13_merkle_manifest(spark, f"{tmp_path}/e").count() == 0
    spark.createDataFrame([(1, "one", "en", "a", 3, "", 1, 0.5, 1)], SCHEMA).write.parquet(f"{tmp_path}/o/documents.parquet")
    only = queries.op13_merkle_manifest(spark, f"{tmp_path}/o").first()
    assert only.leaf == only.root == only.subroot == only.folded_root and only.proof_sha256 == sha("")


def test_query(spark, sf):
    same_as_sql(spark, sf, "op13_merkle_manifest")
