"""Merkle manifest of a table: a digest per row, a tree of digests per group, one root over the
groups, and for every row the siblings that lead from it to the root.

A tree joins every ``FAN`` neighbouring nodes into one; a run of one counts too. The proofs come by
pointer jumping: each inner node first holds the siblings on the way to its parent, and each round
joins the table with itself, which doubles the distance and appends the segments, until all reach the
root. Rows below a run share its path, so paths are shuffled once per run and not per row.

Nulls: a null field is ``-`` in a digest, a null group is a group of its own and the first, null keys
come first. Rows with equal keys are ordered by digest; equal rows are leaves of their own. An empty
table has no rows and no root."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import add_running_start
from panelkit.sources.io import materialize

FAN = 8
SHIFT = 3  # FAN = 2 ** SHIFT
#: Tree of the groups' roots; the others are named by the position of their first row.
TOP = -1
SEGMENT = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as UTF-8 byte count, colon and text, or ``-`` if null."""
    fields = []
    for value in values:
        text = value.cast("string")
        counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        fields.append(F.coalesce(counted, F.lit("-")))
    return digest(F.concat(*fields))


def fold(start: Column, proof: Column) -> Column:
    """The root that a digest and its proof give."""
    return F.aggregate(proof, start, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def depth(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _segment(digests: Column, at: Column) -> Column:
    """The siblings of child ``at`` (from 0)."""
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), at), "").alias("left"),
        F.array_join(F.slice(digests, at + 2, F.lit(FAN)), "").alias("right"),
    )


def _levels(leaves: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Inner nodes, one table a level, and the last node of every tree.

    ``leaves``: tree, idx (from 0 in the tree), n (nodes of the tree on this level), digest, node
    (the node's own name). Children are at most ``FAN`` digests, so no group is large."""
    tables, current = [], leaves
    ends = [leaves.filter("n = 1").select("tree", "digest", "node")]
    for level in range(1, depth(largest) + 1):
        runs = (
            current.filter("n > 1")
            .groupBy("tree", F.shiftright("idx", SHIFT).alias("idx"), F.shiftright(F.col("n") + FAN - 1, SHIFT).alias("n"))
            .agg(F.array_sort(F.collect_list(F.struct("idx", "digest", "node"))).alias("children"))
        )
        current = materialize(
            runs.withColumn("digest", digest(F.array_join(F.col("children.digest"), "")))
            .withColumn("node", F.struct("tree", F.lit(level).alias("level"), "idx"))
        )
        tables.append(current)
        ends.append(current.filter("n = 1").select("tree", "digest", "node"))
    return tables, reduce(DataFrame.unionByName, ends)


def _links(nodes: DataFrame) -> DataFrame:
    """Every child of the nodes with its parent and its siblings."""
    children = nodes.select("node", "children", F.posexplode("children").alias("at", "child"))
    return children.select(
        F.col("child.node").alias("node"),
        F.col("node").alias("above"),
        F.array(_segment(F.col("children.digest"), F.col("at"))).alias("path"),
    )


def jump(links: DataFrame, longest: int) -> DataFrame:
    """Paths to the root of all linked nodes: rounds of joining the table with itself.

    ``above`` is the node at the end of the path so far. After k rounds that is 2^k levels up, where
    only one node in FAN^(2^k) remains, so the joined side shrinks as paths grow."""
    paths, far = materialize(links), 1
    while far < longest:
        done, todo = paths.filter("above IS NULL"), paths.filter("above IS NOT NULL")
        reached = paths.filter((F.col("node.tree") == TOP) | (F.col("node.level") > far)).select(
            F.col("node").alias("above"), F.col("above").alias("_next"), F.col("path").alias("_more")
        )
        longer = todo.join(reached, "above", "left").select(
            "node",
            F.col("_next").alias("above"),
            F.concat("path", F.coalesce("_more", F.array().cast(SEGMENT))).alias("path"),
        )
        paths, far = materialize(done.unionByName(longer)), 2 * far
    return paths.select("node", "path")


def prove(
    rows: DataFrame, key: str, group: str, columns: Sequence[str], changed: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per row: key, leaf, given (the leaf after ``changed`` replaced some columns), subroot, root and
    proof (siblings left and right of the path, from the row's run to the root)."""
    kept = [F.col(f"`{c}`") for c in columns]
    other = [(changed or {}).get(c, F.col(f"`{c}`")) for c in columns]
    leaves = rows.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{group}`").alias("grp"),
        leaf_digest(kept).alias("digest"),
        leaf_digest(other).alias("given"),
        F.lit(1).alias("one"),
    )
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest")]
    placed = add_running_start(leaves, order, "one", "pos")
    trees = materialize(placed.groupBy("grp").agg(F.min("pos").alias("tree"), F.count("one").alias("n")))
    named = trees.select(F.col("grp").alias("_grp"), "tree", "n")
    leaves = materialize(
        placed.join(named, F.col("grp").eqNullSafe(F.col("_grp")))
        .withColumn("idx", F.col("pos") - F.col("tree"))
        .select("key", "digest", "given", "tree", "n", "idx")
    )
    count, largest = trees.agg(F.count("tree"), F.max("n")).first()
    bare = F.struct("tree", F.lit(0).alias("level"), "idx").alias("node")
    lower, ends = _levels(leaves.select("tree", "idx", "n", "digest", bare), largest or 0)
    subroots = materialize(ends)  # one row a group: the planner sees its size and need not deal rows by group

    ordered = add_running_start(subroots.withColumn("one", F.lit(1)), [F.col("tree")], "one", "idx")
    over = ordered.select(F.lit(TOP).cast("long").alias("tree"), F.col("idx").cast("long").alias("idx"), F.lit(count).cast("long").alias("n"), "digest", "node")
    upper, ends = _levels(over, count)
    root = ends.select("digest").first()

    # Rows find their own siblings in their run; only nodes above the rows hold paths.
    linked = lower[1:] + upper
    if linked:
        links = reduce(DataFrame.unionByName, [_links(nodes) for nodes in linked])
        paths = jump(links, depth(largest or 0) + depth(count))
    else:
        paths = over.select("node", F.array().cast(SEGMENT).alias("path")).filter("false")
    runs = leaves.filter("n = 1").select("tree", "idx", bare, F.array().cast("array<string>").alias("run"))
    if lower:
        runs = runs.unionByName(lower[0].select("tree", "idx", "node", F.col("children.digest").alias("run")))
    held = (
        runs.join(paths, "node", "left")
        .join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
        .select("tree", F.col("idx").alias("at"), "run", "path", "subroot")
    )
    own = F.array(_segment(F.col("run"), F.col("idx") % FAN))
    above = F.coalesce("path", F.array().cast(SEGMENT))
    found = leaves.withColumn("at", F.shiftright("idx", SHIFT)).join(held, ["tree", "at"])
    return found.select(
        "key",
        F.col("digest").alias("leaf"),
        "given",
        "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"),
        F.when(F.col("n") > 1, F.concat(own, above)).otherwise(above).alias("proof"),
    )
