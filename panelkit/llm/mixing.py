"""Operator 2: mixing sources to target weights by balanced (cube method) sampling."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import WORD, add_running_start
from panelkit.sources.io import materialize

#: Units that one flight handles at most.
BLOCK = 4096
EDGE = 1e-9


def n_words(text_col: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0
) -> DataFrame:
    """One row per source of (source, size): ``source_size``, ``target``, ``rank``.

    Sources by code point, null last, get the weights of ``cycle`` in turn and share the size of
    all rows. A target stops at ``most`` times its source's size; what is over is shared again by
    weight among the others, until none is above. Each round is one aggregate over the sources, and
    only its sums come to the driver. With no sizes at all every target is 0."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = add_running_start(totals.withColumn("_one", F.lit(1).cast("long")), order, "_one", "rank")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    table = materialize(
        ranked.drop("_one")
        .withColumn("weight", F.get(weights, (F.col("rank") % len(cycle)).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    level = None
    capped = F.lit(False)
    while True:
        free = ~capped
        got = table.agg(
            F.sum("source_size").cast("double").alias("all"),
            F.sum(F.when(capped, F.col("cap"))).alias("held"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
        ).first()
        if not got["all"] or not got["weight"]:
            level = level or 0.0
            break
        new = (got["all"] - (got["held"] or 0.0)) / got["weight"]
        if new == level:
            break
        # The level only rises, so a source once stopped stays stopped.
        level = new
        capped = F.col("weight") * F.lit(level) > F.col("cap")
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", F.least(target, F.col("cap")).alias("target"), "rank")


def flight(pi: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move inclusion probabilities through the null space of the constraints (number of units,
    sum of sizes) until at most two are left that are neither 0 nor 1.

    Three undecided units have one direction that changes neither total. The step goes to the
    wall on one side or the other, with chances that keep every probability's expectation."""
    pi = np.where(pi < EDGE, 0.0, np.where(pi > 1 - EDGE, 1.0, pi)).tolist()
    size, draws = size.tolist(), draws.tolist()
    held: list[int] = []
    steps = 0
    for k in range(len(pi)):
        if 0.0 < pi[k] < 1.0:
            held.append(k)
        while True:
            if len(held) == 3:
                a, b, c = held
                u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
                if u == (0, 0, 0):
                    u = (1, -1, 0)
            elif len(held) == 2 and size[held[0]] == size[held[1]]:
                u = (1, -1)
            else:
                break
            up = min((1 - pi[i]) / v if v > 0 else pi[i] / -v for i, v in zip(held, u) if v)
            down = min(pi[i] / v if v > 0 else (1 - pi[i]) / -v for i, v in zip(held, u) if v)
            step = up if draws[steps] * (up + down) < down else -down
            steps += 1  # every step decides a unit, so the draws suffice
            for i, v in zip(held, u):
                p = pi[i] + step * v
                pi[i] = 0.0 if p < EDGE else 1.0 if p > 1 - EDGE else p
            left = [i for i in held if 0.0 < pi[i] < 1.0]
            if len(left) == len(held):  # rounding kept the unit off its wall
                i = min(held, key=lambda j: min(pi[j], 1 - pi[j]))
                pi[i] = float(round(pi[i]))
                left.remove(i)
            held = left
    return np.array(pi)


def landing(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few units that a flight leaves: the choice whose total size is nearest to the
    expected one (then nearest in number)."""
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    want, count = float(pi[open_] @ size[open_]), float(pi[open_].sum())
    best = min(
        itertools.product((0.0, 1.0), repeat=len(open_)),
        key=lambda s: (abs(np.dot(s, size[open_]) - want), abs(sum(s) - count), s),
    )
    out = pi.copy()
    out[open_] = best
    return out


_UNIT = "unit long, rank long, size long, pi double, hash long"


def _round(frame: DataFrame, last: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hash", "unit"], kind="stable").reset_index(drop=True)
        weight = pdf["size"].to_numpy("float64")
        draws = ((pdf["hash"].to_numpy().astype("uint64") >> np.uint64(11)) * 2.0**-53)
        pi = flight(pdf["pi"].to_numpy(), weight, draws)
        pdf["pi"] = landing(pi, weight) if last else pi
        return pdf.drop(columns="block")

    return frame.groupBy("rank", "block").applyInPandas(run, _UNIT)


def mix(
    docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digest: Column | None = None,
) -> DataFrame:
    """How often the mix takes each document: id, ``source``, ``digest``, ``size``, ``source_size``, ``target``,
    ``copies``, ``taken`` (words, repeats counted).

    Each document of a source is due target / source_size times. The whole part is taken; for the
    fraction, cube-method sampling picks documents so that their number and their words stay at
    the expected totals: flights run in blocks of some thousand documents, at most two documents
    per block stay undecided, these meet in the next round's blocks, and the last two of a source
    are decided by a small landing. So a source of any size is spread over many tasks.

    Directions come from hashes of ids and texts: reruns agree. Rows are told apart by id, source and ``digest``
    (default: a hash of the text). Of m rows that are equal in all of them the whole part of what they are due
    together goes to the first so many, and one more of them at most is up to the flight. A null source is a source of its own; null or empty texts
    have size 0 and are taken as often as others; an empty table gives no rows."""
    sizes = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("key"), F.col(source_col).alias("source"),
            n_words(text_col).alias("size"), (F.xxhash64(text_col) if digest is None else digest).alias("digest"),
        )
    )
    targets = source_targets(sizes, cycle, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.abs(rate - F.round(rate)) < EDGE
    targets = targets.withColumn("whole", F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("long"))
    targets = materialize(
        targets.withColumn("pi", F.when(near, 0.0).otherwise(rate - F.col("whole")))
    )
    joined = sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    due = joined.select(
        "s.key", "s.source", "s.size", "s.digest", "t.rank", "t.source_size", "t.target", "t.whole", "t.pi", F.lit(1).cast("long").alias("one")
    )
    order = [F.col("rank"), F.col("key").asc_nulls_first(), F.col("size"), F.col("digest")]
    rows = materialize(add_running_start(due, order, "one", "place").drop("one"))
    # Equal rows stand together in one order, so the place of the first names their unit.
    units = rows.groupBy("rank", "key", "size", "digest", "pi").agg(F.min("place").alias("unit"), F.count("*").alias("times"))
    owed = F.col("pi") * F.col("times")
    base = F.when(F.abs(owed - F.round(owed)) < EDGE * F.col("times"), F.round(owed)).otherwise(F.floor(owed))
    units = materialize(
        units.withColumn("base", base.cast("long"))
        .withColumn("rest", F.greatest(owed - F.col("base"), F.lit(0.0)))
        .withColumn("hash", F.xxhash64(F.lit(seed), "key", "rank", "size", "digest"))
    )
    named = units.select("rank", "key", "size", "digest", "unit", "base")
    largest = units.groupBy("rank").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    units = units.select("unit", "rank", "size", F.col("rest").alias("pi"), "hash")
    decided = None
    while True:
        blocks = max(1, -(-largest // BLOCK))
        done = materialize(
            _round(units.withColumn("block", F.pmod("hash", F.lit(blocks))), last=blocks == 1)
        )
        here = done.filter("pi = 0 or pi = 1") if blocks > 1 else done
        decided = here if decided is None else decided.unionByName(here)
        if blocks == 1:
            break
        units = done.filter("pi > 0 and pi < 1").withColumn(
            "hash", F.xxhash64(F.lit(seed), "hash", F.lit(blocks))
        )
        largest = 2 * blocks
    extra = named.join(decided.select("unit", F.col("pi").cast("long").alias("one")), "unit").withColumn(
        "extra", F.col("base") + F.col("one")
    )
    out = rows.alias("r").join(
        extra.alias("x"),
        (F.col("r.rank") == F.col("x.rank")) & F.col("r.key").eqNullSafe(F.col("x.key"))
        & (F.col("r.size") == F.col("x.size")) & (F.col("r.digest") == F.col("x.digest")),
    )
    copies = F.col("whole") + (F.col("place") - F.col("unit") < F.col("extra")).cast("long")
    return out.select(
        F.col("r.key").alias(id_col), F.col("r.source").alias("source"), F.col("r.digest").alias("digest"),
        F.col("r.size").alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("r.size")).alias("taken"),
    )
