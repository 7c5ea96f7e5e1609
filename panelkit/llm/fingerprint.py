"""Operator 7: document fingerprints by quartile bucket digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import parts, slices
from panelkit.sources.io import materialize

#: Buckets of the digest, and what a step of the length code weighs against a quartile step.
BUCKETS, LENGTH_STEP = 256, 2
#: Distances of a triplet's second and third byte from its first. Wide triplets span words and say
#: more about a text, and less about its language, than neighbouring bytes do.
TRIPLETS = ((3, 6), (4, 8), (5, 10), (6, 12))
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], "u4")


def counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed byte triplets of a text, counted by bucket; ``buckets`` is a power of two."""
    shift = np.uint32(33 - buckets.bit_length())
    total = np.zeros(buckets, "i8")
    raw = np.frombuffer(data, "u1").astype("u4")
    for at in range(0, len(raw), 1 << 20):
        b = raw[at : at + (1 << 20) + 12]
        first = b * _MIX[0]
        for salt, (i, j) in enumerate(TRIPLETS):
            n = min(len(b) - j, 1 << 20)
            if n > 0:
                h = (first[:n] ^ (b[i : i + n] * _MIX[1])) + (b[j : j + n] * _MIX[2]) + np.uint32(salt)
                total += np.bincount((h * _MIX[0]) >> shift, minlength=buckets)
    return total


def digest(data: bytes, buckets: int = BUCKETS) -> str:
    """Two hex digits of length code, then two bits per bucket: how many of the quartiles of all
    bucket counts its count exceeds. Texts without a triplet have all buckets 0."""
    n = len(data)
    length = 0 if n == 0 else min(255, 1 + int(np.log(n) / np.log(1.1)))
    c = counts(data, buckets)
    quartiles = np.sort(c)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    codes = (c[:, None] > quartiles[None, :]).sum(axis=1).reshape(-1, 4)
    return f"{length:02x}" + (codes @ np.array([64, 16, 4, 1])).astype("u1").tobytes().hex()


def _codes(d: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(d[2:]), "u1")
    return ((raw[:, None] >> np.array([6, 4, 2, 0], "u1")) & 3).ravel().astype("i4")


def likeness(a: str, b: str) -> float:
    """1 for equal digests down to 0. The difference adds up the distances of the bucket quartiles
    (a distance of three, opposite ends, counts twice) and of the length codes; it is bounded by
    what two unrelated digests have, so unrelated texts come near 0."""
    step = np.abs(_codes(a) - _codes(b))
    apart = int(step.sum() + 3 * (step == 3).sum())
    lengths = abs(int(a[:2], 16) - int(b[:2], 16))
    most = 1.25 * len(step) + 0.75 * len(step) / 2
    return 1.0 - min(1.0, (apart + LENGTH_STEP * lengths) / most)


def fingerprint(text_col: str = "text", buckets: int = BUCKETS) -> Column:
    """Column with the digest of a whole text; null counts as empty."""

    @F.pandas_udf("string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([digest((t or "").encode("utf-8", "replace"), buckets) for t in texts], dtype=object)

    return digests(F.col(text_col))


def compare(left: str, right: str) -> Column:
    """Column with the likeness of two digest columns."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")

    return alike(F.col(left), F.col(right))


def with_next(docs: DataFrame, visit, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Run ``visit(rows)`` over (key, text, next text) of all documents in descending id order, the
    last followed by the first; ``visit`` gets an iterator of such rows and yields Arrow batches.

    Ids are dealt out by range, so the next document is nearly always in the same part. The first
    document of the part below, which the last one of a part needs, is found from ids alone and
    sent along as a guest: one text more per part, and texts are shuffled once. Equal ids go by
    text, a null id counts as lowest."""
    spark = docs.sparkSession
    n = parts(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), key.alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    ids = materialize(rows.select("key", F.xxhash64("text").alias("digest")))
    ranges = ids.select("key").repartitionByRange(n, "key").select("key", F.spark_partition_id().alias("p"))
    # one row per range
    tops = [r.top for r in ranges.groupBy("p").agg(F.max("key").alias("top")).orderBy("top").collect()]
    if not tops:
        return spark.createDataFrame([], schema)
    part = _part(spark, tops)
    # In a part: highest id first, of equal ids the smallest text. Its first row is the guest of
    # the part above; that of the highest part, of the lowest.
    guests = spark.createDataFrame(
        [(int(t), (i + 1) % len(tops)) for i, t in enumerate(tops)], "key long, part int"
    )
    first = (
        rows.join(F.broadcast(guests), "key")
        .groupBy("key", "part").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("id"), "key", "text", "part", F.lit(True).alias("guest"))
    )
    mine = rows.select("id", "key", "text", part("key").alias("part"), F.lit(False).alias("guest"))
    dealt = (
        mine.unionByName(first)
        .repartition(max(n, len(tops)), "part")
        .sortWithinPartitions("part", "guest", F.col("key").desc(), "text")
        .select("id", "text", "part", "guest")
    )

    def run(batches):
        yield from visit(_pairs(batches))

    return dealt.mapInArrow(run, schema)


def _pairs(batches):
    held = None
    for b in (part for whole in batches for part in slices(whole)):
        for row in zip(*(b[c].to_pylist() for c in ("id", "text", "part", "guest"))):
            if held is not None and not held[3]:
                yield held[0], held[1], row[1]
            held = row
    assert held is None or held[3]


def _part(spark, tops: list[int]):
    shared = spark.sparkContext.broadcast(np.array(tops, "i8"))

    @F.pandas_udf("int")
    def part(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, keys.to_numpy()).astype("i4"))

    return part


PROBE = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """How a fingerprint meets an edit: the last floor(n / 2) code points of every text give way to
    the first as many of the next document, and the digests of text, edited text and next text are
    compared. Null texts count as empty; an empty text equals its edit; a single document is its
    own next. Repeated rows stay; an empty table gives no rows."""

    def visit(rows):
        out: list[tuple] = []
        size, last = 0, None
        for key, text, following in rows:
            n = len(text)
            edited = (text[: n - n // 2] + following[: n // 2]).encode("utf-8", "replace")
            mine = last[1] if last is not None and last[0] is text else digest(text.encode("utf-8", "replace"), buckets)
            other = digest(following.encode("utf-8", "replace"), buckets)
            last = (following, other)
            changed = digest(edited, buckets)
            out.append(
                (key, n, hashlib.sha256(edited).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, other))
            )
            if len(out) == 2000:
                yield _as_batch(out)
                out = []
        if out:
            yield _as_batch(out)

    return with_next(docs, visit, PROBE, id_col, text_col)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
