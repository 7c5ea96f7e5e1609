"""Operator 3: packing token sequences by the histogram of lengths."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import slices
from panelkit.llm.units import Encoder, kept
from panelkit.sources.io import materialize

PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long"
#: Pieces of one length that are ranked in one group.
GROUP = 50_000


def cut_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, id_col: str = "doc_id",
    text_col: str = "text", end_id: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: its ids, then ``end_id``, cut at
    multiples of ``capacity``. With ``keep_ids`` the ids stay, in the column ``ids``.

    Null and empty texts make one piece that holds only the end id. No shuffle."""
    end = struct.pack("<I", end_id)
    step = capacity * 4

    def cut(batches):
        enc = kept(Encoder, tokenizer)
        for b in (some for whole in batches for some in slices(whole)):
            cols: list[list] = [[], [], [], [], [], []]
            for key, ids in zip(b["key"].to_pylist(), enc.ids(b["text"].to_pylist())):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    row = (key, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    for c, v in zip(cols, row):
                        c.append(v)
                    if keep_ids:
                        cols[5].append(np.frombuffer(piece, "<u4").astype("int64"))
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]]
            names = ["key", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(cols[5], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(cut, PIECES + (", ids array<long>" if keep_ids else ""))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, number of packs) for a histogram of lengths.

    Lengths are placed longest first, each into the shortest pack it fits, that is the one with
    most room, or into a new pack. Packs of one pattern are moved together, so the work depends
    on the number of different lengths, not of pieces: a length splits at most one group of packs
    and adds at most one more, so there are at most twice as many patterns as lengths."""
    open_packs: dict[int, Counter] = defaultdict(Counter)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        # Packs that got a piece of this length wait aside until no earlier pack fits another.
        while left:
            room = max((r for r, packs in open_packs.items() if r >= length and packs), default=None)
            if room is None:
                each = capacity // length
                # New packs are the shortest ones: fill them side by side, as evenly as they come.
                packs = -(-left // each)
                full, rest = divmod(left, packs)
                if rest:
                    open_packs[capacity - length * (full + 1)][(length,) * (full + 1)] += rest
                if packs - rest:
                    open_packs[capacity - length * full][(length,) * full] += packs - rest
                break
            pattern, n = min(open_packs[room].items())
            moved = min(n, left)
            open_packs[room][pattern] -= moved
            if not open_packs[room][pattern]:
                del open_packs[room][pattern]
            open_packs[room - length][(*pattern, length)] += moved
            left -= moved
    return sorted((p, n) for packs in open_packs.values() for p, n in packs.items())


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (key, start, length, ids_crc32).

    The histogram has at most ``capacity`` entries and is all that the driver sees. A piece finds
    its place by its rank among the pieces of its length; ranks come from counts per length and
    group of some ten thousand pieces, so no length is ranked in one task. Equal pieces may change
    places with each other; everything else is determined by the data."""
    pieces = materialize(pieces)
    if pieces.filter((F.col("length") > capacity) | (F.col("length") < 1)).limit(1).count():
        raise ValueError(f"a piece is empty or longer than {capacity}")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = 1 + sum(histogram.values()) // GROUP
    order = ["key", "start", "ids_crc32"]
    salted = pieces.withColumn("_group", F.pmod(F.xxhash64("key", "start"), F.lit(groups)))
    sizes = salted.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("length", "_group").orderBy(*order)
    ranked = (
        salted.withColumn("_in", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "_group"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_in", "_before", "_group")
    )
    lengths, first_rank, first_sequence, offset = _places(histogram, capacity)
    places = pieces.sparkSession.sparkContext.broadcast((lengths, first_rank, first_sequence, offset))

    def place(batches):
        lengths, first_rank, first_sequence, offset = places.value
        at_length = {int(v): (int(a), int(b)) for v, a, b in _runs(lengths)}
        for b in batches:
            ranks, sizes = b["_rank"].to_numpy(), b["length"].to_numpy()
            slot = np.empty(len(ranks), "int64")
            for v in np.unique(sizes):
                lo, hi = at_length[int(v)]
                mine = sizes == v
                slot[mine] = lo + np.searchsorted(first_rank[lo:hi], ranks[mine], "right") - 1
            names = [n for n in b.schema.names if n != "_rank"]
            sequence = first_sequence[slot] + ranks - first_rank[slot]
            yield pa.RecordBatch.from_arrays(
                [*(b[n] for n in names), pa.array(sequence), pa.array(offset[slot])],
                [*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def _places(histogram: dict[int, int], capacity: int):
    """For each length, which ranks go to which packs: sorted arrays of length, first rank, first
    sequence id and offset in the sequence."""
    sequence, used, rows = 0, Counter(), []
    for pattern, n in shortest_pack_first(histogram, capacity):
        at = 0
        for length in pattern:
            rows.append((length, used[length], sequence, at))
            used[length] += n
            at += length
        sequence += n
    assert used == Counter(histogram)
    table = np.array(sorted(rows) or np.empty((0, 4)), "int64").reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def _runs(sorted_values: np.ndarray):
    values, first = np.unique(sorted_values, return_index=True)
    return zip(values, first, np.append(first[1:], len(sorted_values)))


def sequences(placed: DataFrame) -> DataFrame:
    """The sequences themselves (``sequence_id``, ``ids``), of pieces cut with ``keep_ids``."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(rows, lambda r: r["ids"])).alias("ids"))
