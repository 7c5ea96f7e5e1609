"""Operator 6: n-gram Jaccard join by a blocked sparse product of the incidence matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from panelkit.llm.common import WORDS, parts, slices
from panelkit.llm.components import components
from panelkit.llm.units import release
from panelkit.sources.io import materialize

#: Odd multipliers of the places in a shingle.
PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
     0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9], "u8",
)
MEMO = 150_000
#: Rows, and entries, that a block of the product has about at most.
BLOCK, ENTRIES = 1500, 1_000_000
#: Texts whose shingles are dealt out together.
BATCH = 500
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(ord("A"), ord("Z") + 1))})


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: Two documents link when 100 * intersection >= percent * union.
    percent: int = 80


class Shingles:
    """Distinct shingle hashes of a text, ascending; shorter texts are one shingle, empty ones none."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORDS.findall((text or "").translate(_LOWER))
        if not words:
            return np.empty(0, "i8")
        if len(self.known) > MEMO:
            self.known.clear()
        known, get = self.known, self.known.get
        out = []
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, "u8")
        n = max(1, len(h) - self.words + 1)
        k = min(self.words, len(h))
        total = np.full(n, np.uint64(k))
        with np.errstate(over="ignore"):
            for place in range(k):
                x = (total ^ h[place : place + n]) * PLACES[place % len(PLACES)]
                total = x ^ (x >> np.uint64(29))
        return np.unique(total).view("i8")


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    raw = hashes.tobytes()
    a, b = xxh3_64_intdigest(raw, 1), xxh3_64_intdigest(raw, 2)
    return a - (1 << 63), b - (1 << 63)


def least_shared(n, percent: int):
    """Shingles a set of n must share with any set it links with: percent of the union, which is
    no smaller than the set."""
    return -(-percent * n // 100)


ROWS = (
    "part int, batch long, place int, key long, sig1 long, sig2 long, n long, "
    "marks binary, sizes binary, hashes binary"
)
COUNTED = "batch long, place int, key long, sig1 long, sig2 long, n long, counts binary"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _dealt(docs: DataFrame, s: Settings, deals: int) -> DataFrame:
    """The incidence matrix, dealt out by shingle: per batch of texts and part of the hash space one
    row that holds, packed, the hashes of each text in that part (column ``sizes`` says how many
    each text has). Beside them a row per text: key, signature and size."""

    def run(batches):
        from pyspark import TaskContext

        release()
        shingles, made = Shingles(s.words), 0
        for b in batches:
            for some in slices(b, BATCH):
                sets = [shingles(t) for t in some["text"].to_pylist()]
                number = (TaskContext.get().partitionId() << 32) + made
                made += 1
                yield from _packed(number, some["key"].to_pylist(), sets, deals)

    return docs.mapInArrow(run, ROWS)


def _packed(number: int, keys: list, sets: list[np.ndarray], deals: int):
    sigs = [signature(x) for x in sets]
    m = len(sets)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number % deals] * m, pa.int32()), pa.array([number] * m, pa.int64()),
            pa.array(range(m), pa.int32()), pa.array(keys, pa.int64()),
            pa.array([a for a, _ in sigs], pa.int64()), pa.array([b for _, b in sigs], pa.int64()),
            pa.array([len(x) for x in sets], pa.int64()),
            *(pa.nulls(m, pa.binary()) for _ in range(3)),
        ],
        _names(ROWS),
    )
    flat = np.concatenate(sets).view("u8")
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    part = (flat % np.uint64(deals)).astype("i4")
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(deals + 1))
    # The upper 32 bits of the hash: shingles that share them look like one here, which can only
    # make a text look more like others; links are decided on whole hashes.
    small, who = (flat[order] >> np.uint64(32)).astype("<u4"), owner[order]
    marks = np.array([a & 0xFFFFFFFF for a, _ in sigs], "<u4").tobytes()
    used = [d for d in range(deals) if ends[d] < ends[d + 1]]
    spans = [slice(ends[d], ends[d + 1]) for d in used]
    k = len(used)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()), pa.array([number] * k, pa.int64()), pa.nulls(k, pa.int32()),
            *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.array([marks] * k, pa.binary()),
            pa.array([np.bincount(who[x], minlength=m).astype("<u4").tobytes() for x in spans], pa.binary()),
            pa.array([small[x].tobytes() for x in spans], pa.binary()),
        ],
        _names(ROWS),
    )


def _shared_counts(dealt: DataFrame) -> DataFrame:
    """For every batch of texts, how many shingles of each text some other set holds as well, one
    row per part of the hash space; rows of single texts pass through."""

    def count(table: pa.Table) -> pa.Table:
        single = table.filter(pc.is_valid(table["place"])).select(_names(COUNTED)[:-1])
        single = single.append_column("counts", pa.nulls(len(single), pa.binary()))
        packed = table.filter(pc.is_null(table["place"]))
        if not len(packed):
            return single
        sizes = [np.frombuffer(x, "<u4") for x in packed["sizes"].to_pylist()]
        hashes = np.concatenate([np.frombuffer(x, "<u4") for x in packed["hashes"].to_pylist()])
        marks = packed["marks"].to_pylist()
        mark = np.concatenate([np.repeat(np.frombuffer(a, "<u4"), n) for a, n in zip(marks, sizes)])
        # A shingle is shared if two different sets hold it.
        order = np.argsort(hashes, kind="stable")
        h, who = hashes[order], mark[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        differ = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        shared = np.empty(len(h), bool)
        shared[order] = np.repeat(differ, np.diff(np.append(first, len(h))))
        counts, at = [], 0
        for n in sizes:
            total = int(n.sum())
            text = np.repeat(np.arange(len(n)), n)[shared[at : at + total]]
            counts.append(np.bincount(text, minlength=len(n)).astype("<u4").tobytes())
            at += total
        k = len(packed)
        part = pa.table(
            [packed["batch"], pa.nulls(k, pa.int32()), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.array(counts, pa.binary())],
            names=_names(COUNTED),
        )
        return pa.concat_tables([single, part])

    return dealt.groupBy("part").applyInArrow(count, COUNTED)


def _add_up(counts: DataFrame) -> DataFrame:
    """(batch, place, shared): the parts' counts of each text together."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<u4").astype("i8") for x in table["counts"].to_pylist())
        n = len(total)
        return pa.table({
            "batch": pa.array([table["batch"][0].as_py()] * n, pa.int64()),
            "place": pa.array(range(n), pa.int32()), "shared": pa.array(total),
        })

    return counts.groupBy("batch").applyInArrow(add, "batch long, place int, shared long")


def classes(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(key, sig1, sig2, n) of every document, and the sets (key, sig1, sig2, n, docs; the smallest id
    and the number of documents of each set) that share enough shingles with other sets to link with one at all."""
    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    deals = 4 * parts(docs.sparkSession)
    counted = materialize(_shared_counts(_dealt(narrow, s, deals)))
    rows = counted.filter("place is not null").drop("counts")
    enough = _add_up(counted.filter("place is null").select("batch", "counts"))
    least = F.ceil(F.col("n") * s.percent / 100)
    able = (
        rows.join(enough, ["batch", "place"]).filter((F.col("n") > 0) & (F.col("shared") >= least))
        .groupBy("sig1", "sig2").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.count("*").alias("docs"))
    )
    return rows.select("key", "sig1", "sig2", "n"), materialize(able)


def _candidates(sets: DataFrame, s: Settings) -> DataFrame:
    """(set, group): sets that can link are in one group.

    Linked sets share one of their rarest shingles: in the order of frequency, the first
    n - least_shared(n) + 1. Those no other set holds need no partner. The sets that meet in a
    shingle are tied by links to the smallest id of their size band, and bands to the next band
    (sizes of linked sets differ by less than a band), so a frequent shingle makes no pairs."""
    held = sets.select("key", "n", F.explode("hashes").alias("h"))
    often = held.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    seen = held.join(often, "h")
    per = seen.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    length = F.col("n") - F.ceil(F.col("n") * s.percent / 100) + 1
    alone = F.col("n") - F.size("shared")  # shingles of no other set come first
    some = per.withColumn("prefix", F.slice("shared", F.lit(1), F.greatest(length - alone, F.lit(0)).cast("int")))
    # One more band than exact logarithms need, against rounding at the edges.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(s.percent / 100) * 1.0001))
    posts = materialize(some.select("key", band.alias("band"), F.explode("prefix.h").alias("h")))
    heads = posts.groupBy("h", "band").agg(F.min("key").alias("head"))
    to_head = posts.join(heads, ["h", "band"]).select(F.col("key").alias("a"), F.col("head").alias("b"))
    below = heads.select("h", (F.col("band") + 1).alias("band"), F.col("head").alias("b"))
    across = heads.join(below, ["h", "band"]).select(F.col("head").alias("a"), "b")
    return components(to_head.unionByName(across).filter("a <> b"))


def _tile_links(
    keys: np.ndarray, docs: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect every linked pair of a tile, through other links where they do so already,
    and of each set the documents (``docs`` of each set) of all sets it links with in this tile.

    A tile of two blocks (``side`` tells them apart) holds the pairs of one block with the other, a
    tile of one block its own, so that every pair is in one tile. Shingles that many sets hold are
    multiplied as a dense matrix; for the others the overlaps of one set with all sets add up from
    the columns of its shingles. Overlaps below the bound that the two sizes set are dropped."""
    m = len(sets)
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    alike = len(left) == m
    sizes = np.array([len(x) for x in sets], "i8")
    owner = np.repeat(np.arange(m), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    full = np.bincount(column) > max(8, m // 8)
    dense = np.zeros((m, int(full.sum())), "f4")  # at most 8 times as large as the entries
    often = full[column]
    dense[owner[often], (np.cumsum(full) - 1)[column[often]]] = 1
    # Entries of the other shingles, by row of the left sets and by column of the right ones.
    owner, column = owner[~often], column[~often]
    start = np.searchsorted(owner, np.arange(m + 1))
    here = np.full(m, -1)
    here[right] = np.arange(len(right))
    held = here[owner] >= 0
    order = np.argsort(column[held], kind="stable")
    begin = np.searchsorted(column[held][order], np.arange(len(full) + 1))
    holders = here[owner[held][order]]
    degree = np.zeros(m, "i8")
    label = np.arange(m)
    links = []
    for low in range(0, len(left), 256):
        rows = left[low : low + 256]
        product = (dense[rows] @ dense[right].T).astype("i8")
        for i, shared in zip(rows.tolist(), product):
            mine = column[start[i] : start[i + 1]]
            shared += np.bincount(holders[_spans(begin[mine], begin[mine + 1])], minlength=len(right))
            near = right[100 * shared >= percent * (sizes[right] + sizes[i] - shared)]
            near = near[near != i]
            degree[i] += docs[near].sum()
            if not alike:
                degree[near] += docs[i]
            names, first = np.unique(label[near], return_index=True)
            new = names != label[i]
            if new.any():
                links += [(int(keys[i]), int(keys[j])) for j in near[first[new]]]
                label[np.isin(label, names[new])] = label[i]
    return links, degree


def _spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all spans lo..hi, one after another."""
    n = hi - lo
    total = np.repeat(hi - np.cumsum(n), n)
    return total + np.arange(n.sum())


def links(
    docs: DataFrame, able: DataFrame, s: Settings, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """The sets that were compared (key, sig1, sig2), and rows (a, b, n): links between them, enough to
    connect all that link, and, where b is null, a set and how many documents of other sets it links with."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    again = narrow.alias("d").join(
        able.select("key").distinct().alias("k"), F.col("d.key").eqNullSafe(F.col("k.key")), "left_semi"
    )

    def run(batches):
        release()
        shingles = Shingles(s.words)
        for b in batches:
            for some in slices(b, BATCH):
                sets = [shingles(t) for t in some["text"].to_pylist()]
                sigs = [signature(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a for a, _ in sigs], pa.int64()), pa.array([c for _, c in sigs], pa.int64()),
                        pa.array(sets, pa.list_(pa.int64())),
                    ],
                    ["sig1", "sig2", "hashes"],
                )

    # The number of a set here is the first half of its signature, unless two sets share it.
    found = again.mapInArrow(run, "sig1 long, sig2 long, hashes array<long>")
    sets = materialize(
        found.join(able.select("sig1", "sig2", "docs"), ["sig1", "sig2"])
        .groupBy("sig1", "sig2").agg(F.any_value("hashes").alias("hashes"), F.any_value("docs").alias("docs"))
        .select(
            F.xxhash64("sig1", "sig2").alias("key"), "sig1", "sig2", F.size("hashes").cast("long").alias("n"), "docs", "hashes"
        )
    )
    groups = materialize(_candidates(sets, s))
    size = F.greatest(F.count("*") / BLOCK, F.sum("n") / ENTRIES)
    blocks = (
        groups.join(sets.select(F.col("key").alias("node"), "n"), "node")
        .groupBy("component").agg(F.ceil(size).cast("int").alias("blocks"))
    )
    placed = (
        groups.join(blocks, "component")
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    )
    # Blocks of a group meet two by two: a set goes to every pair that holds its block.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = placed.select(F.col("node").alias("key"), "component", "block", other).select(
        "key", "component", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")
    )
    small = F.pmod(F.xxhash64("component", "x", "y"), F.lit(4 * parts(spark)))
    # Small groups share a task's call; sets of different groups are told apart by their shingles.
    rows = sets.select("key", "docs", "hashes").join(tiles, "key").withColumn("tile", small)

    def product(table: pa.Table) -> pa.Table:
        pdf = table.select(["key", "docs", "component", "block", "x", "y"]).to_pandas()
        hashes = table["hashes"].combine_chunks()
        flat = hashes.values.to_numpy()
        ends = hashes.offsets.to_numpy()
        key, docs, block = (pdf[c].to_numpy() for c in ("key", "docs", "block"))
        found: list[tuple[int, int | None, int | None]] = []
        for (_, x, y), at in pdf.groupby(["component", "x", "y"], sort=True).indices.items():
            if len(at) < 2 or (x != y and len(set(block[at].tolist())) < 2):
                continue
            sets = [flat[ends[i] : ends[i + 1]] for i in at]
            some, degree = _tile_links(key[at], docs[at], block[at], sets, s.percent)
            found += [(a, b, None) for a, b in some]
            found += [(a, None, n) for a, n in zip(key[at].tolist(), degree.tolist()) if n]
        a, b, n = zip(*found) if found else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    pairs = rows.groupBy("tile").applyInArrow(product, "a long, b long, n long")
    return sets.select("key", "sig1", "sig2"), materialize(pairs)


def jaccard_groups(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of near duplicates: id, ``n_shingles``, ``component_id``, the smallest id that links
    lead to, and ``n_links``, how many other documents (rows) the document links with, copies too.

    Documents with the same set are one row of the matrix (copies make no pairs). A first pass over
    the incidence matrix, dealt out by shingle in packed columns, counts for each row the shingles
    that other rows hold; rows below the bound of their size can link with nothing and go. The
    rest are grouped by their rarest shingles, and each group's product is made in blocks, each pair
    in one. Every linked pair counts; links are listed only as far as they connect.

    Null and empty texts have no shingle and stay alone. Repeated rows are kept; a null id counts
    as the largest. An empty table gives no rows."""
    rows, able = classes(docs, settings, id_col, text_col)
    sets, found = links(docs, able, settings, id_col, text_col)
    groups = components(found.filter("b is not null").select("a", "b"))
    degree = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    named = materialize(
        sets.join(groups.withColumnRenamed("node", "key"), "key").join(degree.withColumnRenamed("node", "key"), "key")
        .select("sig1", "sig2", "component", "n_links")
    )
    # First id of every set, then of every component; both are grouped minima.
    first = rows.filter("n > 0").groupBy("sig1", "sig2").agg(F.min("key").alias("first"), F.count("*").alias("docs"))
    in_group = first.join(named, ["sig1", "sig2"], "left")
    least = in_group.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    of_set = in_group.join(least, "component", "left").select(
        "sig1", "sig2", F.coalesce("least", "first").alias("component_id"),
        (F.col("docs") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )
    out = rows.join(of_set, ["sig1", "sig2"], "left")
    alone = F.col("n") == 0
    return out.select(
        F.col("key").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.coalesce("component_id", "key")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
