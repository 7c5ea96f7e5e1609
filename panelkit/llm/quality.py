"""Operator 9: quality rules with a Kneser-Ney perplexity band per language."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import WORDS, slices
from panelkit.sources.io import materialize

ORDER, BITS = 4, 16
WIDTH = 1 << BITS
#: Symbols worked on at a time.
CHUNK = 2_000_000
#: Grams that make up at least this share of all symbols go to every worker: at most 1 / SHARE.
SHARE = 2.0**-21
MARKS = "#*$%&|<>"


def symbol_table() -> np.ndarray:
    """The 16-bit symbol of each code point: 0 for white space, one for all digits, else the code
    point of the lower-case letter. Code points over 65,535 share the 6,400 private ones."""
    table = np.arange(0x110000)
    table[0] = 1
    for cp in range(0x110000):
        c = chr(cp)
        low = c.lower()
        if c.isspace():
            table[cp] = 0
        elif c.isdigit():
            table[cp] = ord("0")
        elif low != c and len(low) == 1:
            table[cp] = ord(low)
    return np.where(table < WIDTH, table, 0xE000 + table % 6400).astype("u2")


class Grams:
    """Numbers of the four-symbol grams of texts; white space comes before and after a text."""

    def __init__(self):
        self.table = symbol_table()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Grams of all texts (one per symbol) and how many each text has."""
        line = "\n\n\n".join(texts) + "\n\n\n"
        points = np.frombuffer(line.encode("utf-32-le", "replace"), "<u4")
        ends = np.cumsum([len(t) + 3 for t in texts])
        s = self.table[points]
        owner = np.zeros(len(s), "i4")
        owner[ends[:-1]] = 1
        owner = np.cumsum(owner, dtype="i4")
        gap = s == 0
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        keep[0] = not gap[0]
        begin = np.zeros(len(s), bool)  # white space at the start of a text is no symbol
        begin[np.concatenate([[0], ends[:-1]])] = True
        keep &= ~(begin & gap)
        s, owner = s[keep].astype("u8"), owner[keep]
        p = np.zeros((3, len(s)), "u8")
        for k in range(1, 4):
            same = owner[k:] == owner[:-k]
            p[k - 1, k:] = np.where(same, s[:-k], 0)
        grams = (p[2] << 3 * BITS) | (p[1] << 2 * BITS) | (p[0] << BITS) | s
        return grams, np.bincount(owner, minlength=len(texts))


def count_grams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each gram occurs in all whole texts: (gram, n), as many rows as the corpus has
    different grams. Tasks count what they read and shuffle a row per gram and task."""

    def count(batches):
        grams = Grams()
        for b in batches:
            for some in (x for part in slices(b["text"], 512) for x in _chunks(part.to_pylist())):
                g, n = np.unique(grams(some)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view("i8")), pa.array(n)], ["gram", "n"])

    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _chunks(texts: list[str | None]) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size > CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def _discounts(level: DataFrame) -> list[float]:
    """What is taken off counts of 1, 2 and 3 or more."""
    got = level.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
    n = [0, *got]
    if not all(n[1:]):  # too few grams to estimate from
        return [0.5, 0.75, 0.9]
    y = n[1] / (n[1] + 2 * n[2])
    d = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
    return [min(max(x, 0.1), most) for x, most in zip(d, (0.95, 1.9, 2.9))]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Interpolated modified Kneser-Ney model of four-symbol grams: (gram, n, bits).

    Shorter grams count their different left extensions, and their table is the basis of the
    longer ones'. No key of a join has more than 2 ** 16 rows (a gram less a symbol), and only
    tables keyed by at most one symbol are broadcast."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        ending = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
        levels[k] = materialize(levels[k + 1].groupBy(ending).agg(F.count("*").alias("n")))
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[k])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("gram", BITS) if k > 1 else F.lit(0)
        rows = levels[k].withColumn("off", off).withColumn("context", context)
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("spared"))
        rows = rows.join(F.broadcast(totals) if k <= 2 else totals, "context")
        if k == 1:  # below it every symbol is alike
            rows = rows.withColumn("p_short", F.lit(1.0 / WIDTH))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            rows = rows.join(F.broadcast(lower) if k == 2 else lower, "short")
        p = (F.col("n") - F.col("off") + F.col("spared") * F.col("p_short")) / F.col("total")
        model = rows.select("gram", "n", p.alias("p"))
        lower = model.select(F.col("gram").alias("short"), F.col("p").alias("p_short"))
    return model.select("gram", "n", (-F.log2("p")).alias("bits"))


@dataclass(frozen=True)
class Model:
    """``table`` holds (gram, n, bits) of every gram of the corpus. ``grams`` (sorted) and ``bits``
    repeat the frequent ones, at most 1 / SHARE, for the workers; ``cut`` is their least count."""

    table: DataFrame
    grams: np.ndarray
    bits: np.ndarray
    cut: int


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the grams of the whole corpus and build the model from the counts, all in Spark; only
    the frequent grams come to the driver."""
    counts = materialize(count_grams(docs, text_col))
    table = materialize(kneser_ney(counts))
    cut = max(1, math.ceil((counts.agg(F.sum("n")).first()[0] or 0) * SHARE))
    often = table.filter(F.col("n") >= cut).select("gram", "bits").toArrow()
    grams = often["gram"].to_numpy().view("u8")
    order = np.argsort(grams)
    return Model(table, grams[order], often["bits"].to_numpy()[order].astype("f4"), cut)


class Scorer:
    def __init__(self, often: tuple[np.ndarray, np.ndarray]):
        (self.often, self.bits), self.grams = often, Grams()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each text: bits of its frequent grams, number of symbols, and its other grams with
        their counts."""
        grams, sizes = self.grams(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if len(self.often):
            at = np.minimum(np.searchsorted(self.often, grams), len(self.often) - 1)
            known = self.often[at] == grams
            bits = np.bincount(owner[known], self.bits[at[known]], len(texts))
        else:
            known, bits = np.zeros(len(grams), bool), np.zeros(len(texts))
        grams, owner = grams[~known], owner[~known]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(grams)))
        ends = np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(texts))))
        rare = pa.StructArray.from_arrays(
            [pa.array(grams[first].view("i8")), pa.array(n, pa.int64())], ["gram", "n"]
        )
        return bits, sizes, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "i8")
    key = ids[:n]
    for k in range(1, window):
        pair = key * (len(number) + 1) + ids[k : k + n]
        _, key = np.unique(pair, return_inverse=True)
    often = np.bincount(key)[key] > 1
    if not often.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + n] |= often
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return (
        len(words), sum(map(len, words)), sum(map(text.count, MARKS)), len(lines) - len(set(lines)),
        repeated_words(words),
    )


RULES = (
    "key long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, often_bits double, n_grams long, row long"
)
RARE = "rare array<struct<gram: long, n: long>>"
#: Resolution of the perplexity (bits per symbol) when bands are set.
STEP = 0.001


def measure(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts, the bits under the model and the number of symbols of every whole text.

    Frequent grams are looked up where the text is read. The others, a small share of any corpus,
    are joined with the model, so nothing is left out and no worker holds a model that grows. A
    gram in that join has at most a share of SHARE of all symbols."""
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.bits))

    def run(batches):
        scorer, row = Scorer(shared.value), TaskContext.get().partitionId() << 36
        for b in (part for whole in batches for part in slices(whole, 512)):
            at = 0
            for some in _chunks(b["text"].to_pylist()):
                bits, sizes, rare = scorer(some)
                base = list(zip(*map(base_counts, some)))
                part = b.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["key"], part["lang"], *(pa.array(c, pa.int64()) for c in base), pa.array(bits, pa.float64()),
                        pa.array(sizes, pa.int64()), pa.array(np.arange(row, row + len(some))), rare,
                    ],
                    [*(f.split()[0] for f in RULES.split(", ")), "rare"],
                )
                row += len(some)

    narrow = docs.select(
        F.col(id_col).cast("long").alias("key"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
    )
    rows = materialize(narrow.mapInArrow(run, f"{RULES}, {RARE}"))  # written once: row numbers stay
    rare = rows.select("row", F.inline("rare"))
    found = rare.join(model.table.filter(F.col("n") < model.cut).select("gram", "bits"), "gram")
    more = found.groupBy("row").agg(F.sum(F.col("n") * F.col("bits")).alias("rare_bits"))
    bits = F.col("often_bits") + F.coalesce("rare_bits", F.lit(0.0))
    return rows.drop("rare").join(more, "row", "left").withColumn("bits", bits).drop("row", "often_bits", "rare_bits")


def quality(
    docs: DataFrame, min_words: int = 50, repeat_pct: int = 50, width: float = 6.0,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Base rules and perplexity bands: id, the five base counts, ``base_failed``, ``kept``, and
    ``perplexity``, ``lower``, ``upper``.

    The model covers all texts. A language's band is the median of the bits per symbol of its
    documents that pass the base rules, plus and minus ``width`` robust deviations (median absolute
    deviation / 0.6745, at least 0.02 bits); perplexity outside it is rejected. Short texts stray
    further by chance: the deviation of a text of n symbols counts sqrt(n / (n + 300)) times. Documents without
    lang have a band of their own. Null and empty texts have counts of 0 and fail the base rules;
    repeated rows stay; an empty table gives no rows."""
    model = fit(docs, text_col)
    rows = materialize(measure(docs, model, id_col, text_col, lang_col))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn(
        "step", F.round(F.col("bits") / F.greatest("n_grams", F.lit(1)) / STEP).cast("long")
    )
    # Counts per language and step, then exact medians of those: nothing grows with the documents.
    steps = rows.filter(~failed).groupBy("lang", "step").agg(F.count("*").alias("n"))
    steps = materialize(steps)
    middle = steps.groupBy("lang").agg(F.expr("percentile(step, 0.5, n)").alias("mid"))
    off = steps.alias("s").join(middle.alias("m"), F.col("s.lang").eqNullSafe(F.col("m.lang")))
    spread = (
        off.select("s.lang", "s.n", "m.mid", F.abs(F.col("s.step") - F.col("m.mid")).alias("off"))
        .groupBy("lang", "mid").agg(F.expr("percentile(off, 0.5, n)").alias("mad"))
    )
    reach = F.lit(width) * F.greatest(F.col("mad") / 0.6745, F.lit(0.02 / STEP))
    bands = spread.select(
        F.col("lang").alias("_lang"), (F.col("mid") - reach).alias("_low"), (F.col("mid") + reach).alias("_high")
    )
    out = rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    trust = F.sqrt(F.col("n_grams") / (F.col("n_grams") + 300))
    middle = (F.col("_low") + F.col("_high")) / 2
    inside = F.abs(F.col("step") - middle) * trust <= (F.col("_high") - F.col("_low")) / 2
    return out.select(
        F.col("key").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.pow(F.lit(2.0), F.col("step") * STEP).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("_low") * STEP).alias("lower"),
        F.pow(F.lit(2.0), F.col("_high") * STEP).alias("upper"),
    )
