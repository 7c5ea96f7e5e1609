"""Operator 10: language identification by cross-parsing entropy."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkit.llm.common import in_fold, slices
from panelkit.llm.units import release

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    #: Bound on the labelled text of a language: characters, and rows they are taken from.
    chars: int = 24_000
    rows: int = 200
    #: The most frequent letters, with a column of the dense table each. All others of the labelled
    #: text have symbols too, with sparse transitions.
    letters: int = 61
    #: A text is parsed in windows of so many characters, each from its own start.
    window: int = 1024
    #: Bounds over all languages together: characters (more languages get fewer each), and bytes of the
    #: dense table (more languages get fewer dense letters, which changes no result).
    total: int = 2_400_000
    dense: int = 160_000_000

    def shared_by(self, languages: int) -> Settings:
        chars = min(self.chars, max(64, self.total // max(languages, 1)))
        # An automaton has at most twice as many states as symbols, in text about one and a half times.
        width = self.dense // (6 * chars * max(languages, 1))
        if languages * chars * 16 >= 2**31:
            raise ValueError(f"{languages} languages are too many for one table")
        return replace(self, chars=chars, letters=max(0, min(self.letters, width - 2)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    letters: str  # symbol 2 and on, dense ones first; 0 is the gap between words, 1 any other letter
    edges: bytes  # packed transition table of the dense symbols, int32 [state * width + symbol]
    sparse: bytes  # packed keys (state * width << 32 | symbol, ascending), then entries, int64
    starts: bytes  # packed int32 [symbol beyond width, language]: what follows a failure
    states: int
    roots: tuple[int, ...]
    own: tuple[float, ...]  # breaks per symbol of a language's labelled text by one half of it
    settings: Settings

    @property
    def width(self) -> int:
        return min(len(self.letters), self.settings.letters) + 2


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: a path from state 0 for each of its
    factors, with at most twice as many states as symbols."""
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and s not in edges[at]:
            edges[at][s] = new
            at = link[at]
        if at >= 0:
            to = edges[at][s]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(edges)
                edges.append(dict(edges[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and edges[at].get(s) == to:
                    edges[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return edges


def symbol_table(letters: str) -> np.ndarray:
    """Symbol of each code point: letters by their lower case, everything else is a gap."""
    number = {c: i + 2 for i, c in enumerate(letters)}
    table = np.zeros(0x110000, "i4")
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = number.get(c.lower(), 1)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of gaps as one."""
    out = table[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    gap = out == 0
    return out[~(gap & np.concatenate([[True], gap[:-1]]))] if len(out) else out


def build(texts: dict[str, list[str]], settings: Settings) -> Model:
    """One automaton per language, in one table. Every entry already holds what follows a failure:
    the state after the symbol, and whether a phrase ended before it."""
    settings = settings.shared_by(len(texts))
    common = Counter(c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha())
    ranked = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    letters = "".join(sorted(ranked[: settings.letters]) + ranked[settings.letters :])
    number = {c: i + 2 for i, c in enumerate(letters)}
    width = min(len(letters), settings.letters) + 2
    tables, roots, offset, own = [], [], 0, []
    keys: list[int] = []
    entries: list[int] = []
    starts = np.empty((len(letters) + 2 - width, len(texts)), "<i4")
    for i, language in enumerate(sorted(texts)):
        seq: list[int] = []
        for t in texts[language]:
            seq.append(0)
            for c in t.lower():
                s = number.get(c, 1) if c.isalpha() else 0
                if s or seq[-1]:
                    seq.append(s)
            if len(seq) >= settings.chars:
                break
        seq = seq[: settings.chars]
        own.append(_own_rate(seq))
        edges = suffix_automaton(seq)
        # An entry is the next state times 4 plus the phrases that end: one where the match cannot
        # go on, and one more for a symbol that the labelled text does not hold, itself a phrase.
        root = np.full(width, offset * width * 4 + 2, "i8")
        starts[:, i] = offset * width * 4 + 2
        for s, to in edges[0].items():
            if s >= width:
                starts[s - width, i] = (to + offset) * width * 4 + 1
            elif s != 1:
                root[s] = (to + offset) * width * 4 + 1
        table = np.tile(root, (len(edges), 1))
        table[0] -= 1  # no phrase is open at the root
        for state, out in enumerate(edges):
            for s, to in out.items():
                if s >= width:
                    keys.append((state + offset) * width << 32 | s)
                    entries.append((to + offset) * width * 4)
                elif s != 1:
                    table[state, s] = (to + offset) * width * 4
        tables.append(table)
        roots.append(offset * width)
        offset += len(edges)
    packed = b"".join(t.astype("<i4").tobytes() for t in tables)  # shared_by keeps entries below 2^31
    order = np.argsort(np.array(keys, "<i8"))
    sparse = np.concatenate([np.array(keys, "<i8")[order], np.array(entries, "<i8")[order]]).tobytes()
    return Model(
        tuple(sorted(texts)), letters, zlib.compress(packed, 1), zlib.compress(sparse, 1), starts.tobytes(), offset,
        tuple(roots), tuple(own), settings,
    )


def _own_rate(seq: list[int]) -> float:
    """Breaks per symbol of the second half of a sequence parsed by its first: somewhat more than
    further text of the language needs, as it is learnt from half as much."""
    half = len(seq) // 2
    edges, state, breaks = suffix_automaton(seq[:half]), 0, 0
    for s in seq[half:]:
        if s not in edges[state]:
            breaks += 1
            state = 0
        state = edges[state].get(s, 0)
    return breaks / max(1, len(seq) - half)


def fit(
    docs: DataFrame, settings: Settings = Settings(), folds: int | None = 3, held: int = 1,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Labelled text per language from rows outside the held-out fold: of each language the
    ``settings.rows`` rows with the smallest hash of their id, up to ``settings.chars`` characters;
    texts longer than a tenth of that come last. With many languages each has fewer characters
    (``Settings.total``). So the driver and the workers hold a bound whatever the labels are."""
    rows = docs.select(
        F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("lang is not null and text is not null and key is not null")
    if folds:
        rows = rows.filter(~in_fold("key", folds, held))
    chars = settings.shared_by(rows.select("lang").distinct().count()).chars
    long = F.length("text") > settings.chars // 10
    order = [long, F.xxhash64("key"), F.col("key"), F.xxhash64("text")]
    first = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    narrow = rows.select("lang", "key", long.alias("long"), F.xxhash64("text").alias("digest"))
    by_id = Window.partitionBy("lang").orderBy("long", F.xxhash64("key"), "key", "digest")
    chosen = narrow.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= settings.rows)
    # at most settings.rows ids per language
    sample = rows.withColumn("digest", F.xxhash64("text")).join(
        F.broadcast(chosen.select("lang", "key", "digest").distinct()), ["lang", "key", "digest"]
    )
    top = sample.withColumn("n", first).filter(F.col("n") <= settings.rows).withColumn("text", F.substring("text", 1, chars))
    before = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    needed = F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) < 2 * chars  # gaps count once
    got = top.withColumn("needed", needed).filter("needed").select("lang", "n", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.n)):
        texts.setdefault(r.lang, []).append(r.text)
    return build(texts, settings)


class Parser:
    """Phrases of texts against every language."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.frombuffer(zlib.decompress(model.edges), "<i4")
        self.symbols = symbol_table(model.letters)
        self.roots = np.array(model.roots, "i4")
        self.keys, self.entries = np.frombuffer(zlib.decompress(model.sparse), "<i8").reshape(2, -1)
        self.starts = np.frombuffer(model.starts, "<i4").reshape(-1, max(1, len(model.roots)))

    def _step(self, state: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Entries [window, language] for the next symbol of each window."""
        width = self.model.width
        if not len(self.keys) or not (rare := here >= width).any():
            return self.table[state + here[:, None]]
        out = self.table[state + np.where(rare, 0, here)[:, None]]
        at, symbol = state[rare].astype("i8"), here[rare]
        missed = self.starts[symbol - width] - (at == self.roots)
        key = at << 32 | symbol[:, None]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[rare] = np.where(self.keys[place] == key, self.entries[place], missed)
        return out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases [text, language] and of symbols [text].

        A phrase is the longest match with the labelled text; where it ends, the next begins. All
        windows of all texts step in parallel, longest first, so those at work are a prefix."""
        size = self.model.settings.window
        cut = [symbols(t or "", self.symbols) for t in texts]
        lengths = np.array([len(c) for c in cut], "i8")
        pieces = -(-lengths // size)
        owner = np.repeat(np.arange(len(cut)), pieces)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        inside = np.minimum(size, np.repeat(lengths, pieces) - first * size)
        begin = np.repeat(np.cumsum(lengths) - lengths, pieces) + first * size
        order = np.argsort(-inside, kind="stable")
        inside, begin, owner = inside[order], begin[order], owner[order]
        # Symbols by step: for each step the windows still at work, one row of all windows.
        flat = np.concatenate(cut).astype("i4") if cut else np.empty(0, "i4")
        out = np.zeros((len(texts), len(self.roots)), "i8")
        for at in range(0, len(owner), 4096):
            span = slice(at, at + 4096)
            size_, begin_ = inside[span], begin[span]
            state = np.tile(self.roots, (len(size_), 1))
            ended = np.zeros_like(state)
            active = np.searchsorted(-size_, -np.arange(1, size_[0] + 1), "right")
            for step, n in enumerate(active.tolist()):
                here = flat[begin_[:n] + step]
                step_to = self._step(state[:n], here)
                ended[:n] += step_to & 3
                state[:n] = step_to >> 2
            np.add.at(out, owner[span], ended + (state != self.roots))  # open ones end here
        return out, lengths

    def best(self, texts: list[str | None]) -> list[tuple[str, float, float | None, int | None]]:
        """(language, score, breaks per symbol, symbols) of each text. A break is a phrase beyond the
        one that every window ends with, so a text that matches throughout has none."""
        names = self.model.languages
        if not names:
            return [(UNDETERMINED, 0.0, None, None)] * len(texts)
        out = []
        for text, counts, n in zip(texts, *self.phrases(texts)):
            if not any(map(str.isalpha, text or "")):
                out.append((UNDETERMINED, 0.0, None, None))
                continue
            i = int(counts.argmin())
            mine, rest = int(counts[i]), int(counts.sum() - counts[i])
            share = rest / (rest + (len(names) - 1) * mine) if len(names) > 1 else 1.0
            breaks = max(0, mine + int(-n // self.model.settings.window))
            out.append((names[i], share, breaks / int(n), int(n)))
        return out


def predict(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """Column of (lang_pred, score, rate, symbols): the language with fewest phrases per symbol, its
    share of the match (phrases of the others against its own, 0 to 1), its breaks per symbol (phrases
    beyond one per window) and the number of symbols.

    ``und`` with score 0 if the text is null or has no letter, or no language was learnt. Equal
    counts go to the first language by name. Whole texts are parsed."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rate double, symbols long")
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        parser = Parser(shared.value)
        for texts in batches:
            found = [r for some in slices(texts, 512) for r in parser.best(some.to_pylist())]
            langs, scores, rates, sizes = zip(*found) if found else ((), (), (), ())
            yield pa.StructArray.from_arrays(
                [
                    pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64()),
                    pa.array(sizes, pa.int64()),
                ],
                ["lang_pred", "score", "rate", "symbols"],
            )

    return parsed(F.col(text_col))


def identify(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """Language of every text: id, ``held_out``, ``lang_pred``, ``score``. Repeated rows stay; an
    empty table gives no rows; id, source and lang never enter a prediction."""
    model = fit(docs, settings, 3, 1, id_col, text_col, lang_col)
    found = predict(docs.sparkSession, model, text_col)
    out = docs.select(F.col(id_col), in_fold(id_col, 3, 1).alias("held_out"), found.alias("_found"))
    return out.select(id_col, "held_out", "_found.lang_pred", "_found.score")
