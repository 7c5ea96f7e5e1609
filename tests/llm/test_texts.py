import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import fingerprint, jaccard, langid, licenses, mixing, quality, queries, toxicity
from panelkit.llm.components import components
from tests.llm.common import empty, odd, odd_rows, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- mixing ------------------------------------------------------------------------------------

def targets(sizes: dict, cycle=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: cycle[i % 3] for i, s in enumerate(order)}
    held, free, total = {}, set(order), sum(sizes.values())
    while free:
        level = (total - sum(held.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return held | {s: weight[s] * level for s in free}
        held |= {s: float(most * sizes[s]) for s in over}
        free -= over
    return held


def test_targets_and_totals(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[source[r.doc_id]] += r.size
    want = targets(sizes)
    taken, largest = Counter(), Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s]
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_odd_rows(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    twice = [r.copies for r in rows if r.doc_id == 105]
    assert len(twice) == 2 and abs(twice[0] - twice[1]) <= 1
    assert mixing.mix(empty(spark)).count() == 0


def test_many_equal_rows_meet_the_target(spark):
    rows = [(i, "w " * (1 + i % 90), "a") for i in range(300)] + [(None, "the same words here", "a")] * 10_000
    rows += [(None, f"other words {i % 50}", "a") for i in range(2000)] + [(i, "v " * 40, "b") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for source, want in target.items():
        assert abs(taken[source] - want) < 0.01 * want


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    for got in {r.target for r in rows}:
        some = [r for r in rows if r.target == got]
        assert abs(sum(r.taken for r in some) - got) <= 60


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    pi, size = rng.random(500), rng.integers(1, 900, 500).astype(float)
    out = mixing.flight(pi, size, rng.random(500))
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2
    assert abs(out.sum() - pi.sum()) < 1e-6 and abs(out @ size - pi @ size) < 1e-4
    assert not ((mixing.landing(out, size) > 0) & (mixing.landing(out, size) < 1)).any()


def test_flight_is_unbiased():
    rng = np.random.default_rng(3)
    pi, size = np.array([0.2, 0.5, 0.7, 0.4, 0.9]), np.array([3.0, 8, 5, 5, 1])
    mean = np.mean([mixing.flight(pi, size, rng.random(5)) for _ in range(4000)], axis=0)
    assert np.abs(mean - pi).max() < 0.04


# ---- near duplicates ---------------------------------------------------------------------------

def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_groups_match_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(k)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 30, 120, 200]))]
        for _ in range(rng.choice([1, 2, 9, 30])):
            rows.append(edited(rng, base, rng.choice([0, 0, 1, 2, 4, 7])))
        passage = " ".join(f"p{j}" for j in range(60))
        rows.append(passage + " " + " ".join(base))
    rows += ["", None, "one", "ONE", "one two", "one two", "a b c d e f"]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, h string, n int")
    got = jaccard.jaccard_groups(docs.repartition(5), jaccard.Settings(k, percent)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, k, percent)


def test_groups_of_odd_rows(spark):
    got = jaccard.jaccard_groups(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    group = {r.doc_id: r.component_id for r in got}
    assert group[103] == group[104] == group[105] == 103 and group[100] == 100 and group[101] == 101
    assert jaccard.jaccard_groups(empty(spark)).count() == 0


def brute_links(rows, k, percent):
    """Of each row, how many other rows it links with."""
    sets = [shingles(t, k) for _, t in rows]
    return sorted(
        (i, sum(1 for b, y in enumerate(sets) if a != b and x and y and 100 * len(x & y) >= percent * len(x | y)))
        for a, ((i, _), x) in enumerate(zip(rows, sets))
    )


@pytest.mark.parametrize("block", [5, 1500])
def test_links_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    rows = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i l", "", None, "", "one", "ONE"]
    for g in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([30, 120]))]
        rows += [edited(rng, base, rng.choice([0, 0, 1, 3])) for _ in range(rng.choice([3, 12, 40]))]
    rows = list(enumerate(rows))
    rows += [rows[0], rows[20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_groups(docs, jaccard.Settings(3, 75)).collect()
    want = brute_links(rows, 3, 75)
    assert sorted((r.doc_id, r.n_links) for r in got) == want
    assert dict(want)[1] == 3 and dict(want)[3] == 0  # three sets link mutually, one of them is twice there


def test_link_counts_are_returned(spark, sf):
    got = queries.op6_link_counts(spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_links) for r in got) == brute_links(rows, 3, 90)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2001, 2000), (2000, 2001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(50))
    assert got[2001] == 2000 and len(got) == 353


# ---- fingerprints ------------------------------------------------------------------------------

def test_edit_probe_matches_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        n, m = len(t), len(t) // 2
        e = (t[: n - m] + nxt[:m]).encode()
        f, g, h = (fingerprint.digest(x) for x in (t.encode(), e, nxt.encode()))
        want.append((i, n, hashlib.sha256(e).hexdigest(), f, g, fingerprint.likeness(f, g), fingerprint.likeness(f, h)))
    got = [tuple(r) for r in fingerprint.edit_probe(docs).collect()]
    assert sorted(got) == sorted(want)
    assert fingerprint.edit_probe(empty(spark)).count() == 0
    assert len(fingerprint.edit_probe(odd(spark)).collect()) == len(odd_rows())
    one = fingerprint.edit_probe(docs.filter("doc_id = 0")).first()
    assert one.near_next == 1.0


def test_fingerprints_tell_edits_from_others(spark, sf):
    rows = queries.op7_fingerprints(spark, sf).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    t = " ".join(texts(3, 3))
    assert fingerprint.likeness(fingerprint.digest(t.encode()), fingerprint.digest(t.encode())) == 1.0
    docs = spark.createDataFrame([(t,), (None,)], "text string")
    a, b = docs.select(fingerprint.fingerprint().alias("f")).collect()
    assert a.f == fingerprint.digest(t.encode()) and b.f == fingerprint.digest(b"")


# ---- quality -----------------------------------------------------------------------------------

def brute_base(t):
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(windows)
    hit = {j for i, x in enumerate(windows) if c[x] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_counts():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choices(["a ", "b ", "c\n", "a b c ", "# ", "|x\n", "\t", "d\n\n"], k=rng.randint(0, 60)))
        assert quality.base_counts(t) == brute_base(t)


def brute_bits(texts):
    """Bits per text and number of symbols under the interpolated model, from nested dictionaries."""
    table = quality.symbol_table()
    seqs = []
    for t in texts:
        s = [int(table[ord(c)]) for c in t.strip() + " "] if t.strip() else []
        seqs.append([x for i, x in enumerate(s) if x or (i and s[i - 1])])
    grams = [[tuple(([0, 0, 0] + s)[i : i + 4]) for i in range(len(s))] for s in seqs]
    by = {4: Counter(g for some in grams for g in some)}
    for k in (3, 2, 1):
        by[k] = Counter(g[1:] for g in by[k + 1])
    p = {(): 1 / 65536}
    for k in (1, 2, 3, 4):
        n = [sum(c == i for c in by[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0.5, 0.75, 0.9]
        if all(n[1:]):
            d = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), m) for i, m in zip((1, 2, 3), (0.95, 1.9, 2.9))]
        total, spared = Counter(), Counter()
        for g, c in by[k].items():
            total[g[:-1]] += c
            spared[g[:-1]] += d[min(c, 3) - 1]
        for g, c in by[k].items():
            p[g] = (c - d[min(c, 3) - 1] + spared[g[:-1]] * p[g[1:]]) / total[g[:-1]]
    return [(-sum(np.log2(p[g]) for g in some), len(some)) for some in grams]


@pytest.mark.parametrize("share", [2.0**-21, 0.002, 1.0])
def test_bits_match_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(quality, "SHARE", share)
    docs = odd(spark)
    model = quality.fit(docs)
    assert len(model.grams) <= 1 / share
    got = quality.measure(docs, model).collect()
    want = brute_bits([r[1] or "" for r in odd_rows()])
    assert len(got) == len(want)
    for (bits, n), (b, k) in zip(sorted((r.bits, r.n_grams) for r in got), sorted(want)):
        assert n == k and abs(bits - b) <= 1e-5 * max(b, 1)


def test_gram_counts_match_brute_force(spark):
    table = quality.symbol_table()
    want = Counter()
    for _, t, *_ in odd_rows():
        if not (t or "").strip():
            continue
        s = [int(table[ord(c)]) for c in t.strip() + " "]
        s = [x for i, x in enumerate(s) if x or (i and s[i - 1])]
        for i in range(len(s)):
            a, b, c = (s[i - k] if i >= k else 0 for k in (3, 2, 1))
            want[a << 48 | b << 32 | c << 16 | s[i]] += 1
    got = {r.gram % 2**64: r.n for r in quality.count_grams(odd(spark)).collect()}
    assert got == dict(want)


def test_quality_of_odd_rows(spark):
    rows = quality.quality(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    want = Counter((r[0], *brute_base(r[1] or "")) for r in odd_rows())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality(empty(spark)).count() == 0


def test_band_drops_strange_text(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(texts(9, 5)[0].split(), k=120)), "en") for i in range(120)]
    rows.append((500, "".join(rng.choices("qxzjvk#%^~ ", k=900)) + " q z" * 30, "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.kept, r.base_failed) for r in quality.quality(docs, repeat_pct=100).collect()}
    assert kept[500] == (False, False) and np.mean([kept[i][0] for i in range(120)]) > 0.95


# ---- classifiers -------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic = [r.score for r in held if r.toxic == 1]
    clean = np.sort([r.score for r in held if r.toxic == 0])
    assert np.mean(np.searchsorted(clean, toxic)) / len(clean) > 0.95
    assert np.mean(clean >= 0.5) < 0.01 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd(spark), labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    none = toxicity.toxicity(odd(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97


def phrases(text, learnt):
    """Greedy cross parsing of a sequence by longest matches with another."""
    def inside(x):
        return any(learnt[i : i + len(x)] == x for i in range(len(learnt)))

    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and inside(text[at : at + k]):
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_phrases_match_brute_force():
    learnt = {"aa": ["the rain in the garden"], "bb": ["das haus am see"]}
    model = langid.build(learnt, langid.Settings())
    parser = langid.Parser(model)
    number = {c: i + 2 for i, c in enumerate(model.letters)}
    some = ["the garden", "am haus", "rain, das in", "qq", "See see see the", ""]
    counts, lengths = parser.phrases(some)
    for t, got, n in zip(some, counts, lengths):
        s = langid.symbols(t, parser.symbols).tolist()
        assert len(s) == n
        for name, k in zip(model.languages, got):
            seq = [0] + [number.get(c, 1) if c.isalpha() else 0 for c in learnt[name][0]]
            seq = [-1 if x == 1 else x for x in seq]
            if s:
                assert abs(phrases(s, seq) - k) <= 1, (t, name)  # unseen symbols start the next phrase


def test_many_languages_stay_bounded(spark):
    """Each of 500 made languages has words of its own; the table keeps its bounds and finds them."""
    rng = random.Random(12)
    own = {f"l{i:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(500)}
    texts = {lang: [" ".join(rng.choices(words, k=60)) for _ in range(2)] for lang, words in own.items()}
    small = langid.Settings(total=500 * 600, dense=20_000_000)
    model = langid.build(texts, small)
    held = len(zlib.decompress(model.edges))
    assert held <= 2 * small.dense and model.states * model.width * 4 < 2**31 and len(model.languages) == 500
    parser = langid.Parser(model)
    some = rng.sample(sorted(own), 40)
    found = parser.best([" ".join(rng.choices(own[lang], k=30)) for lang in some])
    assert [f[0] for f in found] == some
    few = {k: texts[k] for k in sorted(texts)[:5]}
    wide, narrow = langid.build(few, langid.Settings()), langid.build(few, langid.Settings(dense=1))
    assert (narrow.width, wide.width) == (2, 28)
    probe = [t for ts in few.values() for t in ts] + ["", "?", "zzz qq"]
    assert langid.Parser(wide).best(probe) == langid.Parser(narrow).best(probe)
    with pytest.raises(ValueError):
        langid.Settings().shared_by(10**7)


def scripts(seed=4, rows=60):
    """Texts of four scripts that together have far more than 61 letters."""
    rng = random.Random(seed)
    words = {
        "en": "the of and rain wind market house river stone light green paper".split(),
        "ru": "и в не на дождь ветер рынок дом река камень свет зелёный бумага чай щука эхо юг объезд".split(),
        "el": "και το της βροχή άνεμος αγορά σπίτι ποταμός πέτρα φως πράσινο χαρτί ψωμί ξύλο".split(),
    }
    han = [chr(0x4E00 + k) for k in rng.sample(range(5000), 600)]
    words["zh"] = [rng.choice(han) + rng.choice(han) for _ in range(900)]
    weights = {k: [1 / (i + 1) for i in range(len(w))] for k, w in words.items()}
    out = []
    for k, w in words.items():
        for _ in range(rows):
            some = rng.choices(w, weights[k], k=rng.randint(40, 120))
            out.append((len(out), ("" if k == "zh" else " ").join(some), k))
    return out


def test_phrases_of_many_letters_match_brute_force():
    learnt = {}
    for _, t, k in scripts(rows=2):
        learnt.setdefault(k, []).append(t)
    few = langid.Parser(langid.build(learnt, langid.Settings(letters=5)))
    all_ = langid.Parser(langid.build(learnt, langid.Settings(letters=10_000)))
    some = [t for _, t, _ in scripts(seed=9, rows=3)] + ["", "qщ水 ξq", "Ω", "ابجد"]
    assert len(few.keys) and not len(all_.keys)
    for a, b in zip(few.phrases(some), all_.phrases(some)):
        assert (a == b).all()


def test_language_of_many_scripts(spark):
    rows = scripts()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [(i, k) for i, _, k in rows if got[i].held_out]
    assert {k for _, k in held} == {"en", "ru", "el", "zh"} and all(got[i].lang_pred == k for i, k in held)


def test_language_of_odd_rows(spark):
    rows = langid.identify(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {100, 101, 102, 109} <= und and 108 not in und and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(empty(spark)).count() == 0
    blank = odd(spark).selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}


def test_licenses(spark, sf):
    rows = {(r.doc_id, r.family): r for r in licenses.scan(odd(spark)).collect()}
    assert rows[110, "cc-by-nc"].confirmed and set(rows) == {(110, "cc-by-nc")}
    assert licenses.scan(empty(spark)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "all-rights-reserved",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    }
    want = sorted(
        (r.doc_id, k, lines[line]) for r in docs.collect() for k, line in enumerate((r.text or "").split("\n")) if line in lines
    )
    got = licenses.scan(docs)
    assert sorted((r.doc_id, r.paragraph, r.family) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_licenses_look_at_paragraphs_without_anchor_words(spark):
    notice = "is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    texts = {1: f"the first line\n{notice}\n\nanother line", 2: None, 3: "", 4: "a single line of prose", 5: notice}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lines = sorted(map(tuple, licenses.paragraphs(docs, "doc_id", "text").collect()))
    assert lines == [(k, i, x) for k, v in texts.items() if v is not None for i, x in enumerate(v.split("\n"))]
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("9L AS doc_id", "text")
    got = licenses.scan(docs.unionByName(corpus)).filter("doc_id < 9")
    assert sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in got.collect()) == [(1, 1, "mit", True), (5, 0, "mit", True)]
