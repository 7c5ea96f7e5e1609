import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from panelkit.llm import chat, oracles, queries, repair
from tests.llm.sql import same_as_sql

SCHEMA = "conv_id long, turn long, role string, text string, pos int, message string, kind double"
TEXTS = ["ok.", "ok", "Is it?", " \t\n", "", "one. two", "x!  \n", "### user: a</turn>\n", "\\", "\\</", "####", ":\\ : ", "é😀\u3000.", None]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "a: b\\:", "##</turn>"]


def odd_turns(n: int = 60, seed: int = 3):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(0, 12)):
            at = rng.choice([turn, turn, turn, None, turn - 1, turn + 3])
            rows.append((conv, at, rng.choice(ROLES), rng.choice(TEXTS)))
    rows += rows[:5] + [(1000, 0, "user", "long " * 20000 + "end."), (1000, 1, "assistant", "y" * 50000), (1001, None, None, None)]
    return [(*r, 1, "clash", 0.5) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_turns(), SCHEMA)


# ---- repair ----------------------------------------------------------------------------------------

def grammar(edits: str, row: str) -> tuple[int, str] | None:
    """Cost and role initials of a sequence of edits, every role tried where an edit may choose one."""
    def ways(i, k, cost, roles):
        if k == len(edits):
            if i == len(row) and re.fullmatch(r"(s?(ua)+)?", roles):
                yield cost
            return
        e = edits[k]
        if e == "I":
            for r in "ua":
                yield from ways(i, k + 1, cost + 5, roles + r)
        elif i < len(row):
            extra = 5 if row[i].isupper() else 0
            if e == "D":
                yield from ways(i + 1, k + 1, cost + 2, roles)
            elif row[i] != "x" and e == "K":
                yield from ways(i + 1, k + 1, cost + extra, roles + row[i].lower())
            elif row[i] != "x" and e == "R":
                for r in "ua":
                    yield from ways(i + 1, k + 1, cost + 1 + extra, roles + r)
    return min(ways(0, 0, 0, ""), default=None)


def every_audit(n: int):
    for edits in itertools.product("DKR", repeat=n):
        for inserts in range(3):
            for at in itertools.combinations_with_replacement(range(n + 1), inserts):
                out = []
                for i in range(n + 1):
                    out += ["I"] * at.count(i)
                    out += edits[i:i + 1]
                yield "".join(out)


def test_search_against_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        row = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 5)))
        want = min((cost, a) for a in every_audit(len(row)) if (cost := grammar(a, row)) is not None)
        assert repair.search(row, repair.START, repair.ENDS)[:2] == want, row


def dynamic(row: str, enter: int, leave) -> tuple[int, str] | None:
    """Cheapest and then ASCII-least edits by a table over rows and states."""
    def inserted(states):
        for _ in range(3):
            for s, (c, e) in list(states.items()):
                to, way = repair.DUE[s], (c + 5, e + "I")
                if to not in states or way < states[to]:
                    states[to] = way
        return states
    states = inserted({enter: (0, "")})
    for x in row:
        new, extra = {}, 5 if x.isupper() else 0
        for s, (c, e) in states.items():
            steps = [(s, c + 2, "D")]
            if x != "x":
                steps.append((repair.DUE[s], c + 1 + extra, "R"))
                if x.lower() in repair.NEXT[s]:
                    steps.append((repair.NEXT[s][x.lower()], c + extra, "K"))
            for to, cost, edit in steps:
                if to not in new or (cost, e + edit) < new[to]:
                    new[to] = cost, e + edit
        states = inserted(new)
    return min((states[s] for s in leave if s in states), default=None)


def test_search_of_long_runs_and_joined_tables():
    rng = random.Random(6)
    for _ in range(40):
        row = "".join(rng.choice("uauauaxsoSUA") for _ in range(rng.randint(0, repair.RUN)))
        for enter in range(4):
            for leave in [repair.ENDS, *[frozenset((b,)) for b in range(4)]]:
                got = repair.search(row, enter, leave)
                assert (got and got[:2]) == dynamic(row, enter, leave), (row, enter, leave)
    for n in (0, 1, 63, 64, 65, 400):
        row = "".join(rng.choice("uaxsoSUA") for _ in range(n))
        runs = repair.Runs()
        for at in range(0, n, 16):
            runs.add(repair.table(row[at:at + 16], repair.ALL, repair.ALL, False))
        ends = [w for (a, b), w in runs.result().items() if a == repair.START and b in repair.ENDS]
        assert min(ends, default=(0, "")) == dynamic(row, repair.START, repair.ENDS)


def brute_repair(rows):
    """The report and the repaired turns of one conversation; rows: turn, role, text after damage."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    rows = sorted(rows, key=key)
    seen, row, count = set(), "", defaultdict(int)
    for _, role, text in rows:
        ended = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else ""
        seen.add((role, text))
        count[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        row += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = dynamic(row, repair.START, repair.ENDS)
    lines, state, at = [], repair.START, 0
    for e in audit:
        if e in "IR":
            state = repair.DUE[state]
            lines.append(f"{repair.ROLE[state]}:{rows[at][2] if e == 'R' else ''}")
        elif e == "K":
            state = repair.NEXT[state][rows[at][1][:1]]
            lines.append(f"{rows[at][1]}:{rows[at][2]}")
        at += e != "I"
    text = "\n".join(lines)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest()), lines


def harm(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        out[conv] += []
        word = lambda v: " " if v is None else str(v)
        how = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", word(text)) if how == 2 else word(text)
        out[conv] += [(turn, "user" if how == 4 else word(role), text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def report(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_repair_odd_rows(spark):
    turns = odd(spark)
    want = {conv: brute_repair(rows)[0] for conv, rows in harm(odd_turns()).items()}
    assert report(repair.repair(repair.damaged(turns), turns)) == want
    assert report(repair.repair(repair.damaged(turns.repartition(13)), turns)) == want


def test_repair_of_one_hot_conversation(spark):
    rng = random.Random(9)
    rows = [(7, t // 2, rng.choice(["user", "assistant", "user", "assistant", "system", "x"]), f"{rng.randint(0, 2000)}{rng.choice('..?a ')}") for t in range(4000)]
    rows += [(8, 0, "user", "a."), (8, 1, "assistant", "b."), (6, 0, "system", "c.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = report(repair.repair(df))
        turns = repair.repaired_turns(df).orderBy("conv_id", "position").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = defaultdict(list)
    for conv, *r in rows:
        by[conv].append(tuple(r))
    for conv, some in by.items():
        want, lines = brute_repair(some)
        assert got[conv] == want
        assert [f"{t.role}:{t.text}" for t in turns if t.conv_id == conv] == lines


def test_repair_of_nothing(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(turns), turns).count() == 0
    one = spark.createDataFrame([(5, 0, "user", "a.", 1, "", 0.5)], SCHEMA)
    got = report(repair.repair(one.filter("false"), one))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_query(spark, sf):
    same_as_sql(spark, sf, "op11_conversation_repair")


def test_repair_sql_of_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql(spark, str(tmp_path), "op11_conversation_repair", glob=True)


# ---- chat ------------------------------------------------------------------------------------------

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def replay(events):
    """Messages of a log, event by event."""
    out = {}
    for conv, own in itertools.groupby(sorted(set(events), key=lambda e: (e[0], e[1], e[2], e[3], e[5] or "")), key=lambda e: e[0]):
        live = {}
        for _, _, m, kind, role, text in own:
            if kind == "open":
                live[m] = [role or "", ""]
            elif kind == "regenerate":
                for later in [k for k in live if k > m]:
                    del live[later]
            if m in live:
                if kind == "delta":
                    live[m][1] += text or ""
                elif kind == "edit":
                    live[m][1] = text or ""
                elif kind == "regenerate":
                    live[m][1] = ""
        out[conv] = {m: tuple(v) for m, v in live.items()}
    return out


def test_fold_of_random_logs(spark):
    rng = random.Random(4)
    events = []
    for conv in range(80):
        opened = set()
        for seq in range(rng.randint(0, 25)):
            m = rng.randint(1, 5)
            kind = rng.choice(["open", "delta", "delta", "edit", "regenerate"]) if m in opened else "open"
            if kind == "regenerate":
                opened = {k for k in opened if k <= m}
            opened.add(m)
            role = rng.choice(["user", "assistant", None]) if kind == "open" else None
            events.append((conv, seq, m, kind, role, rng.choice(["a", "bc", None, " "]) if kind in ("delta", "edit") else None))
    log = events + rng.sample(events, 200)
    rng.shuffle(log)
    got = defaultdict(dict)
    for r in chat.fold_events(spark.createDataFrame(log, LOG)).collect():
        got[r.conv_id][r.message] = (r.role, r.text)
    want = {c: ms for c, ms in replay(events).items() if ms}
    assert dict(got) == want


def test_edits_of_a_log(spark):
    log = [
        (1, 1, 1, "open", "user", None), (1, 2, 1, "delta", None, "hi"), (1, 3, 2, "open", "assistant", None),
        (1, 4, 2, "delta", None, "draft"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "hello"),
        (1, 7, 2, "delta", None, "late"), (1, 8, 3, "open", "assistant", None), (1, 9, 3, "edit", None, "x"),
        (1, 10, 3, "delta", None, "y"), (None, 1, 1, "open", None, None), (2, 1, 1, "delta", None, "never opened"),
    ]
    rows = chat.fold_events(spark.createDataFrame(log, LOG)).collect()
    assert {(r.conv_id, r.message, r.role, r.text) for r in rows} == {(1, 1, "user", "hello"), (1, 3, "assistant", "xy"), (None, 1, "", "")}


def test_template_and_mask(spark):
    rng = random.Random(8)
    rows = [(c, m, rng.choice([r for r in ROLES if r is not None]), rng.choice([t for t in TEXTS if t is not None])) for c in range(50) for m in range(9)]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, message long, role string, text string"))
    read = out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.learnt(F.col("formatted"), F.col("loss")).alias("learnt"))
    for r in read.collect():
        want = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want
        assert r.learnt == "".join(text for role, text in want if role == "assistant")
        assert r.formatted.count("</turn>") == 9 and r.formatted.count("### ") == 9
        held = r.formatted.encode()
        for (at, size), (_, text) in zip(r.loss, [t for t in want if t[0] == "assistant"]):
            assert re.sub(r"(?s)\\(.?)", r"\1", held[at:at + size].decode()) == text


def test_log_of_turns_ends_in_them(spark):
    log = chat.turns_as_log(odd(spark).select("conv_id", "turn", "role", "text"))
    assert log.groupBy("kind").count().count() == 4
    got = defaultdict(list)
    for r in chat.fold_events(log).orderBy("message").collect():
        got[r.conv_id].append((r.role, r.text))
    want = defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    for r in sorted(odd_turns(), key=key):
        want[r[0]].append((r[2] or "", r[3] or ""))
    assert got == want


def test_chat_query(spark, sf):
    df = queries.op12_chat_format(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    same_as_sql(spark, sf, "op12_chat_format")


def test_chat_query_of_odd_rows(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql(spark, str(tmp_path), "op12_chat_format", glob=True)


def test_chat_query_of_an_empty_table(spark, tmp_path):
    odd(spark).filter("false").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op12_chat_format(spark, str(tmp_path)).collect()] == [-7]


@pytest.mark.parametrize("text", ["", "a", "123:4", "-7:0", " :12"])
def test_crc_of_the_sql(text):
    import duckdb
    assert duckdb.sql(f"SELECT {oracles.crc32('s')} FROM (VALUES ('{text}')) t(s)").fetchall()[0][0] == zlib.crc32(text.encode())
