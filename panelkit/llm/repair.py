"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``.

Each row's first fault is blank, duplicate (role and text seen earlier) or truncated (the last
character that is no white space ends no sentence). Rows are kept, given the role that is due, or deleted, and
turns with an empty text inserted; blank and duplicate rows must go, truncated ones may stay at a price.

The search is iterative-deepening A*: depth first in ASCII order of the edits D, I, K, R under a
growing bound of cost, where a table of failed states keeps the least budget each is known to need.
The first path within a bound is the answer, and so the ASCII-least of the cheapest.

Long conversations don't meet in one search. Rows are dealt by range of one total order, so a hot
conversation lies in many tasks. Each searches runs of ``RUN`` rows from every state the run can be
entered in to every state it can be left in; of two neighbouring runs the cheapest edits (ties: the
ASCII-least) for each pair of states are those of the best state between them. Two different
answers for one pair of states and rows at one cost are never each other's beginnings, so the ASCII-least
of joined edits joins the ASCII-least of each part. What meets for a conversation is one row per task.
Only the digest of a repaired conversation reads its rows in order in one task, one row at a time.

Nulls count as one space. Rows of one turn are ordered by role and text, null turns come first, a null
conversation is one of its own. A conversation without rows after damage has zeros, no edits and the
digest of nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import parts, slices
from panelkit.sources.io import materialize

SPACE = " \t\n\x0b\x0c\r"
RUN = 64
#: Remembered searches of a worker; a run is at most RUN letters.
REMEMBERED = 20_000
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The state after the turn that may be inserted, or that a row may be given the role of.
DUE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LATER = ({START, SYSTEM, USER, ASSISTANT}, {SYSTEM, USER, ASSISTANT}, {USER, ASSISTANT}, {USER, ASSISTANT})
ENDS = frozenset((START, ASSISTANT))
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 60

COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")
PART = (
    "conv_id long, pos long, " + ", ".join(f"{c} long" for c in COUNTS) + ", first_turn long, last_turn long, "
    "first_letter string, last_letter string, enter array<int>, leave array<int>, cost array<long>, edits array<string>"
)
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
TURNS = "conv_id long, position long, edit string, role string, text string"


# ---- the search ------------------------------------------------------------------------------------

def search(row: str, enter: int, leave: frozenset) -> tuple[int, str, int] | None:
    """Cost, edits and last state of the cheapest way through a run of rows, or None.

    ``row`` has a letter per row: x must go, s u a o are initials (o: any other), capitals are truncated."""
    n = len(row)
    rest = [0] * (n + 1)  # what cannot be avoided: x and truncated rows cost a deletion at least
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE if row[i] == "x" or row[i].isupper() else 0)
    need: dict[tuple[int, int], int] = {}
    last = enter

    def walk(i: int, state: int, left: int) -> tuple[str | None, int]:
        """The edits from here within the budget, or the least budget that may do."""
        nonlocal last
        low = need.get((i, state), rest[i])
        if low > left:
            return None, low
        if i == n and state in leave:
            last = state
            return "", 0
        if not LATER[state] & leave:
            return None, NEVER
        best = NEVER
        for edit, cost, j, to in moves(i, state):
            if cost > left:
                best = min(best, cost + need.get((j, to), rest[j]))
                continue
            path, low = walk(j, to, left - cost)
            if path is not None:
                return edit + path, 0
            best = min(best, cost + low)
        need[i, state] = best
        return None, best

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, DUE[state]
        if i < n and row[i] != "x":
            extra = TRUNCATED if row[i].isupper() else 0
            to = NEXT[state].get(row[i].lower())
            if to is not None:
                yield "K", KEEP + extra, i + 1, to
            yield "R", REROLE + extra, i + 1, DUE[state]

    bound = rest[0]
    while bound < NEVER:
        path, low = walk(0, enter, bound)
        if path is not None:
            return bound, path, last
        bound = low
    return None


_remembered: dict = {}


def table(row: str, enters: frozenset, leaves: frozenset, whole: bool) -> dict:
    """(enter, leave) -> (cost, edits) of a run; a run that ends its conversation needs only the better end."""
    key = row, enters, leaves, whole
    found = _remembered.get(key)
    if found is None:
        found = {}
        for a in enters:
            for goal in [leaves] if whole else [frozenset((b,)) for b in leaves]:
                way = search(row, a, goal)
                if way:
                    found[a, way[2]] = way[:2]
        if len(_remembered) >= REMEMBERED:
            _remembered.clear()
        _remembered[key] = found
    return found


def joined(a: dict, b: dict) -> dict:
    """The table of two neighbouring runs."""
    out: dict = {}
    for (enter, mid), (cost, edits) in a.items():
        for (start, leave), (more, rest) in b.items():
            if start == mid:
                way = cost + more, edits + rest
                if (enter, leave) not in out or way < out[enter, leave]:
                    out[enter, leave] = way
    return out


class Runs:
    """Tables of a conversation's runs, joined like the digits of a binary counter, so that edits are copied
    log times only."""

    def __init__(self):
        self.held: list[tuple[int, dict]] = []

    def add(self, made: dict) -> None:
        rank = 0
        while self.held and self.held[-1][0] == rank:
            made, rank = joined(self.held.pop()[1], made), rank + 1
        self.held.append((rank, made))

    def result(self) -> dict:
        out = None
        for _, made in reversed(self.held):
            out = made if out is None else joined(made, out)
        return out or {}


ALL = frozenset(range(4))


class Part:
    """What one task knows of a conversation."""

    def __init__(self, conv, pos, known_start: bool):
        self.conv, self.pos, self.known_start = conv, pos, known_start
        self.n = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.first = self.last = None
        self.run: list[str] = []
        self.runs = Runs()

    def add(self, turn, letter: str, fault: str) -> None:
        self.n["rows"] += 1
        if fault:
            self.n[fault] += 1
        if self.last is None:
            self.first = letter
        elif self.last + letter not in LEGAL:
            self.n["illegal"] += 1
        self.last = letter
        if turn is not None:
            if turn != self.last_turn:
                self.n["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if len(self.run) == RUN:
            self.search(ALL, False)
        self.run.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)

    def search(self, leaves: frozenset, whole: bool) -> None:
        enters = frozenset((START,)) if self.known_start and not self.runs.held else ALL
        self.runs.add(table("".join(self.run), enters, leaves, whole and enters != ALL))
        self.run = []

    def row(self, known_end: bool) -> dict:
        self.search(ENDS if known_end else ALL, known_end)
        ways = sorted(self.runs.result().items())
        return {
            "conv_id": self.conv, "pos": self.pos, **self.n, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "first_letter": self.first, "last_letter": self.last,
            "enter": [k[0] for k, _ in ways], "leave": [k[1] for k, _ in ways],
            "cost": [w[0] for _, w in ways], "edits": [w[1] for _, w in ways],
        }


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def _batches(rows: Iterator[dict], schema: str, size: int = 1000) -> Iterator[pa.RecordBatch]:
    shape, some = _arrow(schema), []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.RecordBatch.from_pylist(some, shape)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, shape)


def _parts_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    part = None
    for batch in batches:
        for some in slices(batch, 2000):
            for r in some.to_pylist():
                if part is None or part.conv != r["conv_id"]:
                    if part:
                        yield part.row(True)
                    part = Part(r["conv_id"], r["pos"], part is not None)
                part.add(r["turn"], r["letter"], r["fault"])
    if part:
        yield part.row(False)


# ---- rows and faults -------------------------------------------------------------------------------

def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with their place in one total order, dealt by range and written once."""
    plain = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = plain.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("pos", F.monotonically_increasing_id()))


def faults(placed: DataFrame) -> DataFrame:
    """conv_id, turn, pos, letter (initial s, u, a or o for others) and first fault of every row.

    A row is no duplicate if its place is the first of its role and text in the conversation; the first
    places are a partial aggregate, joined by place, so no text repeated often meets in one task."""
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    ended = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    some = placed.select(
        "conv_id", "turn", "pos", F.sha2(said, 256).alias("said"), (ended == "").alias("blank"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("letter"),
        (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    firsts = some.groupBy("conv_id", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate")
        .when(F.col("cut"), "truncated").otherwise("")
    )
    return some.join(firsts, "pos", "left").select("conv_id", "turn", "pos", "letter", fault.alias("fault"))


# ---- one conversation at a time --------------------------------------------------------------------

class Conversation:
    """The parts of a conversation put together in order, then its rows with their edits."""

    def __init__(self, conv):
        self.conv, self.n = conv, dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.last = None
        self.runs = Runs()
        self.cost, self.edits, self.at, self.state, self.position = 0, None, 0, START, 0

    def add(self, p: dict) -> None:
        for c in COUNTS:
            self.n[c] += p[c]
        if self.last is not None and self.last + p["first_letter"] not in LEGAL:
            self.n["illegal"] += 1
        self.last = p["last_letter"]
        if p["first_turn"] is not None:
            if p["first_turn"] == self.last_turn:
                self.n["turns"] -= 1
            self.first_turn = p["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = p["last_turn"]
        self.runs.add(dict(zip(zip(p["enter"], p["leave"]), zip(p["cost"], p["edits"]))))

    def plan(self) -> None:
        if self.edits is None:
            ways = [w for (enter, leave), w in self.runs.result().items() if enter == START and leave in ENDS]
            self.cost, self.edits = min(ways, default=(0, ""))
            self.runs = Runs()

    def _turn(self, edit: str, to: int, role: str, text: str) -> dict:
        self.state, self.position = to, self.position + 1
        return {"conv_id": self.conv, "position": self.position - 1, "edit": edit, "role": role, "text": text}

    def inserted(self) -> Iterator[dict]:
        self.plan()
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            to = DUE[self.state]
            yield self._turn("I", to, ROLE[to], "")

    def repaired(self, role: str, text: str) -> Iterator[dict]:
        """The turns that a row becomes, with those inserted before it."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            yield self._turn(edit, NEXT[self.state][role[:1]], role, text)
        elif edit == "R":
            to = DUE[self.state]
            yield self._turn(edit, to, ROLE[to], text)

    def report(self, sha256: str) -> dict:
        self.plan()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.n["turns"]
        counts = {c: self.n[c] for c in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": self.conv, "gaps": gaps, **counts, "cost": self.cost, "audit": self.edits, "repaired_sha256": sha256}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, dict | None]]:
    """Each repaired turn of a task's conversations in order, and each conversation with None at its end."""
    now = None
    for batch in batches:
        for some in slices(batch):
            for r in some.to_pylist():
                if now is None or now.conv != r["conv_id"]:
                    if now:
                        yield from ((now, t) for t in now.inserted())
                        yield now, None
                    now = Conversation(r["conv_id"])
                if r["kind"] == 1:
                    now.add(r["part"])
                elif r["kind"] == 2:
                    yield from ((now, t) for t in now.repaired(r["role"], r["text"]))
    if now:
        yield from ((now, t) for t in now.inserted())
        yield now, None


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    digest, first = hashlib.sha256(), True
    for now, turn in _conversations(batches):
        if turn is None:
            yield now.report(digest.hexdigest())
            digest, first = hashlib.sha256(), True
        else:
            digest.update(("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
            first = False


def _streams(rows: DataFrame, of: DataFrame | None) -> DataFrame:
    """All that is known of each conversation, in the order in which a task needs it: its name, the parts
    of its search, its rows."""
    placed = ordered(rows)
    lettered = faults(placed).repartitionByRange(parts(rows.sparkSession), "pos").sortWithinPartitions("pos")
    found = lettered.mapInArrow(lambda batches: _batches(_parts_of_task(batches), PART), PART)
    names = (rows if of is None else of).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    none = F.lit(None)
    kind = lambda k: F.lit(k).alias("kind")
    part = F.struct(*[c.split(" ")[0] for c in PART.split(", ")]).alias("part")
    heads = names.select("conv_id", kind(0), F.lit(-1).cast("long").alias("pos"))
    searched = materialize(found).select("conv_id", kind(1), "pos", part)
    texts = placed.select("conv_id", kind(2), "pos", "role", "text")
    everything = heads.unionByName(searched, True).unionByName(texts, True)
    order = [F.col("conv_id").asc_nulls_first(), F.col("kind"), F.col("pos")]
    return everything.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


def repair(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``of`` (default: of the rows): faults, cost, edits and the digest of the repaired
    ``role:text`` lines."""
    return _streams(rows, of).mapInArrow(lambda batches: _batches(_reports(batches), REPORT), REPORT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position, edit, role, text."""
    def turns(batches):
        return _batches((t for _, t in _conversations(batches) if t is not None), TURNS)

    return _streams(rows, None).mapInArrow(turns, TURNS)


# ---- damage ----------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """Damage by the hash of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes its role user."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text, role = word("text"), word("role")
    harmed = F.when(how == 1, F.lit("")).when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.when(how == 3, 2).otherwise(1)
    return rows.filter(how != 0).select(
        "conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(role).alias("role"), harmed.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("_copy"),
    ).drop("_copy")
