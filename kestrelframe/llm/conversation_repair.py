"""Cheapest repair of a conversation's role structure, by a lazily determinised weighted automaton.

Rows are kept, re-roled or deleted and turns inserted so that the role initials read
``(s?(ua)+)?``. The four states of that pattern and the edits' costs make a weighted
automaton over *symbols* (a row's role initial, whether its text is cut off, whether
it must go). It is determinised as rows call for it: the vector of cheapest costs of
the four states, less its minimum, is one state of the deterministic automaton, and
``(state, symbol) -> (state, growth of the minimum)`` is kept in a table
(:class:`Repairer`). The vectors are few (entries that no cheapest path can use
are left out), so almost every row is one table look-up. The scan gives the cost; a
trace back along *tight* arcs (those that lie on a cheapest path) gives the set of
states from which a cheapest repair can be finished, and a walk forward through it
takes the least letter each time, which is the ASCII-least audit. Both are tables too.

Plan: damage, faults and symbols are column expressions; earlier copies of a row are
found by a grouped minimum over ``(conversation, role, digest of the text)``. Narrow
rows (no text) are dealt by conversation, sorted and streamed through the automaton,
which holds a byte or two for each row of one conversation. Texts are shuffled once,
sorted behind their conversation's audit, and streamed into its SHA-256. That digest
is one sequential hash by definition, so a conversation, however long, is read by one
task; it is never held there: memory is its audit and a batch of rows.

Edge cases: null conversation, turn, role and text read as one space (a null
conversation is one of its own; null turns come first and count for no gap). Rows of
one turn are taken by role, then by the digest of their text, so any order of the
input gives the same result. Equal rows are copies: all but the first must go. A role
of another initial, or an empty one, can only be re-roled or deleted. A conversation
whose rows are all dropped has zeros, an empty audit and the digest of nothing. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialise, table

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
_SPACES = " \t\n\x0b\x0c\r"
_INF = 1 << 40
# states of the pattern: nothing yet, after a system turn, after a user, after an assistant
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: The state after a turn that is inserted or re-roled; there is one choice in each state.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_DONE = (_START, _ASSISTANT)
#: Symbols: 8 for a row that must go, else the role's place in ``sua`` (3: another), plus 4 if the text is cut off; 9 for a row that was dropped.
MUST_GO, DROPPED = 8, 9


def _arcs(q: int, symbol: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits that consume a row in state ``q``."""
    out = [("D", DELETE, q)]
    if symbol < MUST_GO:
        extra, initial = CUT_OFF * (symbol >= 4), symbol % 4
        if initial == 0 and q == _START:
            out.append(("K", KEEP + extra, _SYSTEM))
        if initial in (1, 2) and _NEXT[q] == initial + 1:
            out.append(("K", KEEP + extra, _NEXT[q]))
        out.append(("R", REROLE + extra, _NEXT[q]))
    return out


def _settled(costs: list[int]) -> tuple[int, ...]:
    """The costs of the four states when turns may be inserted.

    After an assistant all can follow that can follow a system turn, and all that can
    follow nothing but a kept system turn, which may be deleted instead. States that
    are dearer than that lie on no cheapest path; without them the vectors are finite
    in number.
    """
    for _ in range(2):
        for q in range(4):
            costs[_NEXT[q]] = min(costs[_NEXT[q]], costs[q] + INSERT)
    if costs[_SYSTEM] > costs[_ASSISTANT]:
        costs[_SYSTEM] = _INF
    if costs[_START] > costs[_ASSISTANT] + DELETE:
        costs[_START] = _INF
    return tuple(costs)


class Repairer:
    """The deterministic automaton so far: state 0 is the start."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.step: dict[tuple[int, int], tuple[int, int]] = {}
        self.back: dict[tuple[int, int, int], int] = {}
        self.walk: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        self._named(_settled([0, _INF, _INF, _INF]))

    def _named(self, costs: tuple[int, ...]) -> tuple[int, int]:
        low = min(costs)
        vector = tuple(c - low if c < _INF else _INF for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], low

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        costs = [_INF] * 4
        for q, at in enumerate(self.vectors[state]):
            for _, cost, to in _arcs(q, symbol):
                costs[to] = min(costs[to], at + cost)
        return self._named(_settled(costs))

    def _closed(self, state: int, mask: int) -> int:
        """``mask`` and the states that reach it by tight insertions."""
        v = self.vectors[state]
        for _ in range(4):
            for q in range(4):
                if mask >> _NEXT[q] & 1 and v[q] < _INF and v[q] + INSERT == v[_NEXT[q]]:
                    mask |= 1 << q
        return mask

    def _tight(self, state: int, symbol: int, q: int) -> list[tuple[str, int]]:
        to, grown = self.step[state, symbol]
        v, w = self.vectors[state], self.vectors[to]
        return [(letter, p) for letter, cost, p in _arcs(q, symbol) if v[q] < _INF and v[q] + cost == w[p] + grown]

    def _back(self, state: int, symbol: int, mask: int) -> int:
        """The states before a row from which its tight arcs lead into ``mask``."""
        return self._closed(state, sum(1 << q for q in range(4) if any(mask >> p & 1 for _, p in self._tight(state, symbol, q))))

    def _walk(self, state: int, symbol: int, here: int, mask: int, q: int) -> tuple[str, int]:
        """Letters up to and with the edit of a row, the least ones, and the state after it."""
        letters = ""
        while True:
            options = [(letter, p) for letter, p in self._tight(state, symbol, q) if mask >> p & 1]
            v = self.vectors[state]
            if here >> _NEXT[q] & 1 and v[q] + INSERT == v[_NEXT[q]]:
                options.append(("I", _NEXT[q]))
            letter, q = min(options)
            letters += letter
            if letter != "I":
                return letters, q

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Cost and audit of the cheapest repair, ties ASCII-least."""
        state, total, path, step = 0, 0, [0], self.step
        for s in symbols:
            found = step.get((state, s))
            if found is None:
                found = step[state, s] = self._step(state, s)
            state, grown = found
            total += grown
            path.append(state)
        v = self.vectors[state]
        best = min(v[q] for q in _DONE)
        mask = self._closed(state, sum(1 << q for q in _DONE if v[q] == best))
        masks = [mask]
        for k in range(len(symbols) - 1, -1, -1):
            key = (path[k], symbols[k], mask)
            mask = self.back.get(key, -1)
            if mask < 0:
                mask = self.back[key] = self._back(*key)
            masks.append(mask)
        masks.reverse()
        q, out = _START, []
        for k, s in enumerate(symbols):
            arc = (path[k], s, masks[k], masks[k + 1], q)
            found = self.walk.get(arc)
            if found is None:
                found = self.walk[arc] = self._walk(*arc)
            letters, q = found
            out.append(letters)
        while not (q in _DONE and v[q] == best):
            out.append("I")
            q = _NEXT[q]
        return total + best, "".join(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped)`` after the damage that the CRC-32 of ``conv_id:turn`` chooses."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "dropped", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def marked(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, first, symbol, fault)`` of :func:`damaged` rows: no texts.

    ``fault`` is 1 for a blank and 3 for a truncated text, copies apart; ``first``
    tells whether no row of an earlier turn has the same role and text.
    """
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    fault = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    narrow = rows.select("conv_id", "turn", "role", "dropped", _digest(F.col("text")).alias("digest"), fault.alias("fault"), initial.alias("initial"))
    narrow = materialise(narrow, "turns")
    # null turns stand before all others
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = narrow.where("NOT dropped").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(order).alias("from"), F.count("*").alias("n")).where("n > 1")
    met = narrow.join(seen, narrow["conv_id"].eqNullSafe(seen["c"]) & (narrow["role"] == seen["r"]) & (narrow["digest"] == seen["d"]), "left")
    first = F.coalesce(order == F.col("from"), F.lit(True))
    symbol = F.when(F.col("dropped"), DROPPED).when(F.col("fault") == 1, MUST_GO).otherwise(F.col("initial") + F.when(F.col("fault") == 3, 4).otherwise(0))
    return met.select("conv_id", "turn", "role", "digest", first.alias("first"), symbol.cast("int").alias("symbol"), F.col("fault").cast("int").alias("fault"))


class _Conversation:
    """What one conversation's sorted narrow rows add up to."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.symbols, self.counts = conv_id, bytearray(), [0, 0, 0, 0]
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0
        self.last = self.initial = None

    def add(self, turn: int | None, role: str, digest: bytes, first: bool, symbol: int, fault: int) -> None:
        if symbol == DROPPED:
            return
        same = self.last == (turn, role, digest)
        self.last = (turn, role, digest)
        if fault != 1 and (same or not first):
            fault, symbol = 2, MUST_GO
        self.counts[fault] += 1
        self.symbols.append(symbol)
        if turn is not None:
            self.turns += turn != self.high  # rows come by turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def row(self, repairer: Repairer) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.high is not None else 0
        cost, audit = repairer.repair(bytes(self.symbols))
        return (self.conv_id, gaps, self.counts[1], self.counts[2], self.counts[3], self.illegal, cost, audit)


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_AUDIT_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _written(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`marked` rows: counts, cost and audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, now, done = Repairer(), None, []
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row(repairer))
                    now = _Conversation(conv_id)
                now.add(*row)
            if len(done) >= 1024:
                yield _written(done, _AUDIT_ARROW)
                done = []
        if now is not None:
            yield _written([*done, now.row(repairer)], _AUDIT_ARROW)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("conv_id", "turn", "role", "digest", "first", "symbol", "fault").mapInArrow(run, _AUDIT)


def _edits(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of the repaired turns."""
    q = _START
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "K":
            q = _SYSTEM if role[:1] == "s" else _NEXT[q]
        else:
            q = _NEXT[q]
            role = _ROLE[q]
        yield f"{role}:{text}"


def repaired(rows: DataFrame, audit: DataFrame, make: Callable[[Iterator[str]], object], kind: str) -> DataFrame:
    """``audit`` with a column ``repaired`` (of a type ``kind``), which ``make`` gets from each conversation's repaired turns."""
    end = pa.schema([*_AUDIT_ARROW, ("repaired", pa.string() if kind == "string" else pa.list_(pa.string()))])
    names = [f.name for f in _AUDIT_ARROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        head = next(stream, None)
        done = []
        while head is not None:
            base, after = head[: len(names)], None

            def turns() -> Iterator[tuple[str, str]]:
                nonlocal after
                for row in stream:
                    if row[-3]:
                        after = row
                        return
                    yield row[-2], row[-1]

            mine = turns()
            made = make(_edits(base[-1], mine))
            for _ in mine:  # nothing is left but after an audit without rows
                pass
            done.append((*base, made))
            head = after
            if len(done) >= 1024:
                yield _written(done, end)
                done = []
        if done:
            yield _written(done, end)

    nothing = lambda t: F.lit(None).cast(t)
    heads = audit.select(*names, F.lit(True).alias("head"), nothing("string").alias("role"), nothing("string").alias("text"), nothing("long").alias("turn"), nothing("binary").alias("digest"))
    numbers = [nothing("string" if n == "audit" else "long").alias(n) for n in names[1:]]
    bodies = rows.where("NOT dropped").select("conv_id", *numbers, F.lit(False).alias("head"), "role", "text", "turn", _digest(F.col("text")).alias("digest"))
    dealt = heads.unionByName(bodies).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select(*names, "head", "role", "text").mapInArrow(run, f"{_AUDIT}, repaired {kind}")


def _sha(turns: Iterator[str]) -> str:
    out = hashlib.sha256()
    for k, turn in enumerate(turns):
        out.update(("\n" * (k > 0) + turn).encode())
    return out.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and the list of repaired turns (``role:text``) of every conversation of :func:`damaged` rows."""
    return repaired(rows, materialise(audits(marked(rows)), "audits"), list, "array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op11_conversation_repair``: every conversation's faults, cheapest repair and the digest of what it leaves."""
    rows = damaged(table(spark, sf_dir, "conversations"))
    audit = materialise(audits(marked(rows)), "audits")
    return repaired(rows, audit, _sha, "string").withColumnRenamed("repaired", "repaired_sha256")
