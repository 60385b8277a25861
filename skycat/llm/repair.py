"""Operator 11: repair of conversation structure by generalised LR parsing with edits.

The roles of a conversation should follow the grammar

    Conversation -> | Turns | s Turns
    Turns -> Turns Pair | Pair
    Pair -> u a

(s, u, a: the initials of system, user, assistant).  A row may be kept (0), its role
changed to user or assistant (2) or deleted (3, the only way for blank and duplicate
rows); an empty-text row of user or assistant may be inserted anywhere (2); a truncated
row that stays costs 1 more.  The repair is the cheapest list of edits, of equal ones the
one whose initials (``audit``: K, R, D, I) come first in ASCII.

The LR(0) automaton of the grammar is built from its productions.  Edits make the parse
ambiguous, so the stacks of all of them live in one graph: a stack is a state above an
interned stack, stacks with equal tops share what lies below, and of two ways to the same
stack the smaller (cost, audit) stays.  That is exact: two audits that have consumed the
same rows differ before either ends (every row writes one letter that is no I, and after a
row's letter nothing is open), so what follows cannot change their order.

Left recursion keeps the stacks at most four deep, so a conversation of any length is
parsed row by row in constant memory but for its audit, which is a result.  Each live
stack carries its own SHA-256 of the repaired text, brought up to date whenever
``HELD`` characters of text wait; as a digest runs over a conversation's rows in order,
one task reads one conversation, as a stream.

Spark: rows are dealt by conv_id once.  Equal (role, text) are numbered by a window that
the same dealing serves, so no task holds the texts it has seen; both sorts spill.

Defined cases: null conv_id (a conversation), null turn (first; not counted in gaps),
null role or text (one space), an empty role (a role of no initial, like any that is not
s, u or a: Reroled or Deleted), rows of equal turn (ordered by role, then text), repeated
rows (rows of their own; the second is a duplicate), a conversation without rows after
the damage (zeros and the digest of no text), empty tables, extra columns (ignored).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import WORD, table

#: Grammar over role initials; the first symbol's productions end the parse.
GRAMMAR = (("Conversation", ()), ("Conversation", ("Turns",)), ("Conversation", ("s", "Turns")), ("Turns", ("Turns", "Pair")), ("Turns", ("Pair",)), ("Pair", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
RECAST, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Characters of text that wait for the digests of the live stacks.
HELD = 1 << 20
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT = range(4)


class Automaton:
    """LR(0) states of a grammar, and the interned stacks over them.

    A stack is a number; ``after[stack][symbol]`` is the stack after a shift and all
    reductions that follow, ``accepts[stack]`` says whether the input may end there.
    """

    def __init__(self, grammar=GRAMMAR):
        self.grammar = grammar
        self.heads = {head for head, _ in grammar}
        self.goal = grammar[0][0]
        self.states: list[frozenset] = []
        start = self._closure({(r, 0) for r, (head, _) in enumerate(grammar) if head == self.goal})
        # a stack: (state, stack below)
        self.stacks: list[tuple[frozenset, int]] = [(start, -1)]
        self.symbols = sorted({x for _, body in grammar for x in body} - self.heads)
        self.after: list[dict[str, int]] = []
        self.accepts: list[bool] = []
        i = 0
        while i < len(self.stacks):  # a left-recursive grammar has finitely many stacks between two symbols
            self.after.append({x: n for x in self.symbols if (n := self._shifted(i, x)) is not None})
            self.accepts.append(any(grammar[r][0] == self.goal and dot == len(grammar[r][1]) for r, dot in self.stacks[i][0]))
            i += 1

    def _closure(self, items: set) -> frozenset:
        items, open_ = set(items), list(items)
        while open_:
            r, dot = open_.pop()
            body = self.grammar[r][1]
            for n, (head, _) in enumerate(self.grammar):
                if dot < len(body) and head == body[dot] and (n, 0) not in items:
                    items.add((n, 0))
                    open_.append((n, 0))
        return frozenset(items)

    def _goto(self, state: frozenset, symbol: str) -> frozenset | None:
        moved = {(r, dot + 1) for r, dot in state if self.grammar[r][1][dot : dot + 1] == (symbol,)}
        return self._closure(moved) if moved else None

    def _interned(self, state: frozenset, below: int) -> int:
        if (state, below) not in self.stacks:
            self.stacks.append((state, below))
        return self.stacks.index((state, below))

    def _shifted(self, stack: int, symbol: str) -> int | None:
        state = self._goto(self.stacks[stack][0], symbol)
        if state is None:
            return None
        top = self._interned(state, stack)
        while True:
            done = [r for r, dot in self.stacks[top][0] if dot == len(self.grammar[r][1]) and self.grammar[r][0] != self.goal]
            if not done:
                return top
            (rule,) = done  # the grammar has no reduce-reduce conflict
            head, body = self.grammar[rule]
            for _ in body:
                top = self.stacks[top][1]
            top = self._interned(self._goto(self.stacks[top][0], head), top)


AUTOMATON = Automaton()


class Repair:
    """The graph of one conversation's live stacks: stack -> (cost, rank, audit since the last digest).

    ``rank`` orders the audits up to the last digest; ``past`` holds them and their digests.
    """

    def __init__(self):
        self.live: dict[int, tuple[int, int, str]] = {0: (0, 0, "")}
        self.past: list[tuple[str, object, str]] = [("", hashlib.sha256(), "")]  # audit, digest, initials that the stack below it has read
        self.start: dict[int, int] = {0: 0}  # rank -> stack at the last digest
        self.held: list[tuple[str, str]] = []
        self.waiting = 0

    def _inserted(self) -> dict[int, tuple[int, int, str]]:
        """The live stacks and those that inserts reach from them, each by its smallest way."""
        best = dict(self.live)
        open_ = list(best)
        while open_:
            stack = open_.pop(0)
            cost, rank, audit = best[stack]
            for symbol in ROLES:
                to = AUTOMATON.after[stack].get(symbol)
                way = (cost + INSERT, rank, audit + "I")
                if to is not None and (to not in best or way < best[to]):
                    best[to] = way
                    open_.append(to)
        return best

    def row(self, role: str, text: str, fault: int) -> None:
        own = role[:1]
        extra = TRUNCATED if fault == CUT else 0
        new: dict[int, tuple[int, int, str]] = {}
        for stack, (cost, rank, audit) in self._inserted().items():
            ways = [(stack, (cost + DELETE, rank, audit + "D"))]
            if fault in (SOUND, CUT):
                after = AUTOMATON.after[stack]
                if own in after:
                    ways.append((after[own], (cost + extra, rank, audit + "K")))
                ways += [(after[x], (cost + extra + RECAST, rank, audit + "R")) for x in ROLES if x in after and x != own]
            for to, way in ways:
                if to not in new or way < new[to]:
                    new[to] = way
        self.live = new
        self.held.append((role, text))
        self.waiting += len(text) + len(role)
        if self.waiting >= HELD:
            self._digested()

    def _advanced(self, stack: int, audit: str, digest, none_yet: bool):
        """The digest after the edits of ``audit``, from ``stack`` on; and whether still no row was written."""
        digest = digest.copy()
        rows = iter(self.held)
        for letter in audit:
            role, text = next(rows) if letter != "I" else ("", "")
            if letter == "D":
                continue
            after = AUTOMATON.after[stack]
            if letter == "K":
                symbol = role[:1]
            else:  # the grammar leaves one of user and assistant
                symbol = next(x for x in ROLES if x in after)
                role = ROLES[symbol]
            digest.update((("" if none_yet else "\n") + role + ":" + text).encode())
            none_yet = False
            stack = after[symbol]
        return digest, none_yet

    def _digested(self) -> None:
        """Bring the digests of all live stacks up to date; audits are ranked anew."""
        order = sorted(self.live.items(), key=lambda s: s[1][1:])
        past, start, live = [], {}, {}
        for n, (stack, (cost, rank, audit)) in enumerate(order):
            before, digest, none_yet = self.past[rank]
            digest, none_yet = self._advanced(self.start[rank], audit, digest, none_yet == "")
            past.append((before + audit, digest, "" if none_yet else "x"))
            start[n] = stack
            live[stack] = (cost, n, "")
        self.past, self.start, self.live, self.held, self.waiting = past, start, live, [], 0

    def best(self) -> tuple[int, str, str]:
        """(cost, audit, sha256 of the repaired rows) of the smallest way to a whole conversation."""
        ends = {s: way for s, way in self._inserted().items() if AUTOMATON.accepts[s]}
        cost, rank, audit = min(ends.values())
        before, digest, none_yet = self.past[rank]
        return cost, before + audit, self._advanced(self.start[rank], audit, digest, none_yet == "")[0].hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; ``gone`` marks rows that it drops, whose text is not kept."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    d = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    d = d.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") != 0, text).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return d.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _fault(nth: Column) -> Column:
    """Fault of a row, numbered ``nth`` among the conversation's rows of its role and text."""
    inked, whole = F.col("text").rlike(WORD), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~inked, F.lit(BLANK)).when(nth > 1, F.lit(DUPLICATE)).when(~whole, F.lit(CUT)).otherwise(F.lit(SOUND))
    return fault.cast("tinyint")


class _Conversation:
    """Counts and repair of one conversation, row by row in order."""

    def __init__(self, key):
        self.key, self.repair = key, Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.distinct = 0
        self.initial = self.low = self.high = None

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            if turn != self.high:
                self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        cost, audit, digest = self.repair.best()
        return self.key, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, cost, audit, digest


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by conversation and turn, as a stream; a conversation may run over batches."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    now: _Conversation | None = None
    kind = None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        kind = batch.schema.field(0).type
        done = []
        keys, turns, roles, gone, faults = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
        texts = batch.column(3)
        for i, key in enumerate(keys):
            if now is None or key != now.key:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(key)
            if not gone[i]:
                now.row(turns[i], roles[i], texts[i].as_py(), faults[i])
        if done:
            yield rows(done)
    if now is not None:
        yield rows([now.result()])


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: what is wrong with its rows, the cheapest edits and the digest of the result.

    ``conversations``: conv_id, turn, role, text, and, if there, ``gone`` (rows that are no longer there).
    """
    ship_package(conversations.sparkSession)
    rows = conversations if "gone" in conversations.columns else conversations.withColumn("gone", F.lit(False))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], "gone")
    dealt = rows.repartition("conv_id")
    # the windows and the sort below are served by the same dealing
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    judged = dealt.withColumn("fault", _fault(F.row_number().over(same)))
    ordered = judged.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(
        _repaired,
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )


def op11_lr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
