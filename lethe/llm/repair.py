"""Conversation structure repair by generalised LR parsing.

The role grammar is compiled to its LR(0) automaton.  A conversation is read once by a
graph-structured stack: all stacks that any repair so far can have are kept at once,
stacks share their lower nodes, and equal stacks are merged to the one reached at the
smallest (cost, audit).  Each row is shifted as it is, deleted, or shifted under another
role; turns are inserted by shifting symbols that have no row.  The grammar must have
finitely many stacks (recursion on the left), which makes a step's work constant.

Audits are not compared letter by letter: after every row the open stacks' audits end in
a letter of that row, so none is a prefix of another, and their order is kept as a rank.
What each stack came from is kept as one small number a row and stack.  Stacks costlier
than the cheapest by more than ``slack`` can never win and go; once the open stacks agree
on how they began, that beginning is written out.

Duplicates are found by an aggregate with a map-side part, not inside a conversation.  A
conversation streams through one task, which holds neither its rows nor its texts, only a
few bytes a row while its repairs disagree, and its audit, which is one cell of the result.

Defined results: a null conv_id is one conversation; null roles and texts are one space;
rows are taken by turn (nulls first), ties by role, then text; repeated rows are rows;
roles that begin with no letter of the grammar (null and empty ones too) can only be
deleted or reroled; a conversation without rows after damage has zeros and an empty
audit; an empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

# Conversations: an optional system turn, then user and assistant in turn, or nothing.
ROLE_GRAMMAR = (("C", ""), ("C", "HT"), ("H", ""), ("H", "s"), ("T", "ua"), ("T", "Tua"))
ROLES = {"u": "user", "a": "assistant"}      # roles that a turn can get
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
# From any stack the rest of any other stack's repair can be copied after one insert at
# most, with a kept system turn deleted instead.
SLACK = INSERT + DELETE
_MAX_STACKS = 256
_LEGAL = {"su", "ua", "au"}
_SETTLE = 1 << 14              # rows between attempts to write out what is settled
_MAX = (1 << 63) - 1

EDITS = "conv_id long, place long, row long, edit string, role string"
REPORT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class Automaton:
    """The LR(0) automaton of a grammar as its finitely many stacks, numbered.

    ``shift[x][t]``: the stacks that stack x can be after symbol t and any reductions, less those
    that neither shift nor accept.  ``inserts[x][y]``: fewest inserted symbols from x to y.
    """

    def __init__(self, grammar=ROLE_GRAMMAR):
        self.grammar, self.heads = grammar, {h for h, _ in grammar}
        self.terminals = sorted({c for _, body in grammar for c in body} - self.heads)
        self.number: dict[tuple, int] = {}
        self.shift: list[dict[str, tuple[int, ...]]] = []
        self.accepts: list[bool] = []
        self.start = self._reduced((self._closed({("", grammar[0][0], 0)}),))
        stacks, at = [*self.number], 0
        while at < len(stacks):
            for t in self.terminals:
                to = self._after(stacks[at][-1], t)
                if to:
                    self.shift[at][t] = self._reduced((*stacks[at], to))
            stacks, at = [*self.number], at + 1
        self.inserts = [self._inserts(x) for x in range(len(stacks))]

    def _closed(self, items):
        items = frozenset(items)
        while True:
            more = items | {(h, b, 0) for _, body, dot in items for h, b in self.grammar if body[dot:dot + 1] == h}
            if more == items:
                return items
            items = more

    def _after(self, state, symbol):
        return self._closed({(h, b, dot + 1) for h, b, dot in state if b[dot:dot + 1] == symbol})

    def _reduced(self, stack) -> tuple[int, ...]:
        """Numbers of all stacks that ``stack`` reduces to, itself included."""
        every = [stack]
        for s in every:
            for h, body, dot in s[-1]:
                if h and dot == len(body):
                    base = s[:len(s) - dot]
                    new = (*base, self._after(base[-1], h))
                    if new not in every:
                        every.append(new)
        out = []
        for s in every:
            accepts = any(not h and dot for h, _, dot in s[-1])
            if accepts or any(b[dot:dot + 1] in self.terminals for _, b, dot in s[-1]):
                if s not in self.number:
                    if len(self.number) >= _MAX_STACKS:
                        raise ValueError("the grammar has too many stacks; recurse on the left")
                    self.number[s] = len(self.number)
                    self.shift.append({})
                    self.accepts.append(accepts)
                out.append(self.number[s])
        return tuple(sorted(out))

    def _inserts(self, x) -> dict[int, str]:
        seen, edge = {x: ""}, [x]
        while edge:
            new: dict[int, str] = {}
            for y in edge:
                for t, to in self.shift[y].items():
                    for z in to if t in ROLES else ():
                        if z not in seen and (z not in new or seen[y] + t < new[z]):
                            new[z] = seen[y] + t
            seen.update(new)
            edge = [*new]
        return seen


class Repair:
    """The graph-structured stack over one conversation."""

    def __init__(self, automaton: Automaton, slack: int = SLACK):
        self.auto, self.slack = automaton, slack
        self.steps: list[tuple[int, tuple]] = []          # (stack before, edits), numbered
        self._moves: dict[tuple, list] = {}
        self.clear()

    def clear(self):
        self.open = {x: (0, 0) for x in self.auto.start}  # stack: (cost, rank of its audit)
        self.trace, self.rows = array("H"), array("q")    # step by row and stack; row keys
        self.due = _SETTLE

    def _of(self, x, initial, gone, truncated):
        """(stack, cost, letters, step) of the ways to take a row in stack x."""
        key = (x, initial, gone, truncated)
        if key not in self._moves:
            best = {x: (DELETE, "D", (("D", ""),))}
            if not gone:
                for y, tokens in self.auto.inserts[x].items():
                    for t, to in self.auto.shift[y].items():
                        ways = ([(0, "K", "")] if t == initial else []) + ([(REROLE, "R", t)] if t in ROLES else [])
                        for cost, letter, role in ways:
                            new = (INSERT * len(tokens) + cost + TRUNCATED * truncated, "I" * len(tokens) + letter,
                                   (*(("I", c) for c in tokens), (letter, role)))
                            for z in to:
                                if z not in best or new < best[z]:
                                    best[z] = new
            self._moves[key] = [(y, c, letters, self._step(x, edits)) for y, (c, letters, edits) in best.items()]
        return self._moves[key]

    def _step(self, x, edits):
        self.steps.append((x, edits))
        return len(self.steps) - 1

    def put(self, row: int, initial: str, gone: bool, truncated: bool):
        """Take one row; gives the edits that are settled, if any."""
        best: dict[int, tuple] = {}
        for x, (cost, rank) in self.open.items():
            for y, c, letters, step in self._of(x, initial, gone, truncated):
                new = (cost + c, rank, letters, step)
                if y not in best or new < best[y]:
                    best[y] = new
        limit = min(best.values())[0] + self.slack
        best = {y: v for y, v in best.items() if v[0] <= limit}
        order = {a: r for r, a in enumerate(sorted({v[1:3] for v in best.values()}))}
        self.open = {y: (v[0], order[v[1:3]]) for y, v in best.items()}
        line = [0] * len(self.auto.shift)
        for y, v in best.items():
            line[y] = v[3]
        self.trace.extend(line)
        self.rows.append(row)
        if len(self.rows) >= self.due:
            return self._settled()
        return ()

    def _settled(self):
        width, at = len(self.auto.shift), set(self.open)
        n = len(self.rows)
        while n and len(at) > 1:
            n -= 1
            at = {self.steps[self.trace[n * width + x]][0] for x in at}
        out = self._back(at.pop(), n) if n else ()
        self.trace, self.rows = self.trace[n * width:], self.rows[n:]
        self.due = max(_SETTLE, 2 * len(self.rows))
        return out

    def _back(self, x, n):
        """Edits (row or None, letter, role) of the first n rows, which end in stack x."""
        width, steps = len(self.auto.shift), []
        for r in range(n - 1, -1, -1):
            x, edits = self.steps[self.trace[r * width + x]]
            steps.append(edits)
        return ((None if letter == "I" else row, letter, ROLES.get(t)) for row, edits in zip(self.rows, reversed(steps)) for letter, t in edits)

    def end(self) -> tuple[int, list]:
        """Cost, and the edits not settled so far."""
        cost, _, tokens, x = min((cost + INSERT * len(tokens), rank, tokens, x) for x, (cost, rank) in self.open.items()
                                 for y, tokens in self.auto.inserts[x].items() if self.auto.accepts[y])
        edits = [*self._back(x, len(self.rows)), *((None, "I", ROLES[t]) for t in tokens)]
        self.clear()
        return cost, edits


class _Report:
    """Counts of one conversation and its audit."""

    def __init__(self):
        self.low = self.high = self.turn = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = self.place = 0
        self.audit = bytearray()

    def put(self, turn, initial, fault):
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.last is not None and self.last + initial not in _LEGAL
        self.last = initial

    def row(self, cost):
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, _MAX)
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": cost, "audit": self.audit.decode()}


_OUT = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("row", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                  ("report", pa.struct([(c, pa.string() if c == "audit" else pa.int64()) for c in (p.split()[0] for p in REPORT.split(", "))]))])


def _stream(batches):
    """Edits and, after the last of each conversation, its report (place null)."""
    parse, conv, report, out = Repair(Automaton()), None, None, []

    def write(edits):
        for row, letter, role in edits:
            out.append((conv, report.place, row, letter, role, None))
            report.place += 1
            report.audit += letter.encode()

    def close():
        cost, edits = parse.end()
        write(edits)
        out.append((conv, None, None, None, None, report.row(cost)))

    def batch():
        cols = [pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, schema=_OUT)
    for b in batches:
        for c, turn, initial, fault, row in zip(*(b.column(k).to_pylist() for k in ("conv", "turn", "initial", "fault", "row"))):
            if report is None or c != conv:
                if report is not None:
                    close()
                conv, report = c, _Report()
            if fault != "dropped":
                report.put(turn, initial, fault)
                write(parse.put(row, initial, fault in ("blank", "duplicate"), fault == "truncated"))
            if len(out) > 1 << 13:
                yield batch()
    if report is not None:
        close()
    if out:
        yield batch()


def turn_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, dropped): nulls of role and text as one space, nothing dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"),
                        text(text_col).alias("text"), F.lit(False).alias("dropped"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of ``turn_rows`` with the faults that crc32(conv:turn) % 20 deals; a dropped row stays
    as a mark of its conversation."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % 20
    return rows.withColumn("kind", kind).select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("dropped") | (F.col("kind") == 0)).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From rows of ``turn_rows``: (reports, repaired).  Reports: one row per conversation with
    conv_id and the columns of REPORT.  Repaired: conv_id, place, edit, role, text of the turns
    kept, reroled and inserted, in order of place."""
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    first = (rows.filter("not dropped").groupBy("conv", "role", "text").agg(F.min(F.struct("turn", "row")).alias("first"))
             .select("first.row", F.lit(True).alias("new")))
    fault = (F.when(F.col("dropped"), "dropped").when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("new").isNull(), "duplicate")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise(""))
    dealt = (rows.join(first, "row", "left").select("conv", "turn", "role", "text", "row", fault.alias("fault"))
             .repartition("conv").sortWithinPartitions("conv", "turn", "role", "text", "row"))
    out = cut_lineage(dealt.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "row")
                      .mapInArrow(_stream, f"{EDITS}, report struct<{REPORT.replace(' ', ':').replace(',:', ',')}>"))
    reports = out.filter("report is not null").select("conv_id", "report.*")
    edits = out.filter("report is null and edit <> 'D'")
    repaired = edits.join(rows.select("row", F.col("role").alias("said"), "text"), "row", "left").select(
        "conv_id", "place", "edit", F.coalesce("role", "said").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return reports, repaired


def _digests(batches):
    conv, sha, out = None, None, []

    def batch():
        cols = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["conv", "repaired_sha256"])
    for b in batches:
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if sha is None or c != conv:
                if sha:
                    out.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(out) > 1 << 13:
            yield batch()
    if sha:
        out.append((conv, sha.hexdigest()))
    if out:
        yield batch()


def repaired_digests(reports: DataFrame, repaired: DataFrame) -> DataFrame:
    """Reports with repaired_sha256, the digest of the repaired ``role:text`` lines."""
    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "role", "text")
    digests = dealt.mapInArrow(_digests, "conv long, repaired_sha256 string")
    return (reports.join(digests, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
            .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))))
