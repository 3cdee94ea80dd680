"""Repair of conversation structure: generalised LR parsing of the turns' roles with weighted edits.

The role grammar is a document D of an optional system turn and one or more pairs of a user and an assistant turn, or nothing.
Its LR(0) automaton is built from ``GRAMMAR``; a parse holds a graph-structured stack, whose nodes are (state, node below) and exist once
however many parses share them. Reductions are followed in all ways. Each turn is kept, reroled, deleted or has turns
inserted before it; parses that meet in an equal stack are merged by the minimum of (cost, audit). Insertions are written right before the
turn that is kept or reroled, or at the end: a deletion before an insertion gives the same turns and the lesser audit. Audits of
the same turns and cost are never prefixes of one another, so the lesser one stays the lesser whatever follows.

A conversation of any length is cut into pieces of ``PIECE`` rows. The stacks of this grammar are finitely many, so a piece is a table
from the stack before to the stack after it with (cost, rank of the audit in the piece); only these numbers of a conversation meet,
as a stream in order, to choose the way through its pieces. Equal rows travel as one row with a count.

Faults: blank (no character besides blanks), duplicate (role and text seen earlier in the conversation), truncated (last such
character is none of ``.!?``); a row's first fault counts. Blank and duplicate rows are deleted; a truncated row that stays costs
3 more.

Defined results: null roles and texts are one space; a null conv_id is a conversation of its own; rows of one turn go by role, then
text; a role that the grammar does not know is reroled or deleted; an empty table gives an empty result; columns besides
conv_id, turn, role and text are not read. The digest of one conversation is by its nature a sequential pass over its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, in_workers, stored, table

GRAMMAR = (("D", ""), ("D", "P"), ("D", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))
NAMES = {"u": "user", "a": "assistant"}  # what can be inserted or reroled to
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
PIECE, PIECE_BYTES = 256, 4 << 20


class Stacks:
    """The graph-structured stack of a grammar's LR(0) automaton, and what edits do to its tops."""

    def __init__(self, grammar=GRAMMAR, names=tuple(NAMES)):
        self.grammar, self.names = grammar, names
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self._state(frozenset(self._closure({("", grammar[0][0], 0)})))
        self.nodes: list[tuple[int, int]] = []  # (state, node below)
        self.number: dict[tuple[int, int], int] = {}
        self.next: list[dict[str, set[int]]] = []
        start = self._settled(self._node(0, -1))
        todo, seen = list(start), set(start)
        terminals = {c for _, right in grammar for c in right} - {left for left, _ in grammar}
        self.moves: dict[int, dict[str, set[int]]] = {}
        while todo:
            node = todo.pop()
            self.moves[node] = {t: self._shift(node, t) for t in terminals}
            new = set().union(*self.moves[node].values()) - seen
            seen |= new
            todo += new
        (self.root,) = start
        self.inserted = {node: self._insertions(node) for node in seen}
        self.tails = {n: min((k for m, k in self.inserted[n].items() if self._accepts(m)), default=None) for n in seen}

    def _closure(self, items: set) -> set:
        todo = list(items)
        while todo:
            _, right, at = todo.pop()
            for rule in self.grammar:
                if at < len(right) and rule[0] == right[at] and (*rule, 0) not in items:
                    items.add((*rule, 0))
                    todo.append((*rule, 0))
        return items

    def _state(self, items: frozenset) -> int:
        if items in self.states:
            return self.states.index(items)
        self.states.append(items)
        k = len(self.states) - 1
        for symbol in sorted({right[at] for _, right, at in items if at < len(right)}):
            after = {(left, right, at + 1) for left, right, at in items if right[at : at + 1] == symbol}
            self.goto[k, symbol] = self._state(frozenset(self._closure(after)))
        return k

    def _node(self, state: int, below: int) -> int:
        key = (state, below)
        if key not in self.number:
            self.number[key] = len(self.nodes)
            self.nodes.append(key)
        return self.number[key]

    def _reduced(self, node: int) -> set[int]:
        """The node and all that reductions make of it."""
        found, todo = {node}, [node]
        while todo:
            top = todo.pop()
            for left, right, at in self.states[self.nodes[top][0]]:
                if left and at == len(right):
                    base = top
                    for _ in right:
                        base = self.nodes[base][1]
                    if (to := self.goto.get((self.nodes[base][0], left))) is not None and (new := self._node(to, base)) not in found:
                        found.add(new)
                        todo.append(new)
        return found

    def _settled(self, node: int) -> set[int]:
        """What stays of a node after the reductions that it must make: nodes that can shift."""
        return {n for n in self._reduced(node) if any(at < len(right) for _, right, at in self.states[self.nodes[n][0]])}

    def _shift(self, node: int, terminal: str) -> set[int]:
        tops = {n: self.goto.get((self.nodes[n][0], terminal)) for n in self._reduced(node)}
        return set().union(*(self._settled(self._node(to, n)) for n, to in tops.items() if to is not None))

    def _accepts(self, node: int) -> bool:
        return any(("", self.grammar[0][0], 1) in self.states[self.nodes[n][0]] for n in self._reduced(node))

    def _insertions(self, node: int) -> dict[int, int]:
        """Tops that insertions reach, and how many they take at least."""
        found, edge, k = {node: 0}, {node}, 0
        while edge:
            k += 1
            edge = {m for n in edge for t in self.names for m in self.moves[n][t]} - set(found)
            found |= dict.fromkeys(edge, k)
        return found

    @cache  # noqa: B019 - one object per process
    def actions(self, node: int, initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, str], ...]:
        """(stack after, cost, audit) of what can be done with a turn."""
        out = [(node, DELETE, "D")]
        if not must_go:
            for top, k in self.inserted[node].items():
                base = k * INSERT + (TRUNCATED if truncated else 0)
                out += [(to, base, "I" * k + "K") for to in self.moves[top].get(initial, ())]
                out += [(to, base + REROLE, "I" * k + "R") for t in self.names if t != initial for to in self.moves[top][t]]
        return tuple(out)

    def parse(self, tops: dict[int, tuple[int, str]], turns) -> dict[int, tuple[int, str]]:
        """(cost, audit) of each stack after the turns (initial, must go, truncated)."""
        for initial, must_go, truncated in turns:
            after: dict[int, tuple[int, str]] = {}
            for node, (cost, audit) in tops.items():
                for to, more, edit in self.actions(node, initial, must_go, truncated):
                    new = (cost + more, audit + edit)
                    if to not in after or new < after[to]:
                        after[to] = new
            tops = after
        return tops


@cache
def stacks() -> Stacks:
    return Stacks()


def faults(text: str) -> str:
    core = text.rstrip(BLANKS)
    return "blank" if not core else "" if core[-1] in ".!?" else "truncated"


ROW = "struct<role:string,text:string,n:long,seen:boolean>"
PIECES = (
    "conv_id long, part long, nth long, opens boolean, rows array<" + ROW + ">, ways array<struct<before:int,after:int,cost:long,rank:int,audit:string>>, "
    "turns array<long>, n_turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
)


def _piece(conv, part: int, nth: int, opens: bool, rows: list[tuple]) -> dict:
    """A row of PIECES from (turn, role, text, n, seen): counts, and the ways through it from every stack it can meet."""
    parser, turns, count = stacks(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
    illegal, last = 0, None
    for _, role, text, n, seen in rows:
        fault, initial = faults(text), role[:1]
        first = "duplicate" if seen and fault != "blank" else fault
        count[first] += 1
        count["blank" if fault == "blank" else "duplicate"] += n - 1
        illegal += (last is not None and last + initial not in ("su", "ua", "au")) + n - 1
        last = initial
        turns.append((initial, first in ("blank", "duplicate"), first == "truncated"))
        turns += [(initial, True, False)] * (n - 1)
    ways = []
    for before in [parser.root] if opens else sorted(parser.moves):
        ways += [(before, after, cost, audit) for after, (cost, audit) in parser.parse({before: (0, "")}, turns).items()]
    rank = {a: i for i, a in enumerate(sorted({w[3] for w in ways}))}
    own = [t for t, *_ in rows if t is not None]
    return {
        "conv_id": conv, "part": part, "nth": nth, "opens": opens, "rows": [dict(zip(("role", "text", "n", "seen"), r[1:])) for r in rows],
        "ways": [{"before": b, "after": a, "cost": c, "rank": rank[s], "audit": s} for b, a, c, s in ways],
        "turns": [own[0], own[-1]] if own else [], "n_turns": len(set(own)), "blank": count["blank"], "duplicate": count["duplicate"], "truncated": count["truncated"],
        "illegal": illegal, "first": rows[0][1][:1], "last": last,
    }


def _arrow(schema: str, spark: SparkSession):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def pieces(turns: DataFrame) -> DataFrame:
    """PIECES of all conversations: the rows by (conv_id, turn, role, text) in ranges, each conversation in pieces of its range."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    cells = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    content = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    cells = stored(cells.withColumns({"content": content, "at": F.struct(F.col("turn").isNotNull().alias("known"), "turn")}), "cells")
    earliest = cells.groupBy(F.col("conv_id").alias("of"), F.col("content").alias("same")).agg(F.min("at").alias("earliest"))
    marked = cells.join(earliest, cells.conv_id.eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")))
    order = ["conv_id", "turn", "role", "text"]
    ranged = marked.select(*order, "n", (F.col("at") > F.col("earliest")).alias("seen")).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _arrow(PIECES, turns.sparkSession)

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0

        def cut():
            nonlocal nth
            held, size, conv, opens = [], 0, None, False
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if held and (row[0] != conv or len(held) == PIECE or size >= PIECE_BYTES):
                        yield _piece(conv, part, nth, opens, held)
                        opens, nth, held, size = row[0] != conv, nth + 1, [], 0
                    conv = row[0]
                    held.append(row[1:])
                    size += len(row[3])
            if held:
                yield _piece(conv, part, nth, opens, held)

        yield from _batches(cut(), schema, 64)

    return in_workers(ranged, run, PIECES)


CHOSEN = (
    "conv_id long, part long, nth long, before int, after int, tail int, "
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
)


def _chosen(conv, held: list[dict]) -> Iterator[dict]:
    """The cheapest way through a conversation's pieces, ties to the least audit; the last piece's row carries the sums."""
    parser = stacks()
    tops, trail = {parser.root: (0, 0)}, []  # stack: (cost, place of its audit among the audits so far)
    for p in held:
        best: dict[int, tuple[int, tuple[int, int], int]] = {}
        for w in p["ways"]:
            if w["before"] in tops:
                cost, at = tops[w["before"]]
                new = (cost + w["cost"], (at, w["rank"]), w["before"])
                if w["after"] not in best or new < best[w["after"]]:
                    best[w["after"]] = new
        places = {a: i for i, a in enumerate(sorted({b[1] for b in best.values()}))}
        trail.append({after: b[2] for after, b in best.items()})
        tops = {after: (cost, places[at]) for after, (cost, at, _) in best.items()}
    cost, _, tail, node = min((c + INSERT * parser.tails[n], at, parser.tails[n], n) for n, (c, at) in tops.items() if parser.tails[n] is not None)
    way = []
    for step in reversed(trail):
        way.append((step[node], node))
        node = step[node]
    way.reverse()
    ends = [p["turns"] for p in held if p["turns"]]
    gaps = ends[-1][1] - ends[0][0] + 1 - sum(p["n_turns"] for p in held) + sum(a[1] == b[0] for a, b in zip(ends, ends[1:])) if ends else 0
    sums = {k: sum(p[k] for p in held) for k in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
    for p, (before, after) in zip(held, way):
        last = p is held[-1]
        yield {"conv_id": conv, "part": p["part"], "nth": p["nth"], "before": before, "after": after, "tail": tail if last else 0} | ({"gaps": gaps, "cost": cost, **sums} if last else {})


def chosen(cut: DataFrame) -> DataFrame:
    """CHOSEN: for each piece the stacks before and after it; numbers only, a conversation at a time as a sorted stream."""
    schema = _arrow(CHOSEN, cut.sparkSession)
    ways = F.transform("ways", lambda w: w.dropFields("audit")).alias("ways")
    lean = cut.select("conv_id", "part", "nth", ways, "turns", "n_turns", "blank", "duplicate", "truncated", "illegal", "first", "last")

    def run(batches):
        def each():
            held, conv = [], None
            for batch in batches:
                for row in batch.to_pylist():
                    if held and row["conv_id"] != conv:
                        yield from _chosen(conv, held)
                        held = []
                    conv = row["conv_id"]
                    held.append(row)
            if held:
                yield from _chosen(conv, held)

        yield from _batches(each(), schema)

    return in_workers(lean.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth"), run, CHOSEN)


REPAIRED = "conv_id long, part long, nth long, audit string, rows array<struct<role:string,text:string,action:string>>, " + CHOSEN.split("tail int, ")[1]


def repair(turns: DataFrame) -> DataFrame:
    """REPAIRED: the pieces of all conversations in the order (conv_id, part, nth), repaired.

    ``rows`` are a piece's turns after the repair, each with K, R or I; ``audit`` are its edits. The last piece of a
    conversation has its gaps, faults and cost, the others null.
    """
    cut = stored(pieces(turns), "pieces")
    choice = stored(chosen(cut), "chosen").drop("conv_id")
    schema = _arrow(REPAIRED, turns.sparkSession)

    def run(batches):
        parser = stacks()

        def each():
            for batch in batches:
                for p in batch.to_pylist():
                    audit = next(w["audit"] for w in p["ways"] if (w["before"], w["after"]) == (p["before"], p["after"])) + "I" * p["tail"]
                    rows = [r for r in p["rows"] for _ in range(r["n"])]
                    out, at = [], 0
                    for edit, role in zip(audit, _roles(parser, p["before"], audit, rows, p["after"])):
                        row = rows[at] if edit != "I" else {"role": role, "text": ""}
                        at += edit != "I"
                        if edit != "D":
                            out.append({"role": row["role"] if edit == "K" else role, "text": row["text"], "action": edit})
                    yield {f.name: p.get(f.name) for f in schema} | {"audit": audit, "rows": out}

        yield from _batches(each(), schema, 64)

    return in_workers(cut.select("conv_id", "part", "nth", "rows", "ways").join(choice, ["part", "nth"]), run, REPAIRED)


def _roles(parser: Stacks, before: int, audit: str, rows: list[dict], after: int) -> list[str | None]:
    """The role of each edit of an audit: the one parse of it that leads to ``after`` (and on through the trailing insertions)."""
    tops = [{before: (None, None)}]
    at = 0
    for edit in audit:
        if edit == "D":
            step = {n: (n, None) for n in tops[-1]}
        else:
            known = {rows[at]["role"][:1]} if edit == "K" else parser.names
            step = {to: (n, t) for n in tops[-1] for t in known for to in parser.moves[n].get(t, ())}
        at += edit != "I"
        tops.append(step)
    tail = len(audit) - len(audit.rstrip("I"))
    node = after if not tail else next(n for n in tops[-1] if parser.tails[n] == 0)
    out: list[str | None] = []
    for step in reversed(tops[1:]):
        node, t = step[node]
        out.append(NAMES.get(t))
    return out[::-1]


def summaries(repaired: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conv_id of ``ids``."""
    schema_text = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _arrow(schema_text, ids.sparkSession)
    numbers = schema.names[1:7]
    lines = F.concat_ws("\n", F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))).alias("lines")
    lean = repaired.select("conv_id", "part", "nth", "audit", F.size("rows").alias("n"), lines, *numbers)

    def run(batches):
        def each():
            digest, audit, any_line = hashlib.sha256(), [], False
            for batch in batches:
                for p in batch.to_pylist():
                    audit.append(p["audit"])
                    if p["n"]:
                        digest.update(("\n" if any_line else "").encode() + p["lines"].encode("utf-8", "surrogatepass"))
                        any_line = True
                    if p["cost"] is not None:  # the last piece
                        yield {k: p[k] for k in ("conv_id", *numbers)} | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                        digest, audit, any_line = hashlib.sha256(), [], False

        yield from _batches(each(), schema)

    found = in_workers(lean.repartition("conv_id").sortWithinPartitions("conv_id", "part", "nth"), run, schema_text).withColumnRenamed("conv_id", "of")
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, every.conv_id.eqNullSafe(F.col("of")), "left").drop("of")
    zero = {n: F.coalesce(n, F.lit(0).cast("long")) for n in numbers}
    return joined.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(conv_id:turn) % 20: 0 is dropped, 1 emptied, 2 without ``.!?``, 3 there twice, 4 a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    faulty = rows.where("kind > 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.explode(F.sequence(F.lit(1), times)))
    return faulty.drop("col")


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return summaries(repair(damaged(conversations)), conversations)


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _sql() -> str:
    """The query in SQL: a fold over each conversation with the least (cost, audit) of four ends: nothing, s, u, a."""
    never = "{'c': 1000000000000, 't': ''}"

    def take(initial, ways, can_rerole):
        out = []
        for state, k in ways:
            mark, base = "I" * k, f"acc.{state}.c + {3 * k} + x.extra"
            out.append(f"CASE WHEN NOT x.gone AND x.i = '{initial}' THEN {{'c': {base}, 't': acc.{state}.t || '{mark}K'}} ELSE {never} END")
            if can_rerole:
                out.append(f"CASE WHEN NOT x.gone THEN {{'c': {base} + 3, 't': acc.{state}.t || '{mark}R'}} ELSE {never} END")
        return out

    ways = {"e": [], "s": take("s", [("e", 0)], False), "u": take("u", [("e", 0), ("s", 0), ("a", 0), ("u", 1)], True),
            "a": take("a", [("u", 0), ("e", 1), ("s", 1), ("a", 1)], True)}
    step = ", ".join(f"'{n}': list_min([{', '.join([f'''{{'c': acc.{n}.c + 4, 't': acc.{n}.t || 'D'}}''', *w])}])" for n, w in ways.items())
    begin = ", ".join(f"'{n}': {{'c': {0 if n == 'e' else 10**12}::BIGINT, 't': ''}}" for n in "esua")
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: xor(h >> 8, ({_crc_table()}::BIGINT[])[(xor(h, c) & 255) + 1]))"
    return rf"""
WITH o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
z AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM o),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM z)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nr FROM d),
f AS (SELECT *, substr(role, 1, 1) AS i, regexp_matches(text, '[^\x20\x09-\x0D]') AS full_, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 AS seen,
    coalesce(regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1), '') NOT IN ('.', '!', '?') AS open_,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY nr) || substr(role, 1, 1) AS pair FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (NOT full_) AS blank, count(*) FILTER (full_ AND seen) AS duplicate,
    count(*) FILTER (full_ AND NOT seen AND open_) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': i, 'gone': NOT full_ OR seen, 'extra': CASE WHEN open_ THEN 3 ELSE 0 END}} ORDER BY nr) AS xs,
    list(role ORDER BY nr) AS roles, list(text ORDER BY nr) AS texts FROM f GROUP BY conv_id),
r AS (SELECT *, list_reduce(xs, lambda acc, x: {{{step}}}, {{{begin}}}) AS v FROM g),
b AS (SELECT *, list_min([v.e, v.a, {{'c': v.u.c + 3, 't': v.u.t || 'I'}}, {{'c': v.s.c + 6, 't': v.s.t || 'II'}}]) AS best FROM r),
e AS (SELECT conv_id, roles, texts, unnest(string_split(best.t, '')) AS edit, unnest(range(1, length(best.t) + 1)) AS pos, best.t AS audit FROM b WHERE best.t <> ''),
p AS (SELECT *, pos - length(regexp_replace(substr(audit, 1, pos), '[^I]', '', 'g')) AS src FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS nr FROM p WHERE edit <> 'D'),
h AS (SELECT *, max(CASE WHEN nr = 1 AND edit = 'K' AND roles[src][1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead_ FROM q),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN roles[src] WHEN (nr - lead_) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE texts[src] END, chr(10) ORDER BY nr) AS body
  FROM h GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.t, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
