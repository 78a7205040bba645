"""Repair of conversation structure by a generalised LR parser over the grammar of roles.

The parser's automaton is built from the grammar. A row can be kept, given another role or deleted, and rows can be put in,
each at a cost. All stacks that some choice leads to are followed together: they form a graph in which lower parts are
shared, and of those that arrive at the same top only the one with the least (cost, audit) goes on. What is left after the
last row and can be accepted is the cheapest repair; no repair is cut off, and nothing is enumerated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A conversation is empty, or pairs of user and assistant after at most one system row; symbols are initials of roles.
ROLE_GRAMMAR = {"Talk": [(), ("Pairs",), ("s", "Pairs")], "Pairs": [("Pair",), ("Pairs", "Pair")], "Pair": [("u", "a")]}
#: Roles that may be given to a row or put in.
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
END, START = "$", "^"
#: Letters of an audit's tail beyond which it is settled.
TAIL = 64


class Automaton:
    """SLR tables of a grammar, and the graph of stacks over its states.

    A stack is a node (state, node below); equal nodes are one. shift() leads from a node over a symbol, with all
    reductions that the symbol allows before it; what it finds is remembered, so a row costs a few lookups.
    """

    def __init__(self, grammar: dict[str, list[tuple[str, ...]]]):
        self.rules = [(START, (next(iter(grammar)),)), *((left, right) for left, rights in grammar.items() for right in rights)]
        self.names = {START, *grammar}
        self.follow = self._follow()
        self.states, self.next = [self._closure({(0, 0)})], {}
        for state, items in enumerate(self.states):
            for symbol in sorted({self.rules[r][1][at] for r, at in items if at < len(self.rules[r][1])}):
                after = self._closure({(r, at + 1) for r, at in items if self.rules[r][1][at : at + 1] == (symbol,)})
                if after not in self.states:
                    self.states.append(after)
                self.next[state, symbol] = self.states.index(after)
        self.nodes, self.ids, self.known = [], {}, {}
        self.root = self._node(0, None)

    def _closure(self, items: set[tuple[int, int]]) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, at = todo.pop()
            for symbol in self.rules[rule][1][at : at + 1]:
                new = {(r, 0) for r, (left, _) in enumerate(self.rules) if left == symbol} - items
                items |= new
                todo += new
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        """Symbols that can stand after each name."""
        empty, first, follow = set(), {n: set() for n in self.names}, {n: set() for n in self.names}
        follow[START].add(END)
        while True:
            before = sum(map(len, [empty, *first.values(), *follow.values()]))
            for left, right in self.rules:
                behind, can_end = set(follow[left]), True
                for symbol in reversed(right):
                    if symbol in self.names:
                        follow[symbol] |= behind
                        behind = first[symbol] | (behind if symbol in empty else set())
                    else:
                        behind = {symbol}
                for symbol in right:
                    if not can_end:
                        break
                    first[left] |= first[symbol] if symbol in self.names else {symbol}
                    can_end = symbol in empty
                if can_end:
                    empty.add(left)
            if before == sum(map(len, [empty, *first.values(), *follow.values()])):
                return follow

    def _node(self, state: int, below: int | None) -> int:
        key = (state, below)
        if key not in self.ids:
            self.ids[key] = len(self.nodes)
            self.nodes.append(key)
        return self.ids[key]

    def _reduced(self, node: int, symbol: str) -> set[int]:
        """The node and all that reductions lead to which this symbol allows."""
        found, todo = {node}, [node]
        while todo:
            top = todo.pop()
            for rule, at in self.states[self.nodes[top][0]]:
                left, right = self.rules[rule]
                if rule and at == len(right) and symbol in self.follow[left]:
                    below = top
                    for _ in right:
                        below = self.nodes[below][1]
                    new = self._node(self.next[self.nodes[below][0], left], below)
                    if new not in found:
                        found.add(new)
                        todo.append(new)
        return found

    def shift(self, node: int, symbol: str) -> tuple[int, ...]:
        if (node, symbol) not in self.known:
            over = [(n, self.next.get((self.nodes[n][0], symbol))) for n in self._reduced(node, symbol)]
            self.known[node, symbol] = tuple(self._node(state, n) for n, state in over if state is not None)
        return self.known[node, symbol]

    def accepts(self, node: int) -> bool:
        if (node, END) not in self.known:
            done = (0, 1)
            self.known[node, END] = any(done in self.states[self.nodes[n][0]] for n in self._reduced(node, END))
        return self.known[node, END]


class Repair:
    """The stacks that the rows so far lead to, each with its least (cost, audit) and the digest of its repaired text.

    Texts go into the digests at once, so memory grows by a letter of audit a row and stack. An audit is a chain of
    settled pieces, the rank of these among all stacks' and a tail; audits compare by rank and tail.
    """

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.tops = {automaton.root: (0, 0, "", None, hashlib.sha256(), False)}
        self._insert()

    def _insert(self) -> None:
        """Every stack with the rows put in that make it cheaper to reach."""
        todo = list(self.tops)
        while todo:
            node = todo.pop()
            cost, rank, tail, chain, digest, started = self.tops[node]
            for symbol, role in ROLES.items():
                for to in self.automaton.shift(node, symbol):
                    new = (cost + INSERT, rank, tail + "I")
                    if to not in self.tops or new < self.tops[to][:3]:
                        self.tops[to] = (*new, chain, *_added(digest, started, role, ""))
                        todo.append(to)

    def add(self, role: str, text: str, *, must_go: bool, truncated: bool) -> None:
        best: dict[int, tuple] = {}

        def offer(to: int, cost: int, rank: int, tail: str, node: int, given: str | None) -> None:
            if to not in best or (cost, rank, tail) < best[to][:3]:
                best[to] = (cost, rank, tail, node, given)

        for node, (cost, rank, tail, *_) in self.tops.items():
            offer(node, cost + DELETE, rank, tail + "D", node, None)
            if not must_go:
                kept = cost + TRUNCATED * truncated
                for to in self.automaton.shift(node, role[:1]) if role[:1] != END else ():
                    offer(to, kept, rank, tail + "K", node, role)
                for symbol, given in ROLES.items():
                    for to in self.automaton.shift(node, symbol):
                        offer(to, kept + REROLE, rank, tail + "R", node, given)
        old, self.tops = self.tops, {}
        for to, (cost, rank, tail, node, given) in best.items():
            chain, *digest = old[node][3:]
            self.tops[to] = (cost, rank, tail, chain, *(digest if given is None else _added(*digest, given, text)))
        if max(len(x[2]) for x in self.tops.values()) > TAIL:
            self._settle()
        self._insert()

    def _settle(self) -> None:
        """Turn tails into ranks. All audits end in a row's own letter here, so none is the beginning of another, and what
        follows cannot change their order."""
        ranks = {x: k for k, x in enumerate(sorted({top[1:3] for top in self.tops.values()}))}
        self.tops = {node: (cost, ranks[rank, tail], "", (chain, tail), *rest) for node, (cost, rank, tail, chain, *rest) in self.tops.items()}

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the best repair."""
        cost, _, tail, chain, digest, _ = min((x for node, x in self.tops.items() if self.automaton.accepts(node)), key=lambda x: x[:3])
        pieces = [tail]
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return cost, "".join(reversed(pieces)), digest.hexdigest()


def _added(digest, started: bool, role: str, text: str) -> tuple:
    digest = digest.copy()
    digest.update(f"{chr(10) if started else ''}{role}:{text}".encode())
    return digest, True


BLANKS = r"\x20\x09-\x0D"


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(_conv, _turn, _role, _text, _copy, _gone) with faults that crc32(`conv:turn`) decides; nulls read as one space.

    A dropped row stays as one that is _gone and has no text, so that its conversation is not forgotten.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(name(conv), F.lit(":"), name(turn)).cast("binary")), F.lit(20))
    body = F.when(code <= 1, F.lit("")).when(code == 2, F.regexp_replace(name(text), "[.!?]", "")).otherwise(name(text))
    copies = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    given = F.when(code == 0, F.lit("")).when(code == 4, F.lit("user")).otherwise(name(role))
    return rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), given.alias("_role"), body.alias("_text"), (code == 0).alias("_gone"), F.explode(copies).alias("_copy"))


def undamaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The same columns for rows as they are."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), name(role).alias("_role"), name(text).alias("_text"), F.lit(False).alias("_gone"), F.lit(0).alias("_copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with _fault (blank, duplicate, truncated or null): the first that applies.

    One shuffle by conversation serves this window and what follows it.
    """
    order = [F.col("_turn").asc_nulls_first(), "_role", "_text", "_copy"]
    same = Window.partitionBy("_conv", "_gone", "_role", F.sha2("_text", 256)).orderBy(*order)
    blank = ~F.col("_text").rlike(f"[^{BLANKS}]")
    fault = (
        F.when(F.col("_gone"), None).when(blank, "blank").when(F.row_number().over(same) > 1, "duplicate")
        .when(~F.col("_text").rlike(rf"[.!?][{BLANKS}]*\z"), "truncated")
    )
    return rows.repartition("_conv").withColumn("_fault", fault).sortWithinPartitions("_conv", *order)


FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """What is counted while the rows of one conversation go by."""

    def __init__(self, automaton: Automaton):
        self.repair, self.faults = Repair(automaton), {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = None
        self.turns = self.illegal = 0
        self.before = None

    def add(self, turn, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if fault:
            self.faults[fault] += 1
        self.repair.add(role, text, must_go=fault in ("blank", "duplicate"), truncated=fault == "truncated")

    def facts(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.faults.values(), self.illegal, *self.repair.result())


def repair_conversations(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False, grammar: dict = ROLE_GRAMMAR
) -> DataFrame:
    """A row for each conversation: its id, gaps in the turns, faults, illegal neighbours, and the cheapest repair's cost,
    audit and digest. damage adds faults first (see damaged).

    Null roles and texts read as one space, which is blank; a null id is a conversation of its own; null turns come first
    and count for no gap. Rows of one turn go by role and text. An empty table has no conversations; columns that are not
    named are ignored, whatever they are called. Rows stream by in order: a conversation's digest takes them one after
    another, so a very long one is one task's work, but none of it is held in memory.
    """
    made = damaged if damage else undamaged
    kind = rows.schema[conv].dataType.simpleString()
    names = ["_conv", *[x.split()[0] for x in FACTS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, held, done = Automaton(grammar), None, None, []
        for batch in batches:
            for key, at, who, what, gone, fault in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if now is None or key != held:
                    if now:
                        done.append((held, *now.facts()))
                    held, now = key, Conversation(automaton)
                if not gone:
                    now.add(at, who, what, fault)
            if done:
                yield _batch(done, batch.schema.field(0).type, names)
                done = []
        if now:
            yield _batch([(held, *now.facts())], batch.schema.field(0).type, names)

    sorted_rows = with_faults(made(rows, conv, turn, role, text)).select("_conv", "_turn", "_role", "_text", "_gone", "_fault")
    return sorted_rows.mapInArrow(run, f"_conv {kind}, {FACTS}").withColumnRenamed("_conv", conv)


def _batch(rows: list[tuple], key: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)
