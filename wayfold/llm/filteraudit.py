"""How filters interact: what each removes in every order, from count-weighted decision diagrams of failure masks.

Spark reduces the documents of each part to counts by failure mask. A diagram over these masks has one level for each
filter and, at its ends, how many documents fail just these filters. Swapping two neighbouring levels gives the diagram
of another order, so all orders follow from one another by one swap each. In each, the path on which every filter is
passed has what the order does: the weight below it is what is kept, the weight branching off what is removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.store import written

FILTERS = "ABCDE"
RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, length = F.size(words).cast("long"), F.char_length(text).cast("long")
    capitals = length - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(80) * n,
        "C": F.lit(100) * capitals > F.lit(10) * length,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang", quality: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """(part, mask, n, good, toxic): rows of a part that fail just the filters of a mask (bit k: filter k).

    E fails where a smaller id has the identical text. Rows that repeat an id do not fail E because of each other; rows
    without an id never fail E and make no other row fail. Several labels of an id count as the highest. A null text is
    empty, a null part the empty string. No text meets in one task: the least id of each text is a combined aggregate,
    and rows find it by (digest, id), which hardly repeats.
    """
    own = own_failures(F.col("_text"))
    bits = sum((fails.cast("int") * (1 << FILTERS.index(name)) for name, fails in own.items()), F.lit(0))
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    )
    marked = F.unhex(F.sha2("_text", 256)).alias("_digest"), bits.alias("_own")
    rows = written(rows.select("_id", "part", *marked), "masks")
    flag = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("long"), F.lit(0)))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(flag(quality).alias("good"), flag(toxic).alias("toxic"))
    rows = written(rows.join(known, "_id", "left").fillna(0, ["good", "toxic"]), "labelled")
    least = rows.groupBy("_digest").agg(F.min("_id").alias("_id"))
    passing = rows.join(least, ["_digest", "_id"], "left_semi").unionByName(rows.where("_id IS NULL").select("_digest", "_id", "part", "_own", "good", "toxic"))
    sums = lambda df: df.groupBy("part", "_own").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    least_of = sums(passing)
    e = 1 << FILTERS.index("E")
    moved = least_of.select("part", F.explode(F.array(
        F.struct(F.col("_own").alias("mask"), *[F.col(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct((F.col("_own") + e).alias("mask"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")]),
    )).alias("x")).select("part", "x.*")
    every = sums(rows).select("part", (F.col("_own") + e).alias("mask"), "n", "good", "toxic")
    counted = every.unionByName(moved).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return counted.where("n > 0")


class Diagram:
    """A decision diagram over failure masks with a level for each filter, weighted by (documents, good, toxic).

    A node is a pair of (passes, fails) children, an end a weight; equal nodes are one, nothing below a branch is None.
    Every path has all levels, so swapping neighbours needs only their two levels.
    """

    def __init__(self, order: str, weights: dict[int, tuple[int, ...]]):
        self.order, self.nodes, self.totals = list(order), {}, {}
        leaf = lambda mask: self._end(weights.get(mask))
        bits = [1 << FILTERS.index(name) for name in order]

        def build(level: int, mask: int):
            if level == len(bits):
                return leaf(mask)
            return self._node(build(level + 1, mask), build(level + 1, mask | bits[level]))

        self.root = build(0, 0)

    def _end(self, weight):
        return None if not weight or not any(weight) else self._known(("end", tuple(weight)))

    def _node(self, passes, fails):
        return None if passes is None and fails is None else self._known(("node", passes, fails))

    def _known(self, key):
        """The number of the node of this content."""
        if key not in self.nodes:
            number = len(self.nodes)
            self.nodes[key] = number
            self.totals[number] = key[1] if key[0] == "end" else tuple(map(sum, zip(*map(self.weight, key[1:]))))
            self.totals[number, "children"] = key[1:] if key[0] == "node" else None
        return self.nodes[key]

    def weight(self, node) -> tuple[int, ...]:
        return (0, 0, 0) if node is None else self.totals[node]

    def children(self, node):
        return (None, None) if node is None else self.totals[node, "children"]

    def swap(self, level: int) -> None:
        """Exchange the filters of this level and the next; levels above are rebuilt on top, those below stay shared."""
        done = {}

        def rebuilt(node, at: int):
            if node is None:
                return None
            if (node, at) not in done:
                low, high = self.children(node)
                if at < level:
                    done[node, at] = self._node(rebuilt(low, at + 1), rebuilt(high, at + 1))
                else:
                    (ll, lh), (hl, hh) = self.children(low), self.children(high)
                    done[node, at] = self._node(self._node(ll, hl), self._node(lh, hh))
            return done[node, at]

        self.root = rebuilt(self.root, 0)
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weight kept by it, weight removed by it), in the diagram's order."""
        node = self.root
        for name in self.order:
            node, fails = self.children(node)
            yield name, self.weight(node), self.weight(fails)


def adjacent_swaps(n: int) -> list[int]:
    """Levels whose swaps lead through all orders of n filters, each once: the last filter sweeps to and fro through the rest's orders."""
    if n < 2:
        return []
    sweep, out = [*range(n - 2, -1, -1)], []
    inner = adjacent_swaps(n - 1)
    for turn in range(factorial(n - 1)):
        out += sweep if turn % 2 == 0 else sweep[::-1]
        if turn < len(inner):
            # After a sweep to the front the others stand one level deeper.
            out.append(inner[turn] + (turn % 2 == 0))
    return out


def audit(weights: dict[int, tuple[int, ...]]) -> list[dict]:
    """A row for each order and step, from the masks' (documents, good, toxic)."""
    diagram = Diagram(FILTERS, weights)
    paths = {"".join(diagram.order): [*diagram.all_pass_path()]}
    for level in adjacent_swaps(len(FILTERS)):
        diagram.swap(level)
        paths["".join(diagram.order)] = [*diagram.all_pass_path()]
    failing = {path[0][0]: path[0][2][0] for path in paths.values()}
    alone = {path[-1][0]: path[-1][2][0] for path in paths.values()}
    share = dict.fromkeys(FILTERS, 0)
    for path in paths.values():
        for name, _, removed in path:
            share[name] += removed[0]
    return [
        {
            "filter_order": order, "step": step, "kept": kept[0], "removed": removed[0], "redundant": failing[name] - removed[0],
            "unique_fails": alone[name], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": share[name],
        }
        for order, path in sorted(paths.items()) for step, (name, kept, removed) in enumerate(path, 1)
    ]


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    See failure_counts for nulls, repeats and ties. An empty table has no parts and gives no rows; other columns of docs
    and labels are not looked at. A part is at most 32 masks when its diagram is built.
    """

    def diagrams(key: tuple, masks: pd.DataFrame) -> pd.DataFrame:
        weights = {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in masks.itertuples()}
        return pd.DataFrame(audit(weights)).assign(part=key[0])[[c.split()[0] for c in RESULT.split(", ")]]

    return failure_counts(docs, labels, **columns).groupBy("part").applyInPandas(diagrams, RESULT)
