"""Sequential per-key logic run in parallel over time slices, in a fixed number of passes.

Some operators walk a timeline and remember a small state (an anchor, a tier). A kernel processes one (key, slice) group,
taking the state left by the slice before it and returning its own. When a key spans several slices, every slice first
runs from a fresh state and also says what it makes of any other: a map from entry to exit states, as one summary row. One
pass over the summaries composes the maps, so that every slice learns the state it really starts from; slices that start
from another state than the fresh one run once more, and that is all. Results equal those of one uninterrupted walk, and
no task holds more than one slice of rows, whatever the number of slices.

Most slices contain a cut: a row from which on the walk is the same whatever came before. Then only the rows before the
cut run again.

A kernel is a small picklable object with
  columns  input columns besides the time `_us` (microseconds), never NULL
  fields   {output column: type name}
  mark     the output column that dates a row of output, for telling the two sides of a cut apart
  run(state, cols) -> (state, {field: values})    cols: numpy arrays in time order
  finish(state) -> {field: values}                what is still owed after the last row
  cut_off(state) -> {field: values}               what is owed when the next row is a cut
  cut(cols) -> index or None                      first cut of a slice
  outline(cols) -> JSON value                     what `enter` needs to know of a slice
  enter(state, outline) -> (state, silent)        exit state from an entry state; whether the slice surely emits nothing
States and outlines are JSON values; None is the fresh state.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ordered import SLICE, Slicing
from wayfold.session import materialise

US = "_us"
ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
FRESH = "null"


def fold(df: DataFrame, keys: list[str], ts: str, tie: list[str], kernel, slicing: Slicing) -> DataFrame:
    """Run `kernel` over every key of df in (ts, *tie) order; returns keys + kernel.fields."""
    rows = slicing.attach(df, keys, ts).select(
        *keys,
        SLICE,
        F.unix_micros(F.col(ts).cast("timestamp")).alias(US),
        *[c for c in kernel.columns if c not in keys],
        *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)],
    )
    key_ddl = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    fields = [f"{name} {kind}" for name, kind in kernel.fields.items()]
    if slicing.whole:
        placed = _place(rows, keys, len(tie)).select(*keys, US, *kernel.columns)
        return placed.mapInArrow(_whole_scan(keys, kernel), ", ".join(key_ddl + fields))

    bookkeeping = [f"{SLICE} bigint", "_entry string", "_exit string", "_outline string", "_cut bigint"]
    scan_ddl = ", ".join(key_ddl + bookkeeping + fields)
    plan_ddl = ", ".join(key_ddl + [f"{SLICE} bigint", "_entry string", "_exit string", "_cut bigint", "_action string"])
    group = [*keys, SLICE]
    blank = {"_entry": F.lit(None).cast("string"), "_cut": F.lit(None).cast("bigint")}

    def scan(part):
        placed = _place(part, keys, len(tie)).select(*group, "_entry", "_cut", US, *kernel.columns)
        return materialise(placed.mapInArrow(_slice_scan(keys, kernel), scan_ddl))

    first = scan(rows.withColumns(blank))
    states = first.filter("_exit is not null").select(*group, "_exit", "_outline", "_cut")
    placed = states.repartition(*keys).sortWithinPartitions(*group)
    plan = materialise(placed.mapInArrow(_chain_scan(keys, kernel), plan_ddl))
    pending = plan.filter("_action = 'run'").select(*group, "_entry", "_cut")
    again = rows.join(pending.select(*group, "_cut"), group)
    again = again.filter(F.col("_cut").isNull() | (F.col(US) < F.col("_cut"))).drop("_cut")
    second = scan(again.withColumns(blank).unionByName(_entry_rows(pending, rows)))
    rows_of = lambda done: done.filter("_exit is null").select(*group, *kernel.fields)
    changed = plan.filter("_action <> 'keep'").withColumn("_cut", F.when(F.col("_action") == "run", F.col("_cut")))
    out = _without(rows_of(first), changed, group, kernel.mark).unionByName(rows_of(second))
    final = plan.groupBy(*keys).agg(F.max_by("_exit", SLICE).alias("_exit"))
    owed = final.mapInArrow(_finish_scan(keys, kernel), ", ".join(key_ddl + fields))
    return out.drop(SLICE).unionByName(owed)


def _without(out, changed, group, mark):
    """Output that a rerun does not replace: other slices, and what lies past a slice's cut."""
    changed = changed.select(*group, F.coalesce("_cut", F.lit(2**62)).alias("_upto"))
    kept = F.col("_upto").isNull() | (F.col(mark) >= F.col("_upto"))
    return out.join(changed, group, "left").filter(kept).drop("_upto")


def _place(rows, keys, ties):
    """Co-locate each (key, slice) and order it by time; a leading entry row sorts first."""
    order = [US] + [f"_tie{i}" for i in range(ties)]
    entry = [F.col("_entry").desc_nulls_last()] if "_entry" in rows.columns else []
    return rows.repartition(*keys, SLICE).sortWithinPartitions(*keys, SLICE, *entry, *order)


def _entry_rows(pending, rows):
    """One row per slice to rerun, carrying the state it starts from and where to stop."""
    zero = {"string": F.lit(""), "boolean": F.lit(False)}
    filler = [
        zero.get(f.dataType.simpleString(), F.lit(0)).cast(f.dataType).alias(f.name)
        for f in rows.schema
        if f.name not in pending.columns
    ]
    return pending.select("*", *filler)


def _groups(batches, by):
    """Consecutive groups of a sorted stream of Arrow batches as (key, {column: array})."""
    held_key, held = None, []
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        changed = np.zeros(n, dtype=bool)
        for k in by:
            changed[1:] |= cols[k][1:] != cols[k][:-1]
        edges = [0, *np.flatnonzero(changed).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            key = tuple(cols[k][a] for k in by)
            if held and key != held_key:
                yield held_key, _joined(held)
                held = []
            held_key = key
            held.append({c: v[a:b] for c, v in cols.items()})
    if held:
        yield held_key, _joined(held)


def _joined(parts):
    if len(parts) == 1:
        return parts[0]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


class _Writer:
    """Collects output rows and hands them back as Arrow batches."""

    def __init__(self, names, types, limit=20_000):
        self.names, self.types, self.limit = names, types, limit
        self.clear()

    def clear(self):
        self.data = {n: [] for n in self.names}
        self.size = 0

    def add(self, count, **values):
        for name in self.names:
            value = values.get(name)
            self.data[name].extend(value if isinstance(value, (list, np.ndarray)) else [value] * count)
        self.size += count

    def full(self):
        return self.size >= self.limit

    def take(self):
        arrays = [pa.array(self.data[n], type=t) for n, t in zip(self.names, self.types)]
        batch = pa.RecordBatch.from_arrays(arrays, names=self.names)
        self.clear()
        return batch


def _peeked(batches, keys):
    """The first non-empty batch tells the Arrow types of the keys."""
    batches = iter(batches)
    for first in batches:
        if first.num_rows:
            types = [first.schema.field(k).type for k in keys]

            def chained():
                yield first
                yield from batches

            return types, chained()
    return None, ()


def _count(out):
    return len(next(iter(out.values()))) if out else 0


def _whole_scan(keys, kernel):
    def run(batches):
        key_types, stream = _peeked(batches, keys)
        if key_types is None:
            return
        writer = _Writer([*keys, *kernel.fields], key_types + [ARROW[t] for t in kernel.fields.values()])
        for key, cols in _groups(stream, keys):
            state, out = kernel.run(None, cols)
            for part in (out, kernel.finish(state)):
                if _count(part):
                    writer.add(_count(part), **dict(zip(keys, key)), **part)
            if writer.full():
                yield writer.take()
        yield writer.take()

    return run


def _slice_scan(keys, kernel):
    by = [*keys, SLICE]
    book = ["_entry", "_exit", "_outline", "_cut"]

    def run(batches):
        key_types, stream = _peeked(batches, by)
        if key_types is None:
            return
        types = key_types + [pa.string()] * 3 + [pa.int64()] + [ARROW[t] for t in kernel.fields.values()]
        writer = _Writer([*by, *book, *kernel.fields], types)
        for key, cols in _groups(stream, by):
            at = dict(zip(by, key))
            entry, upto = cols.pop("_entry")[0], cols.pop("_cut")[0]
            if entry is not None:
                cols = {c: v[1:] for c, v in cols.items()}
            if entry is not None:
                state, out = json.loads(entry), {}
                if len(cols[US]):
                    state, out = kernel.run(state, cols)
                # Rows before a cut: what follows is known already. A slice without one ends in a state that is known.
                before_cut = upto is not None and upto == upto
                parts = (out, kernel.cut_off(state)) if before_cut else (out,)
            else:
                state, out = kernel.run(None, cols)
                cut, parts = kernel.cut(cols), (out,)
                writer.add(
                    1,
                    **at,
                    _entry=FRESH,
                    _exit=json.dumps(state),
                    _outline=json.dumps(kernel.outline(cols)),
                    _cut=None if cut is None else int(cols[US][cut]),
                )
            for part in parts:
                if _count(part):
                    writer.add(_count(part), **at, **part)
            if writer.full():
                yield writer.take()
        yield writer.take()

    return run


def _chain_scan(keys, kernel):
    """Walk the slice outlines of each key in order: the state every slice starts from, and what it still needs."""
    names = [*keys, SLICE, "_entry", "_exit", "_cut", "_action"]

    def run(batches):
        held, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            entries, exits, actions = [], [], []
            columns = [batch.column(k).to_pylist() for k in (*keys, "_exit", "_outline")]
            for *key, known, outline in zip(*columns):
                if key != held:
                    held, state = key, None
                entries.append(json.dumps(state))
                if state is None:
                    state, action = json.loads(known), "keep"
                else:
                    state, silent = kernel.enter(state, json.loads(outline))
                    action = "skip" if silent else "run"
                exits.append(json.dumps(state))
                actions.append(action)
            kept = [batch.column(k) for k in (*keys, SLICE)]
            new = [pa.array(x, pa.string()) for x in (entries, exits)]
            yield pa.RecordBatch.from_arrays([*kept, *new, batch.column("_cut"), pa.array(actions, pa.string())], names=names)

    return run


def _finish_scan(keys, kernel):
    def run(batches):
        key_types, stream = _peeked(batches, keys)
        if key_types is None:
            return
        writer = _Writer([*keys, *kernel.fields], key_types + [ARROW[t] for t in kernel.fields.values()])
        for batch in stream:
            for row in batch.to_pylist():
                out = kernel.finish(json.loads(row["_exit"]))
                if _count(out):
                    writer.add(_count(out), **{k: row[k] for k in keys}, **out)
            yield writer.take()

    return run
