import itertools

import pytest
from conftest import at

from wayfold.operators.load import resolve_stop_log
from wayfold.sources import stoplog
from wayfold.sources.snapshots import Conflict, latest
from wayfold.sources.tables import children

DAY = 86_400


def report(i, seq, arrived=0, departed=None, lat=49.0):
    return (i, "v", at(arrived), None if departed is None else at(departed), lat, -123.0, at(seq), seq)


LOADS = [
    [report("a", 0), report("b", 0, 10, 20)],
    [report("a", 1, 0, 50, 50.0), report("c", 1, DAY)],
    [report("a", 2, 0, 99, 51.0), report("c", 2, DAY, DAY + 5), report("d", 2, 2 * DAY)],
    # The first report of d, of another day, in a load of an early place that is stored late.
    [report("d", 1, 0, 7, 48.0), report("b", 3, 10, None)],
]


@pytest.fixture
def folders(tmp_path):
    return f"{tmp_path}/log", f"{tmp_path}/state"


def put(spark, log, number, rows, name=None):
    spark.createDataFrame(rows, stoplog.STOP_LOG).write.mode("overwrite").parquet(f"{log}/load={name or number}")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("id", "arrived_at", "departed_at", "lat").collect())


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::5])
def test_any_order_of_loads_and_compactions_gives_what_the_whole_log_gives(spark, folders, order):
    log, state = folders
    whole = resolve_stop_log(spark.createDataFrame(sum(LOADS, []), stoplog.STOP_LOG))
    for step, number in enumerate(order):
        put(spark, log, number, LOADS[number])
        if step in (0, 2):
            assert stoplog.compact(spark, log, state) == 1 + step // 2
    assert rows_of(stoplog.read_stops(spark, log, state)) == rows_of(whole)
    # A load stored again after it was folded changes nothing, compacted or not.
    put(spark, log, order[0], LOADS[order[0]])
    assert rows_of(stoplog.read_stops(spark, log, state)) == rows_of(whole)
    stoplog.compact(spark, log, state)
    assert stoplog.compact(spark, log, state) == 0
    assert rows_of(stoplog.read_stops(spark, log, state)) == rows_of(whole)


def test_compaction_rewrites_only_dates_on_which_a_stop_changes(spark, folders):
    log, state = folders
    put(spark, log, 0, LOADS[1] + [report("e", 1, 0)])
    stoplog.compact(spark, log, state)
    before = latest(spark, state).tables["stops"]
    put(spark, log, 1, [report("c", 5, DAY, DAY + 9), report("f", 5, 3 * DAY)])
    stoplog.compact(spark, log, state)
    after = latest(spark, state).tables["stops"]
    assert [before[d] == after[d] for d in sorted(before)] == [True, False] and len(after) == 3
    # Folders of the commit before are gone, those of the last one wait for its readers.
    assert children(spark, log) == ["load=1"]


def test_a_reader_that_began_before_a_commit_and_a_second_compaction(spark, folders, monkeypatch):
    log, state = folders
    put(spark, log, 0, LOADS[0])
    early = stoplog.read_stops(spark, log, state)
    real = stoplog.commit

    def other_first(*args):
        real(*args)
        return real(*args)

    monkeypatch.setattr(stoplog, "commit", other_first)
    with pytest.raises(Conflict):
        stoplog.compact(spark, log, state)
    assert rows_of(early) == rows_of(stoplog.read_stops(spark, log, state)) and early.count() == 2


def test_nothing_stored_and_loads_cut_off(spark, folders, tmp_path):
    log, state = folders
    assert stoplog.compact(spark, log, state) == 0
    assert stoplog.read_stops(spark, log, state).count() == 0
    put(spark, log, 0, LOADS[0])
    (tmp_path / "log" / "load=0" / "_SUCCESS").unlink()
    assert stoplog.compact(spark, log, state) == 0 and stoplog.read_stops(spark, log, state).count() == 0
    put(spark, log, 1, [])
    assert stoplog.compact(spark, log, state) == 1 and stoplog.read_stops(spark, log, state).count() == 0


def test_rows_of_the_state_are_not_regrouped_by_a_read(spark, folders):
    log, state = folders
    put(spark, log, 0, LOADS[1])
    stoplog.compact(spark, log, state)
    put(spark, log, 1, LOADS[0])
    plan = stoplog.read_stops(spark, log, state)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti, BuildRight" in plan and "LeftSemi, BuildRight" in plan
