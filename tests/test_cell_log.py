"""Put, skip, clear and compaction of cells against a dictionary of states."""

import random

import pytest

from skylattice.operators.cell_log import CellLog


def rows(spark, events):
    return spark.createDataFrame([(k, c, op, body, i) for i, (k, c, op, body) in enumerate(events)], "kind string, cell long, op string, body string, seq long")


def held(log):
    return {(r.kind, r.cell): (r.body if r.cached else None, r.skipped, r.reason) for r in log.state().collect()}


def test_states_of_a_cell(spark, tmp_path):
    log = CellLog(spark, f"file://{tmp_path}/a")
    assert held(log) == {}
    steps = [("put", "1"), ("skip", "too large"), ("put", "2"), ("clear", None), ("skip", "gone"), ("put", "3")]
    want = [("1", False, None), ("1", True, "too large"), ("2", True, "too large"), ("2", False, None), ("2", True, "gone"), ("3", True, "gone")]
    for (op, body), state in zip(steps, want):
        log.append(rows(spark, [("osm", 7, op, body)]))
        assert held(log) == {("osm", 7): state}
    log.append(rows(spark, [("osm", 8, "skip", ""), ("osm", 9, "skip", "x"), ("osm", 9, "clear", None)]))
    assert held(log) == {("osm", 7): want[-1], ("osm", 8): (None, True, "")}


def test_compaction_changes_no_state(spark, tmp_path):
    r, log, model = random.Random(3), CellLog(spark, f"file://{tmp_path}/b"), {}
    for wave in range(6):
        events = [(r.choice("ab"), r.randrange(8), r.choice(["put", "skip", "clear"]), str(r.randrange(100))) for _ in range(25)]
        for kind, cell, op, body in events:
            at = model.setdefault((kind, cell), [None, False, None])
            if op == "put":
                at[0] = body
            else:
                at[1:] = [op == "skip", body if op == "skip" else None]
        log.append(rows(spark, events))
        if wave % 2:
            log.compact()
            assert len(log.folders()) == 1
        assert held(log) == {k: tuple(v) for k, v in model.items() if v[0] is not None or v[1]}
    log.compact()


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    log = CellLog(spark, f"file://{tmp_path}/c")
    log.append(rows(spark, [("a", 1, "put", "x")]))
    with pytest.raises(FileExistsError):
        log._commit(log.events(), "e000000000001")
    assert len(log.folders()) == 1 and len(held(log)) == 1
