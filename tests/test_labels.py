import pytest

from conftest import at
from gaugeflow.operators.intervals import count_in_intervals, match_intervals
from gaugeflow.operators.labels import label_minutes
from gaugeflow.session import local_table
from gaugeflow.sources.failures import failure_table

HOUR, DAY, TICK = 60, 1440, 1 / 60e6
START, END = 10 * DAY, 10 * DAY + 300


def rows_at(spark, *minutes, asset=0):
    return local_table(spark, [(asset, at(m)) for m in minutes],
                       "asset_id int, minute_timestamp timestamp_ntz")


def failures(spark, *spans, asset=0):
    return failure_table(spark, [(asset, i + 1, "kind", "part", at(a), at(b))
                                 for i, (a, b) in enumerate(spans)])


def labelled(spark, minutes, spans, limit):
    out = label_minutes(rows_at(spark, *minutes), failures(spark, *spans), broadcast_rows=limit)
    return {r["minute_timestamp"]: r for r in out.collect()}


EDGES = [START - DAY - 1, START - DAY, START - 6 * HOUR - TICK, START - 6 * HOUR, START - TICK,
         START, START + TICK, END, END + TICK, END + DAY, END + DAY + 1, END + 30 * DAY]


def check_edges(r):
    at_ = lambda m, name: r[at(m)][name]
    assert [at_(m, "failure_active") for m in (START - TICK, START, END, END + TICK)] == [0, 1, 1, 0]
    assert [at_(m, "failure_next_6h") for m in
            (START - 6 * HOUR - TICK, START - 6 * HOUR, START - TICK, START)] == [0, 1, 1, 0]
    assert [at_(m, "failure_next_24h") for m in (START - DAY - 1, START - DAY)] == [0, 1]
    assert [at_(m, "post_failure_24h") for m in
            (END, END + TICK, END + DAY, END + DAY + 1)] == [0, 1, 1, 0]
    assert at_(START - DAY, "hours_to_next_failure") == 24.0
    assert at_(END + 30 * DAY, "hours_to_next_failure") is None
    assert [at_(m, "eligible_for_model") for m in
            (START - TICK, START, END + TICK, END + DAY + 1)] == [1, 0, 0, 1]


def test_label_bounds_by_broadcast(spark):
    check_edges(labelled(spark, EDGES, [(START, END)], 100))


def test_label_bounds_by_scan(spark):
    check_edges(labelled(spark, EDGES, [(START, END)], 0))


@pytest.mark.parametrize("limit", [0, 100])
def test_unknown_assets_match_nothing(spark, limit):
    rows = rows_at(spark, 120, asset=None).unionByName(rows_at(spark, 120))
    table = local_table(spark, [(a, at(100), at(200)) for a in (None, 0)],
                        "asset_id int, start_time timestamp_ntz, end_time timestamp_ntz")
    found = {r["asset_id"]: r for r in label_minutes(rows, table, broadcast_rows=limit).collect()}
    assert (found[0]["failure_active"], found[None]["failure_active"]) == (1, 0)
    assert found[None]["eligible_for_model"] == 1 and found[None]["hours_to_next_failure"] is None


def test_both_ways_agree_on_overlapping_failures(spark):
    minutes = list(range(0, 6 * DAY, 37)) + [100, 2000]
    spans = [(100, 4000), (100, 150), (2000, 2100), (3990, 4400), (6500, 6500), (7000, 8000)]
    one = labelled(spark, minutes, spans, 100)
    other = labelled(spark, minutes, spans, 0)
    assert one == other
    assert one[at(100)]["failure_active"] == 1


def test_nearest_of_two_coming_failures(spark):
    r = labelled(spark, [0], [(300, 310), (120, 130)], 100)
    assert r[at(0)]["hours_to_next_failure"] == 2.0


def test_interval_join_ways_agree(spark):
    rows = rows_at(spark, *range(0, 5000, 7))
    spans = failures(spark, (0, 700), (699, 701), (4000, 9000), (6000, 7000), (100, 100))
    for include in (True, False):
        both = [sorted((r["event_id"], r["minute_timestamp"]) for r in match_intervals(
            rows, spans.select("asset_id", "event_id", "start_time", "end_time"), "start_time",
            "end_time", include_high=include, broadcast_rows=limit).collect())
            for limit in (100, 0)]
        assert both[0] == both[1] and len(set(both[0])) == len(both[0])
        expected = sum(a <= m <= b if include else a <= m < b for m in range(0, 5000, 7)
                       for a, b in ((0, 700), (699, 701), (4000, 9000), (6000, 7000), (100, 100)))
        assert len(both[0]) == expected


def test_empty_interval_counts_zero(spark):
    rows = rows_at(spark, 5, 6)
    out = count_in_intervals(rows, failures(spark, (0, 6), (50, 60)), "start_time", "end_time",
                             ["event_id"]).collect()
    assert {r["event_id"]: r["observations"] for r in out} == {1: 2, 2: 0}


def test_unknown_and_reversed_bounds_both_ways(spark):
    spans = local_table(spark, [
        (0, None, at(500)), (0, at(3000), None), (0, at(9000), at(8000)), (0, None, None)],
        "asset_id int, start_time timestamp_ntz, end_time timestamp_ntz")
    minutes = [0, 499, 500, 501, 1900, 2900, 2999, 3000, 3001, 8500, 8999, 9001, 12000]
    rows = rows_at(spark, *minutes).unionByName(local_table(
        spark, [(0, None)], "asset_id int, minute_timestamp timestamp_ntz"))
    both = []
    for limit in (100, 0):
        out = label_minutes(rows, spans, broadcast_rows=limit).collect()
        both.append({r["minute_timestamp"]: r for r in out})
    assert both[0] == both[1] and len(both[0]) == len(minutes) + 1
    found = both[0]
    assert all(r["failure_active"] == 0 for r in found.values())
    assert [found[at(m)]["post_failure_24h"] for m in (499, 500, 501, 1900, 2000 - 60)
            if at(m) in found] == [0, 0, 1, 1]
    assert found[at(2900)]["failure_next_6h"] == 1 and found[at(3000)]["failure_next_6h"] == 0
    assert found[None]["failure_next_24h"] == 0 and found[None]["hours_to_next_failure"] is None
