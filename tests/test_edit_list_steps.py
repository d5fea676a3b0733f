"""The edit list's steps are written apart, so that no task sorts for several joins of a track at once."""

from __future__ import annotations

from pulsegrid.operators import segments
from pulsegrid.plans import edit_list


def test_one_join_a_step(spark):
    beats = spark.createDataFrame([(1, k, k * 0.5) for k in range(12)] + [(2, 0, 9.0), (2, 1, 9.5)], "track_id long, beat_idx long, t double")
    chosen = spark.createDataFrame([(1, 6.0, 1.0, -1.0), (2, 10.0, 0.0, 10.0)], "track_id long, duration double, sel_start double, sel_end double")
    rows = segments.classify_gaps(edit_list.thin_beats(beats, chosen, rate=1))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" not in plan
    got = {(r.track_id, r.beat_idx): (r.kind, round(r.t, 6), round(r.dur, 6)) for r in rows.collect()}
    assert got[1, 0] == ("BEAT", 0.0, 1.0) and got[1, 4] == ("BEAT", 4.0, 1.0) and len(got) == 7
    assert got[2, -1] == ("INTRO", 0.0, 9.0) and got[2, 0] == ("BEAT", 9.0, 1.0)
