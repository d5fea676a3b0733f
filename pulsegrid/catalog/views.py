"""SQL twins of the stand-in views, as common table expressions."""

from __future__ import annotations

VIEWS = {
    "ev": "SELECT user_id AS track_id, event_id, event_type AS stem, value, "
    "(epoch_us(ts) - 1704067200000000) / 1e6 / 76800.0 AS t FROM events",
    "beats": "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS beat_idx, t FROM ev",
    "stem_beats": "SELECT track_id, stem, row_number() OVER (PARTITION BY track_id, stem ORDER BY t, event_id) - 1 AS beat_idx, t FROM ev",
    "samples": "SELECT event_type AS track_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, "
    "(value - 50) / 500 AS v FROM events",
    "frames": "SELECT CAST(label AS BIGINT) AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, "
    "CAST(embedding AS DOUBLE[]) AS x FROM embeddings",
    "tracks": "SELECT track_id, max(t) + 1.0 AS duration FROM ev GROUP BY track_id",
    "clips": "SELECT row_number() OVER (ORDER BY path) - 1 AS clip_id, path, duration, copies FROM ("
    "SELECT format('clips/{}_{:02d}.mp4', lower(p_type), p_size) AS path, CAST(p_size AS DOUBLE) / 10.0 AS duration, count(*) AS copies "
    "FROM part GROUP BY p_type, p_size)",
    "regions": "SELECT o_custkey // 10 AS track_id, o_orderkey AS region_id, o_orderpriority AS effect, "
    "CAST(o_orderkey % 30 AS DOUBLE) AS start_s, CAST(o_orderkey % 30 AS DOUBLE) + 1.0 + (o_orderkey % 5) AS end_s, "
    "o_orderstatus <> 'P' AS enabled FROM orders",
    "truth": "SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t, beat_idx) - 1 AS truth_idx, t FROM ("
    "SELECT track_id, beat_idx, t + (CAST(0.01 AS DOUBLE) + CAST(0.02 AS DOUBLE) * (beat_idx % 3)) AS t FROM beats)",
}
NEEDS = {"beats": ["ev"], "stem_beats": ["ev"], "tracks": ["ev"], "truth": ["beats"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named views and what they depend on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in NEEDS.get(name, []):
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in ordered]
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = body[5:]
        ctes.append(body)
        text = ",\n".join(ctes)
    else:
        text = ",\n".join(ctes) + "\n" + body if ctes else body
    if not ctes:
        return text
    return ("WITH RECURSIVE " if recursive else "WITH ") + text


def r(expr: str, digits: int = 6) -> str:
    """Rounding twin of ``functions.rounding.rnd``."""
    shifted = f"round(({expr}) + 3.7e-10, {digits})"
    return f"CASE WHEN {shifted} = 0 THEN 0.0 ELSE {shifted} END"
