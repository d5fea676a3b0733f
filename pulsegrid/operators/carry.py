"""Sequential decisions with a small carried state, solved chunk by chunk.

Some operators depend on their own previous output (the last peak kept, the last beat
matched, the next clip in a cycle). A task that walked a whole track would not scale, so
each chunk first states what it would do for every possible entry state, these short
tables are chained in two levels, and each chunk then runs once with its real entry state.
Tracks that fit in one chunk skip all but the last step.

Chunks are processed as sorted runs inside large partitions, many per Arrow batch, so a
million short tracks cost little more than one long one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators.sequence import run_starts
from pulsegrid.session import stage

NONE = -1.0  # "nothing carried in"; positions and cycle pointers are never negative
LINKS = 512  # chunks chained per task and level

Run = dict[str, np.ndarray]


def map_runs(df: DataFrame, runs: Sequence[str], order: Sequence[str], keep: Sequence[str], fn: Callable[[Run], Run], schema: T.StructType) -> DataFrame:
    """Apply ``fn`` to each group of ``runs`` columns, rows sorted by ``order``.

    Output rows carry the ``keep`` columns of their run followed by what ``fn`` returns.
    Only one unfinished run is held while batches stream through.
    """
    runs, keep = list(runs), list(keep)
    fields = [df.schema[k] for k in keep] + list(schema.fields)
    made = [f.name for f in schema.fields]

    def finish(table: pa.Table, starts: np.ndarray, stop: int) -> pa.RecordBatch | None:
        batch = table.slice(0, stop).combine_chunks()
        columns = {n: batch.column(n).to_numpy() for n in batch.column_names}
        outs, first = [], []
        for a, b in zip(starts, [*starts[1:], stop]):
            out = fn({n: c[a:b] for n, c in columns.items()})
            outs.append(out)
            first.append(np.full(len(out[made[0]]), a))
        take = pa.array(np.concatenate(first).astype(np.int64))
        if len(take) == 0:
            return None
        arrays = [batch.column(k).take(take).combine_chunks() for k in keep]
        for f in schema.fields:
            arrays.append(pa.array(np.concatenate([o[f.name] for o in outs]), type=_ARROW[f.dataType.typeName()]))
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.RecordBatch.from_arrays(arrays, names=keep + made)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            starts = run_starts(held, runs)
            if len(starts) > 1:
                out = finish(held, starts[:-1], int(starts[-1]))
                held = held.slice(int(starts[-1]))
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out = finish(held, run_starts(held, runs), held.num_rows)
            if out is not None:
                yield out

    # by a hash of the keys: Spark drops a deal by the very keys of a join before it, and a join may then split what must stay together
    dealt = df.repartition(F.xxhash64(*runs)).sortWithinPartitions(*runs, *order)
    return dealt.mapInArrow(stream, T.StructType(fields))


_ARROW = {"long": pa.int64(), "double": pa.float64()}


def _tables(order: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> list[tuple[int, dict[float, float]]]:
    """(chunk, {entry: exit}) for rows sorted by chunk."""
    cuts = np.flatnonzero(np.diff(order)) + 1
    parts = zip(np.split(order, cuts), np.split(entry, cuts), np.split(leave, cuts))
    return [(int(o[0]), dict(zip(e.tolist(), x.tolist()))) for o, e, x in parts]


def _follow(state: float, tables: list[tuple[int, dict[float, float]]], linear: bool) -> tuple[float, list[int], list[float]]:
    """Chain chunk tables; an entry a chunk does not list is out of its reach."""
    chunks, states = [], []
    for chunk, options in tables:
        if linear:
            chunks.append(chunk)
            states.append(state)
            state = float(apply_pieces(np.array(list(options)), np.array(list(options.values())), state))
            continue
        if state not in options:
            state = NONE
        chunks.append(chunk)
        states.append(state)
        state = options[state]
    return state, chunks, states


def apply_pieces(x: np.ndarray, y: np.ndarray, p: np.ndarray | float) -> np.ndarray:
    """Value of a function given by breakpoints: constant before the first, slope 1 after the last."""
    return np.where(np.asarray(p) >= x[-1], y[-1] + (np.asarray(p) - x[-1]), np.interp(p, x, y))


def compose_pieces(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints of f2(f1(p)) for non-decreasing f1, f2 whose slopes are 0 or 1."""
    i = np.searchsorted(y1, x2, side="right") - 1  # last breakpoint of f1 at or below the wanted value
    back = x1[np.maximum(i, 0)] + (x2 - y1[np.maximum(i, 0)])
    x = np.unique(np.concatenate([x1, back[i >= 0]]))
    y = apply_pieces(x2, y2, apply_pieces(x1, y1, x))
    left = np.diff(y) / np.diff(x)
    bend = np.concatenate([[0.0], left]) != np.concatenate([left, [1.0]])
    bend[-1] |= not bend.any()
    return x[bend], y[bend]


def carry_scan(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    order: Sequence[str],
    initial: float,
    summarise: Callable[[Run], list[tuple[float, float]]],
    emit: Callable[[Run, float], Run],
    schema: T.StructType,
    linear: bool = False,
) -> DataFrame:
    """Run ``emit(chunk_rows, entry_state)`` for every (keys, ``_chunk``) of ``rows``.

    ``summarise(chunk_rows)`` lists ``(entry, exit)`` pairs and must include ``NONE`` and,
    for the first chunk, ``initial``. With ``linear`` the pairs are breakpoints of a function
    of the entry state instead (see ``apply_pieces``). ``emit`` returns the columns of ``schema``.
    """
    keys = list(keys)
    rows = stage(rows, "carry-rows")
    spans = rows.groupBy(*keys).agg(F.min("_chunk").alias("_lo"), F.max("_chunk").alias("_hi"))
    several = spans.filter("_lo < _hi").select(*keys)
    if several.isEmpty():
        entered = rows.withColumn("_state", F.lit(initial))
    else:
        entries = _chunk_entries(rows.join(several, keys), keys, order, initial, summarise, linear)
        entered = rows.join(entries, [*keys, "_chunk"], "left").withColumn("_state", F.coalesce("state", F.lit(initial))).drop("state")
    return map_runs(entered, [*keys, "_chunk"], order, keys, lambda run: emit(run, float(run["_state"][0])), schema)


def _chunk_entries(
    rows: DataFrame, keys: list[str], order: Sequence[str], initial: float, summarise: Callable[[Run], list[tuple[float, float]]], linear: bool
) -> DataFrame:
    """(keys, _chunk, state) for tracks of several chunks."""
    entry, leave = T.StructField("entry", T.DoubleType()), T.StructField("exit", T.DoubleType())
    chunk, state = T.StructField("_chunk", T.LongType()), T.StructField("state", T.DoubleType())

    def per_chunk(run: Run) -> Run:
        pairs = list(dict(summarise(run)).items())
        return {"entry": np.array([e for e, _ in pairs], dtype=float), "exit": np.array([x for _, x in pairs], dtype=float)}

    links = map_runs(rows, [*keys, "_chunk"], order, [*keys, "_chunk"], per_chunk, T.StructType([entry, leave]))
    links = stage(links.withColumn("_link", F.expr(f"_chunk div {LINKS}")), "carry-links")

    def per_link(run: Run) -> Run:
        tables = _tables(run["_chunk"], run["entry"], run["exit"])
        if linear:
            x, y = np.array(list(tables[0][1])), np.array(list(tables[0][1].values()))
            for _, options in tables[1:]:
                x, y = compose_pieces(x, y, np.array(list(options)), np.array(list(options.values())))
            return {"entry": x, "exit": y}
        starts = list(tables[0][1])
        return {"entry": np.array(starts, dtype=float), "exit": np.array([_follow(e, tables, False)[0] for e in starts], dtype=float)}

    def walk_links(run: Run) -> Run:
        _, at, states = _follow(initial, _tables(run["_link"], run["entry"], run["exit"]), linear)
        return {"_link": np.array(at, dtype=np.int64), "state": np.array(states, dtype=float)}

    def walk_chunks(run: Run) -> Run:
        _, at, states = _follow(float(run["state"][0]), _tables(run["_chunk"], run["entry"], run["exit"]), linear)
        return {"_chunk": np.array(at, dtype=np.int64), "state": np.array(states, dtype=float)}

    joined = map_runs(links, [*keys, "_link"], ["_chunk", "entry"], [*keys, "_link"], per_link, T.StructType([entry, leave]))
    link_entries = map_runs(joined, keys, ["_link", "entry"], keys, walk_links, T.StructType([T.StructField("_link", T.LongType()), state]))
    placed = links.join(link_entries, [*keys, "_link"])
    return map_runs(placed, [*keys, "_link"], ["_chunk", "entry"], keys, walk_chunks, T.StructType([chunk, state]))


def next_allowed(at: np.ndarray, gap: float) -> np.ndarray:
    """For each position the index of the first later one at least ``gap`` away."""
    nxt = np.maximum(np.searchsorted(at, at + gap, side="left"), np.arange(len(at)) + 1)
    # at + gap rounds; settle the comparison the operator defines: at[j] - at[i] >= gap
    while True:
        early = (nxt - 1 > np.arange(len(at))) & (at[nxt - 1] - at >= gap)
        if not early.any():
            break
        nxt[early] -= 1
    while True:
        inside = nxt < len(at)
        late = inside & (at[np.minimum(nxt, len(at) - 1)] - at < gap)
        if not late.any():
            return nxt
        nxt[late] += 1


def _first_own(at: np.ndarray, own: int, last: float, gap: float) -> int:
    if last == NONE:
        return own
    ahead = np.flatnonzero(at[own:] - last >= gap)
    return own + int(ahead[0]) if len(ahead) else len(at)


def minimum_gap(
    candidates: DataFrame,
    keys: Sequence[str],
    idx: str,
    at: str,
    gap: float,
    *,
    reach: int,
    initial: float | None = None,
    size: int = 65_536,
) -> DataFrame:
    """Keep a candidate only if it lies at least ``gap`` after the last one kept.

    ``at`` is the position compared (frames or seconds), ``idx`` the frame number used for
    chunking and ``reach`` a number of frames that covers ``gap``. ``initial`` is the
    position treated as kept before the first candidate (``None``: nothing).
    """
    if reach > size:
        raise ValueError("reach must fit in a chunk")
    start = NONE if initial is None else float(initial)
    home = F.expr(f"{idx} div {size}")
    rows = candidates.select(*keys, F.col(idx).cast("long").alias("_i"), F.col(at).cast("double").alias("_at"), home.alias("_home"))
    rows = rows.withColumn(
        "_chunk",
        F.explode(F.array_compact(F.array(F.col("_home"), F.when(F.col("_i") % size >= size - reach, F.col("_home") + 1)))),
    )

    def split(run: Run) -> tuple[np.ndarray, np.ndarray, int]:
        return run["_i"], run["_at"], int((run["_home"] < run["_chunk"]).sum())

    def summarise(run: Run) -> list[tuple[float, float]]:
        _, pos, own = split(run)
        nxt = next_allowed(pos, gap)
        last = np.arange(len(pos))
        for i in range(len(pos) - 1, own - 1, -1):
            if nxt[i] < len(pos):
                last[i] = last[nxt[i]]
        entries = [NONE, *pos[:own].tolist()]
        if start != NONE and run["_chunk"][0] == 0:
            entries.append(start)
        table = []
        for entry in entries:
            first = _first_own(pos, own, entry, gap)
            table.append((entry, float(pos[last[first]]) if first < len(pos) else entry))
        return table

    def emit(run: Run, entry: float) -> Run:
        index, pos, own = split(run)
        nxt = next_allowed(pos, gap).tolist()
        keep, i = [], _first_own(pos, own, entry, gap)
        while i < len(pos):
            keep.append(i)
            i = nxt[i]
        return {idx: index[keep], at: pos[keep]}

    out = T.StructType([T.StructField(idx, T.LongType()), T.StructField(at, T.DoubleType())])
    return carry_scan(rows, keys, order=["_i"], initial=start, summarise=summarise, emit=emit, schema=out)
