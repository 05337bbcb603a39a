"""A causal tracker: boxes of a stream get the id of their track and its hits so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxfusion.operators.tracking import DEFAULT_GATE, greedy_pairs
from boxfusion.schemas import TRACK_GATES


def track_stream(boxes: DataFrame, scene: str = "scene_token", frame: str = "frame_idx", class_col: str = "class_name", order: tuple[str, ...] = ("box_pos",), gate: float | dict[str, float] | None = None, max_misses: int = 1) -> DataFrame:
    """``boxes`` with track_id and hits.  A batch must hold a frame whole, and frames of a scene must
    come in order; state is the open tracks of one class of one scene."""
    gates = TRACK_GATES if gate is None else gate
    by = [frame, *order]
    fields = [(f.name, f.dataType.simpleString()) for f in boxes.schema]

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh, flat = (state.get if state.exists else (0, []))
        active = [list(flat[k : k + 5]) for k in range(0, len(flat), 5)]  # x, y, last frame, id, hits
        g = pd.concat(list(groups)).sort_values(by, kind="stable")
        reach = gates.get(str(key[1]), DEFAULT_GATE) if isinstance(gates, dict) else gates
        ids, hits = [], []
        for now, part in g.groupby(frame, sort=True):
            active = [t for t in active if now - t[2] <= max_misses + 1]
            places = list(zip(part["x"], part["y"], strict=True))
            taken = {d: t for t, d in greedy_pairs([(t[0], t[1]) for t in active], places, reach)}
            for d, (x, y) in enumerate(places):
                if d in taken:
                    t = active[taken[d]]
                    t[:3], t[4] = [x, y, now], t[4] + 1
                else:
                    active.append(t := [x, y, now, fresh, 1])
                    fresh += 1
                ids.append(int(t[3]))
                hits.append(int(t[4]))
        state.update((int(fresh), [float(v) for t in active for v in t]))
        yield g.assign(track_id=ids, hits=hits)

    schema = ", ".join([*(f"`{n}` {k}" for n, k in fields), "track_id long", "hits int"])
    return boxes.groupBy(scene, class_col).applyInPandasWithState(run, schema, "fresh long, tracks array<double>", "append", GroupStateTimeout.NoTimeout)
