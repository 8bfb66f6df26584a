"""Tracks of boxes through the frames of videos. A track depends on all frames before, so videos are the unit of work."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.boxes import SIDES


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (row, column) of least total cost, by shortest augmenting paths; min(rows, columns) pairs."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    u, v, row_of = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        low, back, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, row, gone = -1, i, 0.0
        while True:
            reduced = gone + cost[row] - u[row] - v
            better = ~done & (reduced < low)
            low[better], back[better] = reduced[better], at
            at = int(np.where(done, np.inf, low).argmin())
            gone = low[at]
            done[at] = True
            if row_of[at] < 0:
                break
            row = row_of[at]
        closed = done.copy()
        closed[at] = False
        u[row_of[closed]] += gone - low[closed]
        u[i] += gone
        v[closed] -= gone - low[closed]
        while at >= 0:
            row_of[at] = i if back[at] < 0 else row_of[back[at]]
            at = back[at]
    return sorted((int(row_of[j]), j) for j in range(m) if row_of[j] >= 0)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all boxes of one frame with all of another."""
    wide = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    high = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    shared = np.maximum(wide, 0) * np.maximum(high, 0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    total = area(a)[:, None] + area(b)[None, :] - shared
    return np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)


def tracks(boxes: DataFrame, video: str = "video_id", frame: str = "frame", least_iou: float = 0.3, confirm_after: int = 3, max_age: int = 30) -> DataFrame:
    """Adds (track_id, confirmed) to boxes: each frame's boxes are matched to the open tracks by least total 1 - IoU against where a
    track's steady motion puts it. Boxes without a match open a track; a track is confirmed from its ``confirm_after``-th box on,
    and closed after ``max_age`` frames without one, or at the first such frame while it is not confirmed."""

    def tracked(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([frame, *SIDES]).reset_index(drop=True)
        out_id, sure = np.zeros(len(p), np.int64), np.zeros(len(p), bool)
        open_: list[dict] = []
        made = 0
        for f, rows in p.groupby(frame, sort=True).indices.items():
            b = p.loc[rows, list(SIDES)].to_numpy(float)
            open_ = [t for t in open_ if f - t["frame"] <= max_age and (t["n"] >= confirm_after or f - t["frame"] <= 1)]
            ahead = np.array([t["box"] + t["speed"] * (f - t["frame"]) for t in open_]).reshape(-1, 4)
            near = overlap(ahead, b)
            matched = {j: open_[i] for i, j in assignment(1 - near) if near[i, j] >= least_iou}
            for j, r in enumerate(rows):
                t = matched.get(j)
                if t is None:
                    t = {"id": made, "n": 0, "speed": np.zeros(4)}
                    made += 1
                    open_.append(t)
                else:
                    t["speed"] = 0.5 * t["speed"] + 0.5 * (b[j] - t["box"]) / (f - t["frame"])
                t |= {"box": b[j], "frame": f, "n": t["n"] + 1}
                out_id[r], sure[r] = t["id"], t["n"] >= confirm_after
        return p.assign(track_id=out_id, confirmed=sure)

    schema = ", ".join(f"`{c}` {t}" for c, t in boxes.dtypes) + ", track_id long, confirmed boolean"
    return boxes.groupBy(video).applyInPandas(tracked, schema)
