"""Interactive sessions and simulated users: a driver loop whose every step is one Spark query over the vectors."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rbf_kernel, sigmoid
from ..operators.graph import neighbour_scores, promises, propagated, weights
from ..operators.search import multiscale_query, random_batch, reranked, scored, top_frames, without
from ..sources.shared import cut
from . import feedback


@dataclass
class Session:
    """A search over tiles (vec_id, dbidx, zoom_level, x1, y1, x2, y2, embedding): batches of frames, feedback, refined queries.

    State is small: what was returned and what was marked. ``method`` is one of METHODS; those of GRAPH_METHODS need ``graph``, edges
    (src_vertex, dst_vertex, distance, dst_rank) over vec_id. ``knn_prop`` ranks by propagated labels, ``lknn`` by labelled
    neighbours, ``active`` takes the frame of the vertex that promises most within ``horizon`` steps, and ``pseudo`` fits a query to
    propagated labels of a sample. ``multi_neg`` fits one vector to the target and one to what was marked as confused with it; with
    option ``discount`` scores for the latter are taken off.
    """

    tiles: DataFrame
    query: Sequence[float]
    method: str = "plain"
    batch: int = 1
    start_policy: str = "after_first_batch"
    scoring: str = "plain_score"
    graph: DataFrame | None = None
    options: dict[str, Any] = field(default_factory=dict)
    returned: list[int] = field(default_factory=list)
    accepted: dict[int, list[tuple[float, float, float, float]]] = field(default_factory=dict)
    confused: dict[int, list[tuple[float, float, float, float]]] = field(default_factory=dict)
    log: list[dict[str, Any]] = field(default_factory=list)
    _current: list[float] = field(default_factory=list)
    _contrast: list[float] | None = None

    GRAPH_METHODS = ("knn_prop", "lknn", "active", "pseudo")
    METHODS = ("plain", "random", "rocchio", "logistic", "rank", "multi", "multi_neg", *GRAPH_METHODS)

    def __post_init__(self) -> None:
        if self.method not in self.METHODS:
            raise ValueError(f"unknown method {self.method!r}")
        if self.method in self.GRAPH_METHODS and self.graph is None:
            raise ValueError(f"{self.method} needs a graph")
        self._current = [float(v) for v in self.query]
        self._note("set_text")

    def _note(self, message: str) -> None:
        self.log.append({"message": message, "time": time.time(), "seen": len(self.returned), "accepted": sum(map(bool, self.accepted.values()))})

    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return self.tiles.sparkSession.createDataFrame([(int(i),) for i in ids], "dbidx long")

    def next(self) -> list[int]:
        """The next batch of frames, none of which was returned before; empty when there is nothing left."""
        seen = self._ids(self.returned)
        if self.method == "random":
            rows = random_batch(self.tiles, self.batch, "dbidx", self.options.get("seed", 0), seen).collect()
        elif self.method in ("knn_prop", "lknn", "active") and self.accepted and self._may_refine():
            rows = self._by_graph(seen).collect()
        else:
            rows = multiscale_query(self.tiles, self._current, self.batch, self.options.get("shortlist"), seen, self._contrast, self.scoring).collect()
        found = [r.dbidx for r in rows]
        self.returned += found
        self._note("next")
        return found

    def give(self, frame: int, boxes: Sequence[tuple[float, float, float, float]], confused: Sequence[tuple[float, float, float, float]] = ()) -> None:
        """Marks what the user accepts in a frame, and what could be taken for it; no boxes: seen and rejected."""
        self.accepted[frame] = [tuple(map(float, b)) for b in boxes]
        self.confused[frame] = [tuple(map(float, b)) for b in confused]
        self._note("update")

    def _marked(self, boxes: dict[int, list[tuple[float, float, float, float]]] | None = None) -> list:
        """The vectors of frames with feedback, each with y: 1 if a box overlaps it, an accepted one unless ``boxes`` are given."""
        boxes = self.accepted if boxes is None else boxes
        rows = self.tiles.join(self._ids(list(self.accepted)), "dbidx", "left_semi").select("vec_id", "dbidx", "x1", "y1", "x2", "y2", "embedding").orderBy("vec_id").collect()
        hit = lambda r: any(r.x1 < b[2] and b[0] < r.x2 and r.y1 < b[3] and b[1] < r.y2 for b in boxes.get(r.dbidx, ()))
        return [(r, int(hit(r))) for r in rows]

    def labelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, labels, vectors of the image) of the frames with feedback."""
        rows = self._marked()
        of = Counter(r.dbidx for r, _ in rows)
        return np.array([r.embedding for r, _ in rows], float), np.array([y for _, y in rows]), np.array([of[r.dbidx] for r, _ in rows])

    def _may_refine(self) -> bool:
        marks = [bool(b) for b in self.accepted.values()]
        turned = any(b and not all(marks[:i]) for i, b in enumerate(marks))
        return feedback.may_refine(self.start_policy, len(self.returned) // max(1, self.batch), sum(marks), len(marks) - sum(marks), turned)

    def _vertex_scores(self) -> DataFrame:
        """(vertex, score) along the graph: a prior from the query's scores, and the labels so far."""
        labels = self.tiles.sparkSession.createDataFrame([(r.vec_id, y) for r, y in self._marked()], "vertex long, y int")
        prior = scored(self.tiles, self._current).select(F.col("vec_id").alias("vertex"), sigmoid("score", self.options.get("slope", 10.0), self.options.get("shift", -0.3)).alias("f"))
        if self.method in ("knn_prop", "pseudo"):
            if all(y for _, y in self._marked()):
                return prior.withColumnRenamed("f", "score")  # labels spread once there is a negative one
            w = weights(self.graph, lambda d: rbf_kernel(d, self.options.get("width", 0.5)))
            return propagated(cut(w), prior, labels, self.options.get("prior_weight", 1.0), self.options.get("steps", 5)).withColumnRenamed("f", "score")
        return neighbour_scores(self.graph, prior.withColumn("f", F.lit(float(self.options["gamma"]))) if "gamma" in self.options else prior, labels)

    def _by_graph(self, seen: DataFrame) -> DataFrame:
        scores = self.tiles.join(self._vertex_scores().withColumnRenamed("vertex", "vec_id"), "vec_id")
        if self.method == "active":
            return self._promising(without(scores.select("vec_id", "dbidx", "score"), seen, "dbidx"))
        if self.method == "lknn":
            return top_frames(scores, self.batch, exclude=seen).select("dbidx")
        scores = cut(scores.drop("embedding"))
        chosen = top_frames(without(scores, seen, "dbidx"), self.options.get("shortlist", 5 * self.batch))
        return reranked(scores.join(chosen.select("dbidx"), "dbidx", "left_semi"), self.batch, self.scoring).select("dbidx")

    def _promising(self, scores: DataFrame) -> DataFrame:
        """The frames of the vertices with the largest p (1 + best after a positive) + (1 - p) best after a negative, of all."""
        known = self.tiles.join(self._ids(list(self.accepted)), "dbidx", "left_semi").select("vec_id")
        value = promises(self.graph, cut(scores), known, self.options.get("horizon", 5))
        return top_frames(value.join(scores.select("vec_id", "dbidx"), "vec_id").withColumnRenamed("promise", "score"), self.batch).select("dbidx")

    def refine(self) -> None:
        """Uses the feedback so far, once the start policy allows it."""
        if self.method in ("plain", "random", "knn_prop", "lknn", "active") or not self._may_refine():
            return
        x, y, per = self.labelled()
        q = np.array(self.query, float)
        if self.method == "rocchio":
            mean = lambda v: v.mean(axis=0) if len(v) else np.zeros_like(q)
            o = {"alpha": 1.0, "beta": 0.75, "gamma": 0.15} | self.options
            new = o["alpha"] * q + o["beta"] * mean(x[y == 1]) - o["gamma"] * mean(x[y == 0])
        elif self.method == "logistic":
            new = feedback.logistic_refine(x, y, q, self.options.get("penalty", 1.0))
        elif self.method == "rank":
            new = feedback.rank_refine(x, y, q, self.options.get("penalty", 1.0))
        elif self.method == "pseudo":
            scores = self._vertex_scores().withColumnRenamed("vertex", "vec_id")
            sample = self.tiles.join(random_batch(self.tiles, self.options.get("sample", 200), "vec_id", self.options.get("seed", 0)), "vec_id", "left_semi")
            rows = sample.join(scores, "vec_id").select("embedding", "score").collect()
            soft, told = np.array([r.embedding for r in rows], float), self.options.get("label_weight", 10.0)
            new = feedback.soft_refine(np.concatenate([soft, x]), np.concatenate([[r.score for r in rows], y]), np.concatenate([np.ones(len(rows)), np.full(len(y), told)]), q, self.options.get("penalty", 1.0))
        elif self.method == "multi_neg":
            other = np.array([y for _, y in self._marked(self.confused)])
            new, against = feedback.two_way_refine(x, y, other, per, q, **{k: v for k, v in self.options.items() if k in ("norm_weight", "query_weight")})
            self._contrast = against.tolist() if self.options.get("discount") else None
        else:
            known = ("label_weight", "data_weight", "norm_weight", "query_weight", "loss", "positive_weight", "margin")
            new = feedback.multi_refine(x, y, per, q, self.options.get("spread"), **{k: v for k, v in self.options.items() if k in known})
        self._current = new.tolist()
        self._note("refine")


def simulated(session: Session, truth: DataFrame, category: Any, max_results: int = 10, n_batches: int = 60, drop: float = 0.0, seed: int = 0, confused: Any = None) -> dict[str, Any]:
    """A user who accepts all boxes (dbidx, category, x1..y2) of a category, some dropped at random, and says where boxes of the category
    ``confused`` are: the run's summary row.

    Stops at ``max_results`` found, ``n_batches`` shown or nothing left. A frame never comes twice.
    """
    mine = truth.where(F.col("category") == category).where(F.rand(seed) >= drop) if drop else truth.where(F.col("category") == category)
    total = mine.select("dbidx").distinct().count()
    hits: list[int] = []
    latencies: list[float] = []
    seen = 0
    for _ in range(n_batches):
        began = time.time()
        frames = session.next()
        latencies.append(time.time() - began)
        if not frames:
            break
        boxes: dict[int, list] = {f: [] for f in frames}
        for r in mine.where(F.col("dbidx").isin(frames)).collect():
            boxes[r.dbidx].append((r.x1, r.y1, r.x2, r.y2))
        near: dict[int, list] = {}
        for r in truth.where((F.col("category") == confused) & F.col("dbidx").isin(frames)).collect() if confused is not None else ():
            near.setdefault(r.dbidx, []).append((r.x1, r.y1, r.x2, r.y2))
        for f in frames:
            session.give(f, boxes[f], near.get(f, ()))
            if boxes[f]:
                hits.append(seen)
            seen += 1
        if len(hits) >= min(max_results, total):
            break
        session.refine()
    assert len(set(session.returned)) == len(session.returned)
    return {"category": category, "method": session.method, "hit_indices": hits, "nseen": seen, "nfound": len(hits), "ntotal": total, "dbidxs": session.returned, "latencies": latencies}


def bench_configs(datasets: Sequence[str], categories: Callable[[str], Sequence[Any]], methods: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
    """Every method on every category of every dataset."""
    return [{"dataset": d, "category": c, **m} for d in datasets for c in categories(d) for m in methods]


def _choices(config: Any) -> list[Any]:
    if isinstance(config, dict) and set(config) == {"choose"}:
        return [v for c in config["choose"] for v in _choices(c)]
    if isinstance(config, dict):
        keys = list(config)
        return [dict(zip(keys, vs, strict=True)) for vs in itertools.product(*[_choices(config[k]) for k in keys])]
    return [config]


def space_size(config: Any) -> int:
    return len(_choices(config))


def sampled_configs(config: Any, most: int, seed: int = 0) -> list[Any]:
    """Up to ``most`` different settings of a space in which ``{"choose": [...]}`` stands for any of a list, nested as you like."""
    every = _choices(config)
    return every if len(every) <= most else random.Random(seed).sample(every, most)


def named_setting(text: str, name: str) -> dict[str, Any]:
    """One setting of a YAML (or JSON) document {shared_session_params, variants}: the shared values and those of the one variant, once all
    choices are expanded, that has the name."""
    import yaml

    document = yaml.safe_load(text)
    found = [v for variant in document.get("variants", []) for v in _choices(variant) if v.get("name") == name]
    if len(found) != 1:
        raise ValueError(f"{len(found)} variants are called {name!r}")
    return document.get("shared_session_params", {}) | found[0]
