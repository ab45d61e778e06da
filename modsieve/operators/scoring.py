"""The scorer surface: pluggable classifiers over frames, one failure never cancels the rest."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.admission import oversize

MAX_ERROR = 1024
_REGISTRY: dict[str, Callable[..., object]] = {}


def register(name: str, factory: Callable[..., object]) -> None:
    """F1: make a scorer available by name."""
    _REGISTRY[name] = factory


def create(name: str, **options):
    """F1: a scorer by name; an unknown name fails and lists the known ones."""
    if name not in _REGISTRY:
        raise KeyError(f"unknown scorer {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](**options)


class FakeScorer:
    """Answers every frame with a fixed response; frames whose asset is in ``failing`` raise."""

    name, model_version, max_image_bytes, supports_video = "fake", "1", 0, False

    def __init__(self, response: str = "{}", failing: Iterable[str] = ()) -> None:
        self.response, self.failing = response, frozenset(failing)

    def score(self, frame: dict) -> str:
        if frame["asset_id"] in self.failing:
            raise RuntimeError(f"no answer for {frame['asset_id']}")
        return self.response


register("fake", FakeScorer)


class Retry(Exception):
    """A failure that another attempt may mend; ``wait``: seconds asked for by the provider."""

    def __init__(self, text: str, wait: float | None = None) -> None:
        super().__init__(text)
        self.wait = wait


def attempt(call: Callable[[], str], attempts: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> str:
    """bounded retries with doubling waits; a usable wait of the provider wins."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Retry as e:
            if n == attempts:
                raise
            sleep(e.wait if e.wait is not None and 1 <= e.wait <= 120 else base * 2 ** (n - 1))
    raise AssertionError


class Pace:
    """at most ``rate`` calls a second, with an injected clock; 0 means no limit."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 1 / rate if rate else 0.0, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def score_frames(frames: DataFrame, scorer, rate: float = 0.0, tasks: int = 1) -> DataFrame:
    """``frames`` (asset_id, frame_idx, content, n_bytes, ...) with ``status``,
    ``error`` and ``response``. Frames over the scorer's cap are errors and not sent. A failing
    frame is an error by itself. ``rate`` is the global pace, split over ``tasks``."""
    spark = frames.sparkSession
    caps = spark.createDataFrame([(scorer.name, scorer.max_image_bytes)], "adapter string, max_bytes long")
    ready = oversize(frames.withColumn("adapter", F.lit(scorer.name)), caps).drop("adapter")
    rows = ready.select("asset_id", "frame_idx", "content", "preflight_error")

    def run(batches):
        pace = Pace(rate / tasks if rate else 0.0)
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if isinstance(row["preflight_error"], str):
                    out.append((row["asset_id"], row["frame_idx"], "error", row["preflight_error"], None))
                    continue
                pace.wait()
                try:
                    out.append((row["asset_id"], row["frame_idx"], "ok", None, attempt(lambda row=row: scorer.score(row))))
                except Exception as e:  # the frame's own failure
                    out.append((row["asset_id"], row["frame_idx"], "error", str(e)[:MAX_ERROR], None))
            yield pd.DataFrame(out, columns=["asset_id", "frame_idx", "status", "error", "response"])

    return rows.mapInPandas(run, "asset_id string, frame_idx long, status string, error string, response string")


def score_assets(assets: DataFrame, frames: DataFrame, scorer, **options) -> DataFrame:
    """F2: whole assets where the scorer takes video, else their frames; chosen as the plan is built."""
    if getattr(scorer, "supports_video", False):
        whole = assets.select("asset_id", F.lit(0).cast("long").alias("frame_idx"), "content", "n_bytes")
        return score_frames(whole, scorer, **options)
    return score_frames(frames, scorer, **options)


def replay(frames: DataFrame, responses: DataFrame) -> DataFrame:
    """recorded responses (asset_id, frame_idx, response) instead of calls: a join."""
    out = frames.join(responses.select("asset_id", "frame_idx", "response"), ["asset_id", "frame_idx"], "left")
    return out.withColumn("status", F.when(F.col("response").isNull(), "error").otherwise("ok")).withColumn("error", F.when(F.col("response").isNull(), "no recorded response"))
