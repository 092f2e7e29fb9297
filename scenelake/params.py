"""The named parameters of a reconstruction with their usual values, and the arguments that operators take from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from scenelake.functions.geometry import target_size
from scenelake.operators.masks import above
from scenelake.operators.trajectory import Options


@dataclass(frozen=True)
class Parameters:
    """Thresholds on confidence (of one pass, and of chunks), edges (relative depth, degrees between normals), sampling
    (every so many frames; negative: by the kind of source), pixels of a frame, chunks, and what chunks hand on."""

    conf: float = 0.1
    chunk_conf: float = 0.05
    rtol: float = 0.03
    degrees: float = 5.0
    interval: int = -1
    pixel_limit: int = 255_000
    chunk: int = 16
    overlap: int = 6
    inject: tuple[str, ...] = ()

    def __post_init__(self):
        if not 0 < self.overlap < self.chunk:
            raise ValueError("0 < overlap < chunk is needed")
        if set(self.inject) - {"pose", "depth", "ray", "intrinsic"}:
            raise ValueError(f"cannot inject {self.inject}")

    def edges(self) -> dict[str, float]:
        """For masks.edges."""
        return {"rtol": self.rtol, "degrees": self.degrees}

    def chunks(self) -> dict[str, int]:
        """For sampling.assign_chunks."""
        return {"size": self.chunk, "overlap": self.overlap}

    def step(self, path: str, fps: float | None = None) -> int:
        """The interval of a source, as sampling.default_interval has it for a column."""
        if self.interval > 0:
            return self.interval
        return int(fps) if fps is not None and fps >= 1 else 10 if path.lower().endswith(".mp4") else 1

    def target(self, width: Column, height: Column) -> tuple[Column, Column]:
        """The sides that frames are brought to, at most ``pixel_limit`` pixels."""
        return target_size(width, height, self.pixel_limit)

    def sure(self, conf: Column) -> Column:
        """Confidences that count in one pass."""
        return above(conf, self.conf)

    def options(self, height: int, width: int) -> Options:
        """For trajectory.in_order and stitching.stitch."""
        return Options(height, width, self.inject, self.overlap, self.chunk_conf, self.rtol, self.degrees)
