"""Parameters of the localization and review jobs, with their published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LocalizeConfig:
    window: int = 64
    stride: int = 16
    threshold: float = 0.5
    max_gap: int = 16
    max_pairs: int = 24
    distance_scale: float = 2.5
    min_visibility: float = 0.3
    min_pair_height: float = 0.0
    normalize: bool = True
    max_persons: int = 16
    fps: float = 30.0


@dataclass(frozen=True)
class ReviewConfig(LocalizeConfig):
    min_pair_height: float = 120.0
    motion_floor: float = 0.5
    motion_saturate: float = 2.0
    motion_weight: float = 0.9
    smooth_seconds: float = 0.5
    baseline_seconds: float = 10.0
    pressure_weight: float = 1.5
    top_incidents: int | None = None

    @property
    def smooth_frames(self) -> int:
        return max(1, int(self.smooth_seconds * self.fps))

    @property
    def baseline_frames(self) -> int:
        return int(self.baseline_seconds * self.fps)
