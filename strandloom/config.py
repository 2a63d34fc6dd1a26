"""Thresholds of the linkage and scene operators; functions take a Config, nothing is read from Spark's settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values of the rule tables
    face_weight_within: float = 0.4
    face_weight_across: float = 0.45
    smoothing_window: int = 5
    face_run: int = 15
    min_track_rows: int = 3
    min_length: int = 30
    fragment_gap: int = 120
    fragment_similarity: float = 0.8
    gun_confidence: float = 0.35
    sample_rate: int = 30
    # behaviour that can be switched off
    zero_face_blocks: bool = True
    one_level_parents: bool = True
    enforce_budget: bool = False


DEFAULT = Config()
