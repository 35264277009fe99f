"""Thresholds that are part of the results. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    detection_floor: float = 0.25
    face_floor: float = 0.6
    text_floor: float = 0.5
    agreement_floor: float = 0.0
    face_link: float = 0.406
    body_link: float = 0.701
    face_veto: float = 0.058
    min_crop_area: int = 1600
    min_frontality: float = 0.15
    top_labels: int = 10
    pose_visibility: float = 0.5
    address_cone: float = 15.0
    gaze_cone: float = 20.0
    gaze_in_frame: float = 0.3
    synchrony_floor: int = 5
    relation_share: float = 0.5
    relation_minimum: int = 3
    outdoor: float = 0.168
    hold_frames: int = 8
    jitter: float = 0.00309
    movement: float = 0.00923
    steady: float = 0.605
    neighbours: int = 5


DEFAULT = Config()
