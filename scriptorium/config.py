"""Profiles and parameters of the extraction pipelines."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Chunk geometry and model limits; offsets and lengths are code points."""

    chunk_size: int
    overlap: int
    max_output_tokens: int
    timeout_s: float
    split_on_markers: bool = False
    markers_per_request: int = 6
    exclude_title_like: bool = False
    normalize_kinship: bool = True
    context_tokens: int = 4096


#: Local model: parsed leniently, kept as it comes.
LOCAL = Profile(chunk_size=900, overlap=120, max_output_tokens=700, timeout_s=900.0)
#: Remote service: structured output, validated, grounded and deduplicated.
API = Profile(chunk_size=1200, overlap=80, max_output_tokens=900, timeout_s=60.0)

#: What the models are told to do.
SYSTEM_LOCAL = (
    "你是史料整理助手。请找出文本中的官员，只输出一个 JSON List，不要解释。\n"
    "每项字段：name（姓名）、rank（官职，没有则为 null）、event_type、action（行为）、time（时间，没有则为 null）。\n"
    "event_type 只能是：Appointment、Military、Diplomacy、Disaster、Death、Other。"
)
SYSTEM_API = SYSTEM_LOCAL.replace("一个 JSON List", '{"items": [...]}') + "\n另加字段 quote：原文中 5 至 60 字的连续片段，须与原文完全一致。"
MARKERS = ("○",)
CUT_LOOKBACK = 250
#: Debug page ranges: first page, pages.
DEBUG_LOCAL, DEBUG_API = (20, 50), (20, 10)
MAX_SAVED_CHUNKS = MAX_BAD_DUMPS = 200
EVENT_TYPES = ("Appointment", "Military", "Diplomacy", "Disaster", "Death", "Other")
