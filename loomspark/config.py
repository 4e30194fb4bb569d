"""Settings with defaults, overridden key by key; keys that don't exist are ignored."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

RULE_SETS = {
    # fixed values
    "academic_paper": "Split at section headers, mathematical formulations, and major concept introductions",
    "meeting_transcript": "Split at speaker changes, topic shifts, and decision points",
    "technical_documentation": "Split at major conceptual shifts, code blocks, and API descriptions",
}
DEFAULT_RULE_SET = "technical_documentation"


@dataclass(frozen=True)
class EngineConfig:
    window_size: int = 1000
    overlap: float = 0.2
    similarity_threshold: float = 0.7
    tree_levels: int = 5
    attention_threshold: float = 0.1
    least_segment_tokens: int = 50
    most_kept_segments: int = 30
    damping: float = 0.85


def get_config(overrides: dict | None = None) -> EngineConfig:
    known = {f.name for f in fields(EngineConfig)}
    return replace(EngineConfig(), **{k: v for k, v in (overrides or {}).items() if k in known})


def as_dict(config: EngineConfig) -> dict:
    return asdict(config)
