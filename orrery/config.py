"""Settings that change results, passed explicitly, and the value domains of enumerations."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RagConfig:
    """Defaults of retrieval, grounding and usage."""

    chunk_size: int = 800
    chunk_overlap: int = 120
    top_k: int = 4
    score_threshold: float = 0.3
    hybrid: bool = True
    keyword_top_k: int = 8
    keyword_max_terms: int = 8
    vector_fetch_k: int = 12
    rrf_k: int = 60
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    candidate_k: int = 30
    rerank: bool = False
    rerank_threshold: float = 0.0
    grounding: bool = True
    abstain: bool = True
    abstain_min_score: float = 0.35
    timezone: str = "Asia/Shanghai"
    history_rounds: int = 10
    stale_minutes: int = 15


#: Which changes of an agent's status are allowed, and the longest range of a report.
AGENT_TRANSITIONS = (("draft", "running"), ("running", "paused"), ("paused", "running"), ("paused", "stopped"), ("pending", "stopped"))
MAX_RANGE_DAYS = 366
