"""Settings with their defaults, from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Defaults of search and gating; each can be set by an environment variable of its name in capitals with ``CORPUSLOOM_`` before it."""

    k1: float = 1.5
    b: float = 0.75
    top_k: int = 20
    alpha: float = 0.5
    min_confidence: float = 0.3
    entailment_threshold: float = 0.3
    passage_limit: int = 1500
    vector_model: str = ""

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](env[k]) for f in fields(cls) if (k := f"CORPUSLOOM_{f.name.upper()}") in env})
