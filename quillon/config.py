"""Parameters of the engine."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class RetrievalConfig:
    """Parameters of the retrieval cascade."""

    top_k: int = 10
    candidate_multiplier: int = 4
    min_score: float = 0.25
    adaptive_sigma: float = 1.0
    high_confidence: float = 0.65
    low_confidence: float = 0.45
    gap_filter: bool = True
    keyword_filter: bool = True
    lexical_weight: float = 0.40
    pair_scorer: bool = False
    pair_top_k: int = 20
    pair_hybrid_weight: float = 0.40
    pair_min_score: float = 0.0

    @property
    def pool(self) -> int:
        """Rows fetched by similarity before the filters."""
        base = self.top_k * self.candidate_multiplier
        return max(base, self.pair_top_k * self.candidate_multiplier) if self.pair_scorer else base

    def with_(self, **changes) -> RetrievalConfig:
        """A copy with the given parameters; None leaves a parameter as it is."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @classmethod
    def from_env(cls, env: Mapping[str, str]) -> RetrievalConfig:
        """Parameters from variables named like them in capitals; empty ones leave the default."""
        kinds = {"int": int, "float": float, "bool": lambda v: v.strip().lower() in ("1", "true", "yes", "on", "sim")}
        return cls(**{f.name: kinds[f.type](v) for f in fields(cls) if (v := env.get(f.name.upper(), "")).strip()})

    def snapshot(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class ChunkConfig:
    """Parameters of chunking, sizes in estimated tokens."""

    min_tokens: int = 200
    max_tokens: int = 375
    overlap_tokens: int = 50
    remove_headers: bool = True
    remove_boilerplate: bool = True

    @classmethod
    def of_chars(cls, chunk_size: int = 512, overlap: int = 50) -> ChunkConfig:
        """Sizes derived from a size in characters, a third of it in tokens."""
        largest = max(30, min(chunk_size // 3, 375))
        return cls(min_tokens=max(10, largest // 2), max_tokens=largest, overlap_tokens=overlap)
