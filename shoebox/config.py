"""Search settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

#: Component weights for each kind of query.
PRESETS = {
    "metadata_dominant": {"visual": 0.2, "ocr": 0.1, "metadata": 0.7},
    "visual_dominant": {"visual": 0.8, "ocr": 0.1, "metadata": 0.1},
    "text_dominant": {"visual": 0.2, "ocr": 0.7, "metadata": 0.1},
    "hybrid_balanced": {"visual": 0.5, "ocr": 0.3, "metadata": 0.2},
    "fallback": {"visual": 0.7, "ocr": 0.2, "metadata": 0.1},
}


@dataclass(frozen=True)
class SearchConfig:
    """All constants of search, learning and deduplication; frozen, so that sessions can't change each other's."""

    relative_threshold: float = 0.30
    floor_ratio: float = 0.70
    max_results: int = 50
    candidates: int = 100
    gap_rows: int = 30
    gap_drop: float = 0.10
    gap_margin: float = 0.05
    ocr_min_token: int = 3
    ocr_exact: float = 1.0
    ocr_partial: float = 0.6
    ocr_near: float = 0.3
    ocr_cap: float = 3.0
    learning_rate: float = 0.25
    min_feedback: int = 5
    min_success: float = 0.2
    max_adjustment: float = 0.15
    document_gate: float = 0.12
    phash_bits: int = 10
    embedding_similarity: float = 0.90
    face_distance: float = 0.50
    assign_distance: float = 0.45
    neighbours: int = 16
    presets: dict = field(default_factory=lambda: {k: dict(v) for k, v in PRESETS.items()})

    def __post_init__(self) -> None:
        for name in ("relative_threshold", "floor_ratio"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.max_results < 1:
            raise ValueError("max_results must be at least 1")

    def as_dict(self) -> dict:
        return asdict(self)
