"""Parameters of ingestion and analysis; defaults are the documented behaviour."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class IngestConfig:
    """``on_bad_record`` is "quarantine" (set records aside) or "fail"."""

    early_date: int = 2012
    language: str = "en"
    id_base: str = "https://openalex.org/"
    enable_references: bool = False
    on_bad_record: str = "quarantine"

    def __post_init__(self) -> None:
        if self.on_bad_record not in ("quarantine", "fail"):
            raise ValueError(f"on_bad_record: {self.on_bad_record!r}")


@dataclass(frozen=True)
class AnalysisConfig:
    """``min_total_frequency`` is accepted and has no effect; ``batch_size`` sizes sample pages only."""

    batch_size: int = 100_000
    ngram_range: tuple[int, int] = (1, 3)
    min_fold_change: float = 2.0
    confidence_level: float = 0.95
    year_alpha: float = 0.05
    min_total_frequency: int = 10
    min_years_present: int = 3
    min_observed_years: int = 3
    min_estimated_total: float = 1000.0
    per_k_words: int = 1000
    seed: int = 42
    stop_words: bool = True
    contractions: bool = True

    def __post_init__(self) -> None:
        low, high = self.ngram_range
        if not 1 <= low <= high:
            raise ValueError(f"ngram_range: {self.ngram_range!r}")

    def with_(self, **changes) -> AnalysisConfig:
        return replace(self, **changes)


#: The settings of the documented example run.
EXAMPLE = AnalysisConfig(ngram_range=(1, 1), min_fold_change=4.0, min_total_frequency=20, min_years_present=1)
