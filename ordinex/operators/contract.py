"""Output contracts and grids of them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from itertools import product

from pyspark.sql import DataFrame, SparkSession


# Fixed values, a data contract: the names and defaults of a contract's fields, and the form of a setting's id.
@dataclass(frozen=True)
class OutputContract:
    tracked_candidate_count: int = 5
    exposed_candidate_count: int = 20
    duplicate_iou_threshold: float = 0.7
    match_iou_threshold: float = 0.15
    birth_duplicate_iou_threshold: float = 0.7

    def __post_init__(self) -> None:
        if self.tracked_candidate_count < 2:
            raise ValueError("at least two candidates are tracked")
        if self.exposed_candidate_count < self.tracked_candidate_count:
            raise ValueError("as many candidates are exposed as tracked, or more")
        for f in fields(self)[2:]:
            if not 0 <= getattr(self, f.name) <= 1:
                raise ValueError(f"{f.name} must be in [0, 1]")

    @classmethod
    def of(cls, config: dict | None) -> OutputContract:
        """From a config: the bare object or one under ``output_contract``; unknown keys are errors."""
        return cls(**((config or {}).get("output_contract", config) or {}))

    def setting_id(self) -> str:
        return f"kt{self.tracked_candidate_count}_ke{self.exposed_candidate_count}_match{self.match_iou_threshold:.2f}_birth{self.birth_duplicate_iou_threshold:.2f}_dup{self.duplicate_iou_threshold:.2f}"


#: The registered grid of settings.
GRID = {"tracked": [2, 3, 4, 5], "exposed": [10, 15, 20], "match": [0.1, 0.15, 0.25], "birth": [0.5, 0.7, 0.85]}


def grid(tracked: list[int], exposed: list[int], match: list[float], birth: list[float], duplicate: float = 0.7) -> list[OutputContract]:
    return [OutputContract(t, e, duplicate, m, b) for t, e, m, b in product(tracked, exposed, match, birth)]


def grid_frame(spark: SparkSession, settings: list[OutputContract]) -> DataFrame:
    """A row for each setting, a table as long as its parameter."""
    rows = [(k, s.setting_id(), *asdict(s).values()) for k, s in enumerate(settings)]
    return spark.createDataFrame(rows, "setting_index int, setting_id string, tracked int, exposed int, duplicate double, match double, birth double")
