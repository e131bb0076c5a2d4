"""The measure model: dimensions, their sub-scores, their oriented measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Measure:
    column: str
    direction: int = 1  # +1 higher is worse, -1 higher is better
    label: str = ""
    resolution: str = "area"  # or "county": one value broadcast over a county
    units: str = ""


@dataclass(frozen=True)
class SubScore:
    key: str
    measures: tuple[Measure, ...]
    label: str = ""
    scored: bool = True  # unscored ones are computed and shown, but left out of the dimension
    source: str = ""

    @property
    def resolution(self) -> str:
        kinds = {m.resolution for m in self.measures}
        return kinds.pop() if len(kinds) == 1 else "mixed"


@dataclass(frozen=True)
class Dimension:
    key: str
    weight: float
    subscores: tuple[SubScore, ...]
    label: str = ""


@dataclass(frozen=True)
class Model:
    dimensions: tuple[Dimension, ...]
    min_members: int = 100  # a measure with fewer values is skipped
    min_dimensions: int = 2
    population_floor: float = 1000.0
    noise_share: dict[str, dict[str, float]] = field(default_factory=dict)

    @property
    def subscores(self) -> list[tuple[Dimension, SubScore]]:
        return [(d, s) for d in self.dimensions for s in d.subscores]

    @property
    def measures(self) -> list[tuple[SubScore, Measure]]:
        return [(s, m) for _, s in self.subscores for m in s.measures]

    @property
    def dim_cols(self) -> list[str]:
        return [f"{d.key}_pctile" for d in self.dimensions]

    @property
    def sub_cols(self) -> list[str]:
        return [f"{s.key}_pctile" for _, s in self.subscores]

    @property
    def weights(self) -> dict[str, float]:
        return {d.key: d.weight for d in self.dimensions}

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(d.key, s.key, s.scored, m.column, m.direction, m.label, m.resolution)
                for d, s in self.subscores for m in s.measures]
        return spark.createDataFrame(
            rows, "dim string, subscore string, scored boolean, col string, dir int, label string, res string")
