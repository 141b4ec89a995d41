"""The named table set every operator reads."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from learnlens.schemas import TABLES


@dataclass(frozen=True)
class Tables:
    students: DataFrame
    courses: DataFrame
    resources: DataFrame
    events: DataFrame
    scores: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def from_dict(cls, tables: dict[str, DataFrame]) -> Tables:
        missing = [t for t in TABLES if t not in tables]
        if missing:
            raise KeyError(f"missing tables: {missing}")
        return cls(**{t: tables[t] for t in TABLES})

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)
