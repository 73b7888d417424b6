"""The five base tables travel together as one bundle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortlens.sources import schemas


def conform(name: str, df: DataFrame) -> DataFrame:
    """``df`` with the columns and types of base table ``name``."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schemas.BY_NAME[name].fields])


@dataclass(frozen=True)
class Tables:
    """``bucketed``: the tables with a User_ID are stored by it, in one number
    of buckets (see ``sources.bucketed``)."""

    users: DataFrame
    services: DataFrame
    app_usage: DataFrame
    campaigns: DataFrame
    responses: DataFrame
    bucketed: bool = False

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in schemas.BY_NAME}

    def conformed(self) -> "Tables":
        """Project every table onto its schema's columns and types."""
        return Tables(**{name: conform(name, df) for name, df in self.as_dict().items()}, bucketed=self.bucketed)
