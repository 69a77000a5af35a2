"""What a session may be told, from its own configuration or the environment; no secrets, which belong to the injected models."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunks: str = "phase1_chunks"
    index: str = "index"
    language_models: str = ""
    answer_models: str = ""

    @classmethod
    def read(cls, spark: SparkSession | None = None, environment: Mapping[str, str] = os.environ) -> Settings:
        """``spark.lodestone.<name>`` of the session, else ``LODESTONE_<NAME>`` of the environment, else the default; blank values are none."""
        told = {}
        for f in fields(cls):
            given = spark.conf.get(f"spark.lodestone.{f.name}", None) if spark is not None else None
            given = given or environment.get(f"LODESTONE_{f.name.upper()}", "")
            if given.strip():
                told[f.name] = given.strip()
        return cls(**told)

    def models(self, field: str) -> list[str]:
        """The names of a list of models, first choice first."""
        return [x.strip() for x in getattr(self, field).split(",") if x.strip()]
