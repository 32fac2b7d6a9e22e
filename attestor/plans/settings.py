"""Options of a run, with defaults; a value in the session's configuration under attestor.* comes first."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from attestor.plans.prompts import EXTRACTION


@dataclass(frozen=True)
class Settings:
    model: str = "none"
    prompt_version: str = "v1"
    instructions: str = EXTRACTION
    model_pairs: int = 15
    max_pages: int | None = None
    max_requests: int | None = None
    requests_per_minute: float = 12.0
    request_tasks: int = 4
    requests_per_round: int = 500
    bucket_cap: int = 120

    @classmethod
    def of(cls, spark: SparkSession, **given) -> Settings:
        """Given values, then the session's, then the defaults; a number that can't be read counts as not set."""
        out = {}
        for f in fields(cls):
            value = spark.conf.get(f"attestor.{f.name}", None)
            if value is not None:
                try:
                    out[f.name] = type(f.default)(value) if f.default is not None else int(value)
                except ValueError:
                    continue
        return cls(**(out | {k: v for k, v in given.items() if v is not None}))
