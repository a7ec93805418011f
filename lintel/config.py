"""Config files: scoring weights and jurisdictions."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

CONFIG_DIR = Path(__file__).resolve().parent.parent / "config"


def load_weights(path: str | Path = CONFIG_DIR / "scoring.yaml") -> dict[str, int]:
    return {k: int(v) for k, v in yaml.safe_load(Path(path).read_text()).items()}


def load_jurisdictions(spark: SparkSession,
                       path: str | Path = CONFIG_DIR / "jurisdictions.yaml") -> DataFrame:
    rows = yaml.safe_load(Path(path).read_text())
    names = ["jurisdiction_id", "slug", "display_name", "county", "timezone",
             "request_gap_seconds", "enabled", "source_verified"]
    return spark.createDataFrame(
        [tuple(r[n] for n in names) for r in rows],
        "jurisdiction_id int, slug string, display_name string, county string, "
        "timezone string, request_gap_seconds int, enabled boolean, source_verified boolean")
