"""Settings, registry, seeds and folders: small driver-side inputs, and seeds and folders as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import first_by

# Defaults of the settings that queries use.
DEFAULTS: dict[str, Any] = {
    "http": {"rate": 2.0, "burst": 6, "attempts": 4},
    "browser": {"workers": 4, "queue": 256},
    "worker": {"workers": 8, "queue": 1024},
    "feed": {"interval": "5m", "deadline": "5m"},
    "good_keywords": [], "bad_keywords": [], "cv_roles": [],
    "heuristic_threshold": 0.0, "strong_threshold": 0.0, "llm_enabled": False, "hard_exclude_on_bad": False,
}
_UNITS = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}


def duration_ms(s: str | None, default: float) -> float:
    """'250ms', '1h30m' and the like in milliseconds; the default for what can't be read or isn't positive."""
    s = (s or "").strip()
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ns|us|µs|ms|s|m|h)", s)
    if not parts or "".join(n + u for n, u in parts) != s.lstrip("+"):
        return default
    total = sum(float(n) * _UNITS[u] for n, u in parts)
    return total if total > 0 else default


def _merge(base: Mapping, new: Mapping) -> dict:
    """Values of ``new`` over those of ``base``, key by key; null, blank and zero values leave the base's."""
    out = dict(base)
    for k, v in new.items():
        if isinstance(v, Mapping) and isinstance(base.get(k), Mapping):
            out[k] = _merge(base[k], v)
        elif v not in (None, "", 0) or isinstance(v, bool):
            out[k] = v
    return out


def load(path: str) -> dict:
    """A YAML file over the defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return _merge(DEFAULTS, yaml.safe_load(f) or {})


def pick_list(s: str | None, fallback: list[str]) -> list[str]:
    return [x.strip() for x in re.split(r"[\n\r,;\t]+", s or "") if x.strip()] or list(fallback)


def merge_form(base: Mapping, form: Mapping[str, str]) -> dict:
    """A submitted form over settings: lists and texts only where given, check boxes by their presence.

    A number that can't be read changes nothing; dotted names reach into nested settings.
    """
    out = {k: dict(v) if isinstance(v, Mapping) else v for k, v in base.items()}
    for name in ("good_keywords", "bad_keywords", "cv_roles"):
        out[name] = pick_list(form.get(name), base.get(name, []))
    for name in ("heuristic_threshold", "strong_threshold"):
        try:
            out[name] = float(form.get(name, "").strip())
        except ValueError:
            pass
    for name in ("llm_enabled", "hard_exclude_on_bad"):
        out[name] = name in form
    taken = {"good_keywords", "bad_keywords", "cv_roles", "heuristic_threshold", "strong_threshold", "llm_enabled", "hard_exclude_on_bad"}
    for name, value in form.items():
        if name in taken or not value.strip():
            continue
        group, _, field = name.rpartition(".")
        (out.setdefault(group, {}) if group else out)[field] = value.strip()
    return out


REGISTRY = T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("name", "source_url", "type")), T.StructField("active", T.BooleanType())])


def registry(spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Boards and feeds in their order: pos, name, source_url, type, active."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REGISTRY)


def by_type(df: DataFrame, kind: str, active_only: bool = False) -> DataFrame:
    got = df.where(F.lower(F.trim("type")) == kind.strip().lower())
    return got.where("active") if active_only else got


def by_name(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("name") == name).orderBy("pos").limit(1)


def seed_companies(df: DataFrame) -> DataFrame:
    """Rows (pos, name, careers_url) with a name; of equal names the first."""
    named = df.withColumn("name", F.trim("name")).where("name <> ''")
    return first_by(named, ["name"], ["pos"])


def companies_json(spark: SparkSession, path: str) -> DataFrame:
    """Companies of a JSON file that holds one array."""
    return spark.read.option("multiLine", True).schema("name string, careers_url string, active boolean").json(path)


def documents_in(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, name, bytes, modified) of a folder's files with a suffix in any case; contents aren't read."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.where(F.endswith(F.lower("name"), F.lit(suffix.lower())))
