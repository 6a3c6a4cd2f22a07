"""Configuration from YAML, and the versions of what runs."""

from __future__ import annotations

import importlib
import platform
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def read_config(path: str) -> dict:
    """The nested settings of a YAML file; an empty file has none."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def setting(config: Mapping, path: str, default=None):
    """The value at a path such as `execution.slippage_bps`."""
    here = config
    for part in path.split("."):
        if not isinstance(here, Mapping) or part not in here:
            return default
        here = here[part]
    return here


def environment(spark: SparkSession) -> DataFrame:
    """One row: versions of Python and of the libraries used, null where one is absent."""
    names = ("pyspark", "pyarrow", "pandas", "numpy", "duckdb", "tiktoken")
    found = {"python": platform.python_version(), "platform": platform.platform()}
    for name in names:
        try:
            found[name] = getattr(importlib.import_module(name), "__version__", None)
        except ImportError:
            found[name] = None
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{n} string" for n in found))
