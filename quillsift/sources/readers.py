"""Where rows come from: files, versioned snapshots, dimensions, settings."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from quillsift.sources import storage
from quillsift.sources.jsonl import read_fast

PREFERENCE_DDL = "prompt array<struct<role:string,content:string>>, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"


def snapshot(spark: SparkSession, root: str, dataset: str, split: str, revision: str | None = None, kind: str = "parquet") -> DataFrame:
    """A split of a dataset kept as root/dataset/revision/split; the newest revision by name if none is given."""
    base = f"{root.rstrip('/')}/{dataset}"
    if revision is None:
        found = storage.names(spark, base)
        if not found:
            raise FileNotFoundError(base)
        revision = found[-1]
    return spark.read.format(kind).load(f"{base}/{revision}/{split}")


def rows_from(spark: SparkSession, jsonl: str | None, ddl: str | None = None, **hub: str) -> DataFrame:
    """JSON Lines if a path is given, else a snapshot."""
    if jsonl:
        return read_fast(spark, jsonl, ddl or PREFERENCE_DDL)
    return snapshot(spark, **hub)


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preference rows of a JSON Lines file, only the columns a trainer needs."""
    return read_fast(spark, path, PREFERENCE_DDL)


def dimension(spark: SparkSession, entries: dict[str, str], key: str = "cwe", value: str = "description") -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(list(entries.items()), f"{key} string, {value} string")


_SETTING = re.compile(r"^[ \t]*(?:export[ ]+)?([^\s#=][^=\n]*?)[ \t]*=[ \t]*(?:(['\"])(.*)\2|(.*?))[ \t]*$", re.M)


def parse_settings(text: str) -> dict[str, str]:
    """The settings of a text: one name=value a line, `export` and a pair of quotes left out, other lines ignored."""
    return {m[1]: m[3] if m[2] else m[4] for m in _SETTING.finditer(text)}


def load_settings(*paths: str, override: bool = False) -> dict[str, str]:
    """Puts settings files into the environment in turn; what is set stays, unless override."""
    loaded = {}
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                for name, value in parse_settings(file.read()).items():
                    if override or name not in os.environ:
                        os.environ[name] = value
                        loaded[name] = value
    return loaded
