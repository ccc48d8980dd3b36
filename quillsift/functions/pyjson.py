"""JSON as Python writes it, for text whose bytes matter."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillsift.functions.plain import for_prompt


def dumps(value: Any, indent: int | None = None) -> str:
    """json.dumps without ASCII escapes."""
    return json.dumps(for_prompt(value), ensure_ascii=False, indent=indent)


def rewritten(text: Column | str, indent: int | None = None) -> Column:
    """JSON text as Python's json.dumps writes it; text that is no JSON stays NULL."""

    @F.pandas_udf(StringType())
    def one(column: pd.Series) -> pd.Series:
        def again(x):
            try:
                return dumps(json.loads(x), indent)
            except (TypeError, ValueError, RecursionError):
                return None

        return column.map(again)

    return one(text)
