"""JSON Lines in and out, with the semantics of a strict line reader."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.text import SPACE


class MalformedLine(ValueError):
    """A line that is no JSON."""


def read_strict(spark: SparkSession, path: str, fields: dict[str, str], raw: str | None = "raw") -> DataFrame:
    """Objects of a JSON Lines file: blank lines are skipped, lines that are no object dropped,
    a malformed line ends the read with an error.

    `fields` maps names to string, bigint, double, boolean or json. A value of another type
    counts as missing; json keeps any value as Python's JSON text. `raw` names a column with
    the whole line. Of repeated keys the last counts. An empty file gives no rows.
    """
    kinds = {"string": (str,), "bigint": (int,), "double": (int, float), "boolean": (bool,), "json": (object,)}
    ddl = ", ".join([f"{n} {'string' if k == 'json' else k}" for n, k in fields.items()] + ([f"{raw} string"] if raw else []))
    struct = T.StructType.fromDDL(ddl)

    def cell(value, kind: str):
        if kind == "json":
            return None if value is None else json.dumps(value, ensure_ascii=False)
        if isinstance(value, bool) and kind != "boolean" or not isinstance(value, kinds[kind]):
            return None
        return float(value) if kind == "double" else value

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in struct}
            for line in batch.column(0).to_pylist():
                text = line.strip()
                if not text:
                    continue
                try:
                    item = json.loads(text)
                except ValueError as e:
                    raise MalformedLine(f"{e}: {text[:200]}") from e
                if isinstance(item, dict):
                    for n, k in fields.items():
                        out[n].append(cell(item.get(n), k))
                    if raw:
                        out[raw].append(text)
            from pyspark.sql.pandas.types import to_arrow_schema

            schema = to_arrow_schema(struct)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return spark.read.text(path).select("value").mapInArrow(run, struct)


def read_fast(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The same for trusted files with a known schema, inside the JVM: lines that do not start
    an object are dropped, malformed objects end the read with an error."""
    kind = schema.simpleString() if isinstance(schema, T.StructType) else f"struct<{schema}>"
    lines = spark.read.text(path).select(F.regexp_replace("value", f"^{SPACE}+", "").alias("line")).where(F.col("line").startswith("{"))
    return lines.select(F.from_json("line", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write(rows: DataFrame, path: str) -> None:
    """One object a line, NULLs kept, non-ASCII signs as they are; an old result is replaced."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
