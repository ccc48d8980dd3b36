"""Text helpers shared by the training-data operators, all plain Python."""

from __future__ import annotations

import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

# Letters, digits and underscores, as `[\p{L}\p{N}_]` in the JVM (`tokens.hashed_words`).
WORD = re.compile(r"\w+")
FENCE_LINE = re.compile(r"^[ \t]*(?:`{3,}|~{3,})[ \t]*[\w+#.-]*[ \t]*$", re.M)
MISSING_WORDS = frozenset("null none nil n/a na nan undefined missing #n/a <null> (null) [null] \\n".split()) | {"not available", "no value"}
EXTENSIONS = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "java": "java", "c": "c", "h": "c"}

_BLANKS = "".join(
    chr(k) for k in [*range(0x3000 + 1), 0x3164, 0xFEFF, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE0080)]
    if unicodedata.category(chr(k)) in ("Cc", "Cf", "Zs", "Zl", "Zp") or k in (0x115F, 0x1160, 0x2800, 0x3164, 0xFFA0, 0x034F) or 0xFE00 <= k < 0xFE10
)
INVISIBLE = re.compile("[" + re.escape(_BLANKS) + "]+")
# A line that is no fence mark and holds more letters and digits than any word for a missing value.
_PROOF = re.compile(r"^(?![ \t]*(?:`{3}|~{3}))(?:[^\nA-Za-z0-9]*[A-Za-z0-9]){21}", re.M)


def words(text: str | None) -> list[str]:
    """The longest runs of letters, digits and underscores, lower-cased."""
    return WORD.findall(text.lower()) if text else []


def is_empty(text: str | None) -> bool:
    """NULL, invisible signs, fence marks, or a word for a missing value."""
    if text is None:
        return True
    if _PROOF.search(text):
        return False
    body = FENCE_LINE.sub("", text).replace("`", "").replace("~~~", "")
    body = " ".join(INVISIBLE.sub(" ", body).split())
    return not body or len(body) <= 20 and body.casefold().strip("'\".;:") in MISSING_WORDS


def language_name(lang: str | None, path: str | None) -> str:
    """`lang` without outer white space and in lower case, or that of the extension."""
    if lang is not None and (name := lang.strip().lower()):
        return name
    return EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower(), "")


def map_batches(frame: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over plain Python lists: function(dict of lists) -> dict of lists."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            found = function({name: column.to_pylist() for name, column in zip(batch.schema.names, batch.columns)})
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return frame.mapInArrow(run, struct)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The place of a public tokenizer's file; the folder is a parameter."""
    return os.path.join(folder or os.environ.get("QUILLSIFT_TOKENIZERS", "/opt/tokenizers"), name)
