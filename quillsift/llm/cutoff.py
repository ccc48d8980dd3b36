"""Problem 4: texts that were cut before their end.

Intact values are cut at random places, and a logistic regression over hashed features
learns to tell the pieces from the whole values: closing characters, punctuation, the
state of the last code block, marks of truncation, and the distance to the length at
which a source piles up. Every value is then scored.
"""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.pairs import line_shares, looks_like
from quillsift.llm.syntax import problem_kind, python_problem
from quillsift.llm.values import is_empty, map_batches
from quillsift.session import spread

WIDTH = 1 << 12
#: Bound of the sample of values that the model is fitted on; documented parameter.
SAMPLE = 6000
MARKS = re.compile(
    r"(?:\s*(?:…|\.{3,}|[\[(<{][^\[\](){}<>\n]{0,12}\b(?:truncated|truncation|cut|clipped|snip(?:ped)?|omitted|continued|trimmed|more|limit|\.\.\.|…)\b[^\[\](){}<>\n]{0,40}[\])>}]|[\[(<](?:…|\.\.\.)[\])>]|�+))\s*$", re.I
)
_SENTENCE_END = re.compile(r"[.!?。！？:;][\"'”’»)\]*_`]*\s*$")
_LIST_LINE = re.compile(r"\s*(?:[-*+•–]|\d+[.)])\s+\S")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[ \t]*([\w+#.-]*)[^\n]*$", re.M)
# Phrases that close a sentence with dots (fixed values).
_OPEN_END = re.compile(r"\b(?:and so on|and so forth|and more|et cetera|etc|to be continued|und so weiter|usw|y así sucesivamente|etcétera|et ainsi de suite|e così via)[\s.…]*$", re.I)
_WORD = re.compile(r"[^\W\d]\w*")


def _runs(text: str) -> bool:
    """Whether a text is valid Python or no code at all."""
    return is_empty(text) or python_problem(text) is None


def code_state(code: str) -> str:
    """How a code block ends: whole, whole in another language, broken in its last
    statement, or broken earlier."""
    error = python_problem(code)
    if error is None:
        return "whole"
    for name in ("javascript", "java", "c"):
        if problem_kind(code, name) is None:
            return "other"
    shares = line_shares(code)
    if shares:
        best = max(shares, key=shares.get)
        if best not in ("python", "javascript", "java", "c") and shares[best] >= 0.6 and looks_like(code.rstrip().rsplit("\n", 1)[-1], best):
            return "other"
    last = code.rstrip().count("\n") + 1
    line = error.lineno or last
    if line >= last or "never closed" in str(error.msg) and all(not x.strip() or x[:1].isspace() for x in code.split("\n")[line:]):
        return "last"
    if code.rstrip()[-1:] in ";}":
        return "early"
    if code.count("{") > code.count("}") and (";" in code):
        return "open"
    return "early"


def features(text: str, peak: int) -> list[str]:
    """Names of the features of one value; peak is the length its source piles up at, or 0."""
    found_mark = MARKS.search(text)
    sign = found_mark.group().strip() if found_mark else ""
    mark = "none" if not sign else "dots" if sign.strip(".") == "" else "bracket" if sign[0] in "[(<{" else "sign"
    body = MARKS.sub("", text) if sign else text
    newline = body.endswith("\n")
    core = body.rstrip()
    end = core[-1:]
    kind = "w" if end.isalnum() or end == "_" else "j" if end in "([{,+-*/%=<>&|\\^@" else end
    fences = list(_FENCE.finditer(core))
    inside = len(fences) % 2 == 1
    line = core[core.rfind("\n") + 1 :]
    before = core[: len(core) - len(line)]
    if inside:
        code = body[fences[-1].end() + 1 :]
        place = "code"
    elif fences:
        code, place = "", "after" if fences[-1].end() < len(core) else "fence"
    else:
        code = body
        place = "code" if re.search(r"[=(){};]", core) or _runs(core) else "prose"
    state = (code_state(code) if code.strip() else "none") if place == "code" else "none"
    stop = bool(_SENTENCE_END.search(core))
    listed = bool(_LIST_LINE.match(line)) and place != "code"
    lists_before = listed and bool(_LIST_LINE.match(before.rstrip("\n").rsplit("\n", 1)[-1]))
    tail = _WORD.findall(line)
    known = bool(tail) and line.endswith(tail[-1]) and _occurs(tail[-1], before)
    far = abs(len(text) - peak)
    near = "none" if not peak else "at" if far == 0 else "by" if far <= 2 else "above" if len(text) > peak else "below"
    found = [
        "bias", f"kind={kind}", f"open_end={bool(_OPEN_END.search(core))},{mark}", f"mark,known={mark},{known}", f"nl={newline}", f"mark={mark}", f"place={place}", f"state={state}", f"stop={stop}", f"list={listed}", f"near={near}",
        f"place,stop={place},{stop}", f"place,state,nl={place},{state},{newline}", f"place,list={place},{listed},{lists_before}", f"state,kind={state},{kind}", f"place,kind,nl={place},{kind},{newline}",
        f"known={known},{place}", f"place,state,stop,list,mark={place},{state},{stop},{listed},{mark}", f"near,place,stop={near},{place},{stop or listed}", f"state,near={state},{near}",
        f"return={bool(re.match(r'\s*(?:return|pass|\}|raise)', line))},{place},{newline}", f"words={min(len(tail), 4)},{listed}", f"fences={min(len(fences), 3)},{inside}",
    ]
    return found


def _occurs(word: str, text: str) -> bool:
    """Whether the word stands in the text as a word of its own."""
    k, size = text.find(word), len(word)
    while k >= 0:
        after = text[k + size : k + size + 1]
        if not (k and (text[k - 1].isalnum() or text[k - 1] == "_")) and not (after.isalnum() or after == "_"):
            return True
        k = text.find(word, k + 1)
    return False


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % WIDTH for n in names]


def judged(text: str | None) -> bool:
    """Whether a value can be a case at all: not empty, not a bare rejection."""
    return text is not None and not is_empty(text) and text.strip().strip("`\"'.").upper() != "REJECT"


def cut(text: str, draw: random.Random) -> str | None:
    """A piece of the text as a transfer or a field limit would leave it."""
    body = text.rstrip()
    if len(body) < 40:
        return None
    at = draw.randrange(max(20, len(body) // 8 if draw.random() < 0.5 else len(body) * 3 // 4), len(body) - 1)
    piece = body[:at]
    if _whole(piece):
        return None
    style = draw.random()
    if style < 0.12:
        piece += draw.choice(["…", "...", " [truncated]", f" (cut after {at} characters)", "[...]", "�"])
    elif style < 0.2:
        piece += "\n"
    return piece


def _whole(piece: str) -> bool:
    """A cut that happens to fall on the end of complete content teaches nothing."""
    fences = list(_FENCE.finditer(piece))
    if len(fences) % 2 == 1:
        return _runs(piece[fences[-1].end() + 1 :])
    if fences:
        return bool(_SENTENCE_END.search(piece))
    return _runs(piece)


def piled_lengths(values: DataFrame) -> DataFrame:
    """(source, peak): the length at which a source's values pile up, 0 if nowhere.

    A peak is the commonest length if 1 % or more of the values share it and it holds ten
    times its fair share among the lengths that occur. Counts are over all rows; values
    too short to be cut (under 40 characters) do not count.
    """
    lengths = values.where(F.length("text") >= 40).groupBy("source", F.length("text").alias("len")).count()
    by = lengths.groupBy("source").agg(F.max_by("len", F.struct("count", "len")).alias("top"), F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("kinds"))
    peak = F.when((F.col("most") >= 0.01 * F.col("all")) & (F.col("most") * F.col("kinds") >= 10 * F.col("all")) & (F.col("most") >= 3), F.col("top")).otherwise(0)
    return by.select(F.col("source").alias("_source"), peak.cast("int").alias("peak"))


def add_peaks(known: DataFrame, few: int = 4096, salts: int = 64) -> DataFrame:
    """The values with the peak of their source (0 if none).

    Sources with a peak are few as a rule: up to `few` of them go into the plan as literals
    and nothing is shuffled. Beyond that the sources are joined, each spread over `salts`
    keys so that a source with a third of all rows is no single task.
    """
    peaks = piled_lengths(known).where("peak > 0")
    found = peaks.limit(few + 1).collect()
    if len(found) <= few:
        if not found:
            return known.withColumn("peak", F.lit(0))
        pairs = F.create_map(*[F.lit(x) for r in found for x in (r["_source"], r["peak"])])
        return known.withColumn("peak", F.coalesce(F.try_element_at(pairs, F.col("source")), F.lit(0)))
    spread = peaks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = known.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, (F.col("source") == F.col("_source")) & (salted["_salt"] == spread["_salt"]), "left")
    return joined.select(*known.columns, F.coalesce("peak", F.lit(0)).alias("peak"))


def fit(examples: list[tuple[list[int], int]], rounds: int = 800, penalty: float = 2e-5) -> np.ndarray:
    """Weights of a logistic regression on hashed features, by gradient descent with momentum."""
    weights = np.zeros(WIDTH)
    if not examples:
        return weights
    size = max(len(x) for x, _ in examples)
    index = np.full((len(examples), size), WIDTH)
    for k, (x, _) in enumerate(examples):
        index[k, : len(x)] = x
    y = np.array([label for _, label in examples], dtype=float)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    balance /= len(y)
    full, speed = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for _ in range(rounds):
        z = full[index].sum(axis=1)
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        grad = np.bincount(index.ravel(), weights=np.repeat(slope, size), minlength=WIDTH + 1) + penalty * full
        speed = 0.9 * speed - 0.5 * grad
        full += speed
        full[WIDTH] = 0
    return full[:WIDTH]


def train(values: DataFrame, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Fit on a bounded sample of values and one artificial cut of each."""
    whole = 1 << 30
    share = min(whole, math.ceil(2 * sample / max(values.count(), 1) * whole))
    hashed_rows = values.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), "table_name", "row_id", "field_name"), F.lit(whole)))
    # About twice the sample passes the hash test, so no task gathers more than that.
    near = hashed_rows.where((F.col("_h") < share) & (F.length("text") >= 40))
    picked = near.orderBy("_h", "text").limit(sample).select("text", "peak")

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"x": [], "y": []}
        for text, peak in zip(batch["text"], batch["peak"]):
            if not judged(text):
                continue
            draw = random.Random(zlib.crc32(text.encode()) ^ seed)
            piece = cut(text, draw)
            if not peak or abs(len(text) - peak) > 3:  # at the peak a value is hardly intact
                # Whole values end at the peak too, by chance; some are shown that way.
                out["x"].append(hashed(features(text, len(text) - draw.choice([0, 0, 0, 1, 2]) if peak and draw.random() < 0.2 else peak or 0)))
                out["y"].append(0)
            if piece is not None:
                near = len(piece) - draw.choice([0, 0, 0, 1, 2]) if peak and draw.random() < 0.5 else peak or 0
                out["x"].append(hashed(features(piece, near)))
                out["y"].append(1)
        return out

    rows = map_batches(picked.repartition(max(2, values.sparkSession.sparkContext.defaultParallelism)), run, "x array<int>, y int").collect()
    return fit([(r["x"], r["y"]) for r in rows])


def truncated(values: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(table_name, row_id, field_name, source, score, cut) for every value that can be judged.

    `values` has table_name, row_id, field_name, source (NULL is a source of its own) and
    text. NULL, empty and REJECT values give no row; an empty table gives none; repeated
    rows are scored each.
    """
    with_peak = add_peaks(spread(values).withColumn("source", F.coalesce("source", F.lit(""))))
    weights = train(with_peak, sample)
    held = values.sparkSession.sparkContext.broadcast(weights)

    def run(batch: dict[str, list]) -> dict[str, list]:
        w = held.value
        out: dict[str, list] = {k: [] for k in ("table_name", "row_id", "field_name", "source", "score", "cut")}
        for n, text in enumerate(batch["text"]):
            if not judged(text):
                continue
            z = float(sum(w[k] for k in hashed(features(text, batch["peak"][n] or 0))))
            score = 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))
            for c in ("table_name", "row_id", "field_name", "source"):
                out[c].append(batch[c][n])
            out["score"].append(float(score))
            out["cut"].append(bool(score > threshold))
        return out

    columns = ["table_name", "row_id", "field_name", "source", "text", "peak"]
    return map_batches(with_peak.select(*columns), run, "table_name string, row_id bigint, field_name string, source string, score double, cut boolean")
