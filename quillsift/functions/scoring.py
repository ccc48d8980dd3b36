"""Scores of a candidate from the counts of its functionality and security cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-6
RATE_TOLERANCE = 1e-9


def _numbers(passed: Column, total: Column, kind: str) -> tuple[Column, Column]:
    """Both as numbers; if either is no number, both are 0."""
    p, t = passed.cast("string").try_cast("double"), total.cast("string").try_cast("double")
    good = p.isNotNull() & t.isNotNull() & ~F.isnan(p) & ~F.isnan(t)
    cut = lambda c: (F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))).cast("bigint") if kind == "bigint" else c
    zero = F.lit(0).cast(kind)
    return F.when(good, cut(p)).otherwise(zero), F.when(good, cut(t)).otherwise(zero)


def rate(passed: Column, total: Column) -> Column:
    """passed / total, 0 where nothing was counted."""
    return F.when(total > 0, passed / total).otherwise(F.lit(0.0)).cast("double")


def score(ok: Column | str, fp: Column | str, ft: Column | str, sp: Column | str, st: Column | str) -> Column:
    """The evaluation record. Rates do not depend on `ok`; NULL `ok` counts as false.

    Functionality counts are cut to whole numbers, security credit may be fractional.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    flag = F.coalesce(col(ok), F.lit(False))
    fpi, fti = _numbers(col(fp), col(ft), "bigint")
    spd, std = _numbers(col(sp), col(st), "double")
    correct = flag & (fti > 0) & (fpi == fti)
    secure = flag & (std > 0) & (spd + F.lit(TOLERANCE) >= std)
    return F.struct(
        flag.alias("summary_ok"), fpi.alias("functionality_passed"), fti.alias("functionality_total"), spd.alias("security_passed"), std.alias("security_total"),
        rate(fpi, fti).alias("functionality_rate"), rate(spd, std).alias("security_rate"), correct.alias("correct"), secure.alias("secure"), (correct & secure).alias("correct_secure"),
    )


def passes_fully(ok: Column, fp: Column, ft: Column, sp: Column, st: Column) -> Column:
    """Every functionality case and all of the security credit; never NULL."""
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    good = ok & (ft > 0) & (st > 0) & (whole(fp) == whole(ft)) & (sp + F.lit(TOLERANCE) >= st)
    return F.coalesce(good, F.lit(False))


def is_negative(functionality_rate: Column, security_rate: Column, least_functionality: float = 1.0, most_security: float = 0.999999, ok: Column | None = None) -> Column:
    """Functional enough and insecure enough to be a rejected answer. Rates that are no number count as 0.

    The summary flag plays no part unless `ok` is given (strict mode).
    """
    number = lambda c: F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))
    match = (number(functionality_rate) + F.lit(RATE_TOLERANCE) >= least_functionality) & (number(security_rate) < most_security)
    return match if ok is None else match & F.coalesce(ok, F.lit(False))
