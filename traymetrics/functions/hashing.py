"""Deterministic 32-bit hashes and draws as JVM expressions (no overflow under ANSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traymetrics.functions.numbers import as_col

# fixed values: FNV-1a offset and prime, 32-bit mask, first-draw increment
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
MASK32 = 4294967295
DRAW_STEP = 1831565813


def u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK32))


def mul32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product, by 16-bit halves so that no step leaves 64 bits."""
    high = F.shiftleft(F.shiftright(a, 16) * b % F.lit(65536), 16)
    return u32(high + a.bitwiseAND(F.lit(65535)) * b)


def fnv1a32(s) -> Column:
    """F-17."""
    chars = F.filter(F.split(as_col(s), ""), lambda ch: ch != "")
    return F.aggregate(
        chars,
        F.lit(FNV_OFFSET).cast("long"),
        lambda h, ch: u32(h.bitwiseXOR(F.ascii(ch).cast("long")) * F.lit(FNV_PRIME)),
    )


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def first_draw(seed: Column) -> Column:
    """F-18: first uniform draw in [0, 1) for a 32-bit seed."""

    def rest(t: Column) -> Column:
        r0 = mul32(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
        r1 = _bind(r0, lambda r: r.bitwiseXOR(u32(r + mul32(r.bitwiseXOR(F.shiftright(r, 7)), r.bitwiseOR(F.lit(61))))))
        return _bind(r1, lambda r: r.bitwiseXOR(F.shiftright(r, 14)))

    return _bind(u32(seed.cast("long") + F.lit(DRAW_STEP)), rest).cast("double") / F.lit(4294967296.0)


def draw_int(seed: Column, low, high) -> Column:
    lo, hi = as_col(low).cast("long"), as_col(high).cast("long")
    return lo + F.floor(first_draw(seed) * (hi - lo + 1)).cast("long")


# fixed value: generator label that is part of the entropy key
ATTENDANCE_VERSION = "attendance-gen-v1"


def attendance_seed(hall, service, date, seed=None) -> Column:
    """The stored seed: the configured one, else hall|service|date."""
    own = F.concat_ws("|", as_col(hall), as_col(service), F.date_format(as_col(date), "yyyy-MM-dd"))
    if seed is None:
        return own
    return F.coalesce(F.when(as_col(seed) != "", as_col(seed)), own)


def attendance_count(hall, service, date, low=300, high=1200, seed=None) -> Column:
    """F-18: simulated attendance of one service; equal inputs give equal counts."""
    own = attendance_seed(hall, service, date)
    stored = attendance_seed(hall, service, date, seed)
    key = F.when(stored == own, F.concat_ws("|", F.lit(ATTENDANCE_VERSION), own)).otherwise(
        F.concat_ws("|", F.lit(ATTENDANCE_VERSION), stored, own)
    )
    lo = F.lit(low) if isinstance(low, int) else low
    hi = F.lit(high) if isinstance(high, int) else high
    return draw_int(fnv1a32(key), lo, hi)


def demo_random(key) -> Column:
    """F-19: FNV-1a, then three xor-shift steps on 32 bits."""

    def xorshift(h: Column) -> Column:
        a = _bind(h, lambda v: u32(v.bitwiseXOR(u32(F.shiftleft(v, 13)))))
        b = _bind(a, lambda v: v.bitwiseXOR(F.shiftright(v, 17)))
        return _bind(b, lambda v: u32(v.bitwiseXOR(u32(F.shiftleft(v, 5)))))

    return xorshift(fnv1a32(key)).cast("double") / F.lit(4294967296.0)


def demo_int(key, low: Column, high: Column) -> Column:
    return low + F.floor(demo_random(key) * (high - low + 1)).cast("long")
