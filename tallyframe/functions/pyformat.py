"""Python-compatible fixed-point text for doubles, as JVM expressions.

Python's ``f"{x:.{d}f}"`` rounds the exact binary value of ``x`` (half-even
only on true ties); Java's formatter rounds the shortest decimal string
half-up, so 1.25 -> '1.3' and 2.675 -> '2.68' where Python gives '1.2' and
'2.67'. Here ``x * 10^d`` is computed exactly as a sum of two doubles
(Dekker's product with Veltkamp splitting), rounded half-even on that exact
value, and the integer is printed with the decimal point inserted.
Valid for |x| * 10^d < 2^52 and d <= 15.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.util import let

_SPLIT = 134217729.0  # 2^27 + 1


def _split(a: Column):
    t = a * F.lit(_SPLIT)
    hi = t - (t - a)
    return hi, a - hi


def py_fixed(x: Column, d: int) -> Column:
    """``f"{x:.{d}f}"`` for a DOUBLE column (null stays null)."""
    scale = float(10 ** d)

    def digits_of(a):
        p = a * F.lit(scale)
        ah, al = _split(a)
        bh, bl = _split(F.lit(scale))
        err = ((ah * bh - p) + ah * bl + al * bh) + al * bl   # a * scale == p + err exactly

        def rounded(pe):
            fl = F.floor(pe["p"])
            over = ((pe["p"] - fl) - 0.5) + pe["e"]   # exact value = fl + 0.5 + over; its sign is exact, as 0.5 goes first
            up = (over > 0) | ((over == 0) & ((fl % 2) == 1))
            return F.when(up, fl + 1).otherwise(fl).cast("bigint").cast("string")
        return let(F.struct(p.alias("p"), err.alias("e")), rounded)

    def text(rs):
        digits = F.when(F.char_length(rs) < d + 1, F.lpad(rs, d + 1, "0")).otherwise(rs)
        if d == 0:
            return digits
        return let(digits, lambda g: F.concat(
            F.substring(g, F.lit(1), F.char_length(g) - d), F.lit("."),
            F.substring(g, F.char_length(g) - d + 1, F.lit(d))))

    return let(x.cast("double"), lambda v: F.when(v.isNull(), F.lit(None)).otherwise(F.concat(
        F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit("")),   # keeps -0.0
        let(digits_of(F.abs(v)), text))))


def py_fixed_dynamic(x: Column, d: Column, max_digits: int = 3) -> Column:
    """``py_fixed`` with a per-row digit count in [0, max_digits]."""
    out = py_fixed(x, max_digits)
    for k in range(max_digits - 1, -1, -1):
        out = F.when(d == k, py_fixed(x, k)).otherwise(out)
    return out
