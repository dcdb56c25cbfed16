"""Quantities recorded in different units: stated units first, physical identities where none is stated.

An identity is a product of columns that must come to 1, such as ``amount = shares x price`` written
``{"amount": 1, "shares": -1, "price": -1}``. Every combination of candidate scales of the unknown
columns is tried; the one with the least sum of absolute log residuals wins. A solution is flagged as not
unique when another combination lies within ``gap`` of the best, and rejected when the mean residual of
its identities exceeds ``tol``. Row-local, JVM-side, no shuffle.

Cases: identities with a null, zero or negative value are left out; without any identity the scale is
null; ties go to the smaller combination and are flagged; repeated rows are solved alike; an empty table stays
empty. Columns named like a result are replaced, and names that start with ``__`` are reserved.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solve_units(df: DataFrame, unknowns: dict[str, list[float]], identities: list[dict[str, int]], tol: float = 0.35, gap: float = 0.35, prefix: str = "solved_") -> DataFrame:
    """``df`` with ``<prefix><col>`` (factor), ``<prefix>residual``, ``<prefix>unique`` and ``<prefix>identities``."""
    names = list(unknowns)
    combos = sorted(itertools.product(*[unknowns[n] for n in names]))
    if len(combos) > 4096:
        raise ValueError("too many unit combinations")

    def log_of(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.ln(F.when((v > 0) & ~F.isnan(v), v))

    # one stored term an identity; null where it can't be checked
    terms = [sum((log_of(c) * e for c, e in ident.items()), F.lit(0.0)) for ident in identities]
    df = df.withColumns({f"__t{i}": t for i, t in enumerate(terms)})
    table = F.array(*[F.array(*[F.lit(float(x)) for x in combo]) for combo in combos])
    log = F.create_map(*[F.lit(x) for v in sorted({float(x) for combo in combos for x in combo}) for x in (v, math.log(v))])

    def residual(combo: Column) -> Column:
        out = F.lit(0.0)
        for i, ident in enumerate(identities):
            shift = sum((F.element_at(log, combo[k]) * ident[n] for k, n in enumerate(names) if n in ident), F.lit(0.0))
            out = out + F.coalesce(F.abs(F.col(f"__t{i}") + shift), F.lit(0.0))
        return F.struct(out.alias("r"), combo.alias("combo"))

    n = sum((F.col(f"__t{i}").isNotNull().cast("int") for i in range(len(identities))), F.lit(0))
    df = df.withColumns({"__n": n, "__all": F.when(n > 0, F.array_sort(F.transform(table, residual)))})
    best, good = F.col("__all")[0], F.col("__all")[0]["r"] / F.col("__n") <= tol
    second = F.col("__all")[1]["r"] if len(combos) > 1 else F.lit(None).cast("double")
    out = {f"{prefix}{c}": F.when(good, best["combo"][k]) for k, c in enumerate(names)}
    out |= {
        f"{prefix}residual": best["r"],
        f"{prefix}identities": F.col("__n"),
        f"{prefix}unique": F.when(good, F.coalesce(second - best["r"] > gap, F.lit(True))),
    }
    return df.withColumns(out).drop("__n", "__all", *[f"__t{i}" for i in range(len(identities))])
