import itertools
import math
import random

import pytest

from gyeol.operators.unit_solver import solve_units

SCALES = [1.0, 1e3, 1e6, 1e8]
SCHEMA = "id int, a double, b double, c double, d double, solved_a string"


def solve(spark, rows, unknowns=None, identities=None, **k):
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA)
    out = solve_units(df, unknowns or {"a": SCALES}, identities or [{"a": 1, "b": -1}, {"a": 1, "c": -1, "d": -1}], **k)
    return [(r.solved_a, r.solved_unique, r.solved_identities) for r in out.orderBy("id").collect()]


def test_cases(spark):
    rows = [
        (5.0, 5e6, None, None), (5.0, 5.01e3, 50.0, 100.0), (5.0, None, None, None), (None, 5.0, 1.0, 1.0), (0.0, 5.0, 1.0, 1.0), (-5.0, 5.0, None, None),
        (5.0, 5e4, None, None), (5.0, 5e3, 5.0, 1.0), (5.0, float("nan"), None, None), (5.0, 5e6, None, None),
    ]
    got = solve(spark, rows)
    assert got[0] == (1e6, True, 1) and got[1] == (1e3, True, 2)
    assert [g[0] for g in got[2:6]] == [None] * 4
    assert got[6][0] is None  # no scale comes near
    assert got[7][0] is None  # both identities can't hold
    assert got[8][2] == 0 and got[9] == got[0]
    assert solve(spark, []) == []


def test_not_unique(spark):
    got = solve(spark, [(5.0, 5e3, None, None)], {"a": [1e3, 1.2e3]}, [{"a": 1, "b": -1}])
    assert got == [(1e3, False, 1)]


def test_two_unknowns_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(60):
        b, c, d = (10 ** rnd.uniform(3, 9) for _ in range(3))
        rows.append((c * d / rnd.choice(SCALES) * rnd.uniform(0.98, 1.02), b, c, d))
    ids = [{"a": 1, "c": -1, "d": -1}, {"a": 1, "b": -1}]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], SCHEMA)
    out = solve_units(df, {"a": SCALES, "b": [1.0, 10.0, 1e6]}, ids, tol=100.0, prefix="u_").orderBy("id").collect()
    for (a, b, c, d), r in zip(rows, out, strict=True):
        cost = {(x, y): abs(math.log(a * x / c / d)) + abs(math.log(a * x / b / y)) for x, y in itertools.product(SCALES, [1.0, 10.0, 1e6])}
        assert math.isclose(cost[r.u_a, r.u_b], min(cost.values()), abs_tol=1e-9) and math.isclose(r.u_residual, min(cost.values()), abs_tol=1e-6)


def test_too_many_combinations(spark):
    with pytest.raises(ValueError):
        solve_units(spark.createDataFrame([], SCHEMA), {c: [float(x) for x in range(1, 20)] for c in "abc"}, [])


def test_found_is_whole(spark, tiny):
    """Every row of a company with a value comes out, and no amount in won does."""
    from gyeol.plans import units
    from gyeol.session import table

    found = units.p2_found(spark, tiny)
    assert found.where("field = 'market_cap'").count() == table(spark, tiny, "company").where("market_cap is not null").count()
    assert found.where("unit_value is null").count() == 0


def test_every_won_scale_is_solved(spark):
    """An unstated amount in any unit that the readers know is found by its identity, and by one only."""
    from gyeol.functions.units import SCALES as STATED
    from gyeol.functions.units import WON_SCALES

    factors = sorted({1.0, *STATED.values()})
    rows = [(2.5e12 / f, 2.5e12 * 1.02, None, None) for f in factors]
    assert solve(spark, rows, {"a": WON_SCALES}, [{"a": 1, "b": -1}]) == [(f, True, 1) for f in factors]
