"""All core queries by name, with the SQL that a second engine checks them by."""

from __future__ import annotations

from gyeol.plans import answers, base, lookups, oracle_units, relational, relations, reports, streams, units, wide  # noqa: F401  (registering)
from gyeol.plans.base import Query

_OWN: dict[str, Query] = {
    "p2_found": units.p2_found,
    "p2_normalized": units.p2_normalized,
    "p4_found": wide.p4_found,
    "p4_wide_contract": wide.p4_wide_contract,
    "p4_wide_major": wide.p4_wide_major,
    "p4_wide_holding": wide.p4_wide_holding,
}


def queries() -> dict[str, Query]:
    return _OWN | base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.ORACLES | {"p2_found": oracle_units.p2(), "p4_found": oracle_units.p4()} | {f"p4_wide_{n.split('_')[0]}": oracle_units.p4_wide(n) for n in oracle_units.WIDE}
