"""All registered queries over the reference's own operators, and their SQL twins."""

from __future__ import annotations

from quirelake.plans import oracles, queries as base, retrieved, stored

FAMILIES = (stored, retrieved)


def queries() -> dict[str, base.Query]:
    found = base.queries()
    for family in FAMILIES:
        found |= {name: (lambda s, d, q=q: base.flat(q(s, d))) for name, q in family.queries().items()}
    return found


def oracle_sql() -> dict[str, str]:
    found = oracles.oracle_sql()
    for family in FAMILIES:
        found |= family.oracle_sql()
    return found
