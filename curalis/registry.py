"""All registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from curalis.plans import bindings, files, nested, observers, rawrecords, registries, review, scopes  # noqa: F401  (each adds its queries)


def queries() -> dict:
    return dict(bindings.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(bindings.SQL)
