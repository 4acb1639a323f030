"""All queries of the library with their SQL."""

from __future__ import annotations

from .plans import exports, files, labels, pixels, records, register, tiepoints

FLAGSHIP = "quality_report"
PARTS = (pixels, tiepoints, labels, records, files, exports, register)


def queries() -> dict:
    return {k: f for p in PARTS for k, f in p.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PARTS for k, s in p.SQL.items()}
