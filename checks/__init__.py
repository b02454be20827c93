"""Queries over the TPC-H-like tables, each with the SQL that must give the same rows."""

from checks import charts, columns, edges, files, groups, quality, shapes, times
from checks.base import Check

CHECKS: dict[str, Check] = {}
for module in (shapes, quality, columns, times, groups, charts, edges, files):
    CHECKS.update(module.CHECKS)
