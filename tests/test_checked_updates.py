"""The checked patches of the query reach every employee."""

from __future__ import annotations

from conftest import DATA

from rosterlake.operators import patches
from rosterlake.plans.catalog import QUERIES


def test_everyone_has_a_patch(spark, monkeypatch):
    seen, apply = [], patches.apply_checked_updates

    def watched(employees, asked, *rest):
        seen.append((employees.select("employee_id"), asked.select("employee_id")))
        return apply(employees, asked, *rest)

    monkeypatch.setattr(patches, "apply_checked_updates", watched)
    QUERIES["t12_checked_updates"](spark, DATA)
    ((employees, asked),) = seen
    assert asked.count() == employees.count() > 0 and employees.exceptAll(asked).isEmpty()
