"""Tenant scoping: every read of a tenant's tables goes through views that carry its predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TenantScope:
    """Tables as one tenant sees them; ``org_id`` reaches the scan as a pushed filter.

    A table without the tenant column is refused unless it is named as shared, so a
    forgotten column can't open a table to all. ``unscoped`` is the bypass role's view.
    """

    def __init__(self, load: Callable[[str], DataFrame], org_id: str, column: str = "org_id", shared: frozenset[str] = frozenset()) -> None:
        if org_id is None:
            raise ValueError("a tenant is required")
        self._load, self.org_id, self.column, self.shared = load, org_id, column, shared

    def table(self, name: str) -> DataFrame:
        df = self._load(name)
        if self.column in df.columns:
            return df.where(F.col(self.column) == F.lit(self.org_id))
        if name in self.shared:
            return df
        raise PermissionError(f"{name} has no tenant column and isn't shared")

    def unscoped(self, name: str) -> DataFrame:
        return self._load(name)
