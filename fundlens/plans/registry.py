"""Registry of named queries and of the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def register(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"query registered twice: {name}")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql.strip()
            return plan

        return register


catalog = Catalog()
