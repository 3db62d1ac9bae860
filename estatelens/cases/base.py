"""How a query and its SQL check are registered."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.cases.views import Inputs, ansi
from estatelens.session import configure


@dataclass
class Cases:
    """Named queries of one area, with the ANSI text each has to agree with."""

    queries: dict[str, Callable] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, check: str | None = None):
        def register(build: Callable[[Inputs], DataFrame]):
            def run(spark, sf_dir) -> DataFrame:
                return portable(build(Inputs(configure(spark), sf_dir)))

            run.__name__ = name
            run.__doc__ = build.__doc__
            self.queries[name] = run
            if check is not None:
                self.checks[name] = ansi(check)
            return build

        return register

    def include(self, other: "Cases") -> "Cases":
        self.queries.update(other.queries)
        self.checks.update(other.checks)
        return self


def portable(df: DataFrame) -> DataFrame:
    """Dates, times and decimals in a form both engines hand over alike."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.substring(c.cast("string"), 1, 19)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])
