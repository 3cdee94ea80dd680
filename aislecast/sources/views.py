"""Aggregates kept up to date by changes: state that can be added up, and only the partitions that a change touches written again.

The state has a row per key (and value of a column whose distinct values are counted): how many rows, and sums. A change is rows with
``sign`` 1 (new) or -1 (withdrawn); its state is added to the old one, and what counts no rows any more goes. Sums of decimals and
integers are exact, so the view after any changes equals the aggregate of all rows that are left; distinct values are counted
exactly, since a value goes only with its last row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versioned

SIGN, ROWS = "sign", "rows"


@dataclass(frozen=True)
class View:
    """A view at ``path`` in buckets of ``partition``, an expression over ``keys``: sums by output name, and distinct counts of one column."""

    path: str
    keys: Sequence[str]
    partition: str
    sums: Mapping[str, str] = field(default_factory=dict)
    distinct: str | None = None

    def _bucket(self):
        return F.expr(self.partition).cast("string")

    def _fine(self) -> list[str]:
        return [*self.keys, *([self.distinct] if self.distinct else [])]

    def _state(self, changes: DataFrame) -> DataFrame:
        kinds = dict(changes.dtypes)
        signed = {name: F.sum(F.col(SIGN) * F.col(c)).cast("decimal(38,4)" if kinds[c].startswith("decimal") else "long" if kinds[c] in ("tinyint", "smallint", "int", "bigint") else "double") for name, c in self.sums.items()}
        return changes.groupBy(*self._fine()).agg(F.sum(SIGN).cast("long").alias(ROWS), *[c.alias(n) for n, c in signed.items()])

    def create(self, rows: DataFrame) -> int:
        """The state of all ``rows`` as version 1."""
        return versioned.create_by(self._state(rows.withColumn(SIGN, F.lit(1))), self.path, self._bucket())

    def apply(self, changes: DataFrame) -> int:
        """The next version: the state with ``changes`` (rows with a sign) added; partitions without a change keep their files."""
        spark = changes.sparkSession
        base = versioned.manifest(spark, self.path)
        delta = self._state(changes).withColumn(versioned.BUCKET, self._bucket())
        touched = versioned.touched_buckets(delta)
        if not touched:
            return base.version
        old = versioned.read(spark, self.path, base.version, touched).withColumn(versioned.BUCKET, self._bucket())
        kinds = dict(old.dtypes)
        added = [F.sum(c).cast(kinds[c]).alias(c) for c in (ROWS, *self.sums)]
        merged = old.unionByName(delta).groupBy(*self._fine(), versioned.BUCKET).agg(*added)
        gone = merged.filter(F.col(ROWS) < 0).limit(1).count()
        if gone:
            raise ValueError("more rows withdrawn than there are")
        columns = [c for c in old.columns if c != versioned.BUCKET]
        return versioned.replace(merged.filter(F.col(ROWS) > 0).select(*columns, versioned.BUCKET), self.path, base, touched)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """Keys, ``rows``, the sums, and ``distinct_<column>`` where one is counted."""
        state = versioned.read(spark, self.path, version)
        if not self.distinct:
            return state
        kinds = dict(state.dtypes)
        totals = [F.sum(c).cast(kinds[c]).alias(c) for c in (ROWS, *self.sums)]
        return state.groupBy(*self.keys).agg(*totals, F.count(self.distinct).alias(f"distinct_{self.distinct}"))
