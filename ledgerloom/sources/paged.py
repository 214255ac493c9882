"""A paged service as a table.

A service gives rows in order of an integer key, some at a time, and a token (or a link)
for what follows. A caller's client says how to ask it; reading is a Spark data source:
partitions are ranges of the key, each read page by page with retries; conditions on the
key narrow the ranges, conditions that the service takes go to it, all others stay with
Spark. A page that repeats or goes back is an error, so no row comes twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ledgerloom.sources import files
from ledgerloom.sources.sinks import with_retry

#: Rows of a page (fixed value of the service protocol).
PAGE = 256
#: A condition for a service: column, operator (``==`` or ``in``), value.
Condition = tuple[str, str, Any]


class Service(Protocol):
    """What a client offers; it is copied to the executors."""

    #: Columns as DDL, and the integer column that pages are in order of (unique, not null).
    schema: str
    key: str

    def bounds(self) -> tuple[int, int] | None:
        """The smallest and the largest key; None without rows."""

    def takes(self, column: str, op: str) -> bool:
        """Whether the service itself judges such conditions, just as SQL does."""

    def page(self, low: int, high: int, token: str | None, size: int, conditions: list[Condition]) -> tuple[list[dict], str | None]:
        """Up to ``size`` rows with a key from ``low`` to ``high``, and the token for those after them; ``sinks.Refused`` to be asked again."""


@dataclass
class _Range(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, service: Service, schema: StructType, partitions: int, size: int) -> None:
        self.service, self.names, self.n, self.size = service, schema.names, partitions, size
        self.low: int | None = None
        self.high: int | None = None
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        key = (self.service.key,)
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and f.attribute == key and isinstance(f.value, int):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
                if not isinstance(f, EqualTo):
                    continue
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and f.attribute == key and isinstance(f.value, int):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)
            elif isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and self.service.takes(f.attribute[0], op := "==" if isinstance(f, EqualTo) else "in"):
                self.conditions.append((f.attribute[0], op, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        bounds = with_retry(self.service.bounds)
        if bounds is None:
            return []
        low = bounds[0] if self.low is None else max(bounds[0], self.low)
        high = bounds[1] if self.high is None else min(bounds[1], self.high)
        if low > high:
            return []
        n = max(1, min(self.n, high - low + 1))
        cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [_Range(a, b - 1) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # what Spark makes of no partitions
            return
        token, last = None, partition.low - 1
        while True:
            rows, following = with_retry(self.service.page, partition.low, partition.high, token, self.size, self.conditions)
            for row in rows:
                at = row[self.service.key]
                if not last < at <= partition.high:
                    raise ValueError(f"a row out of order: {at} after {last}, up to {partition.high}")
                last = at
                yield tuple(row.get(n) for n in self.names)
            if following is None:
                return
            if following == token:
                raise ValueError(f"a page that leads to itself: {token}")
            token = following


def read(spark: SparkSession, service: Service, partitions: int = 16, size: int = PAGE) -> DataFrame:
    """All rows of a service as a DataFrame. Filters on it are pushed down as far as the service goes."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged"

        def schema(self) -> str:
            return service.schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(service, schema, partitions, size)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return spark.read.format("paged").load()


#: Where keys are not in order: bytes that a service holds at a time, and rows of the first stretch, before it knows how long rows are.
HELD, FIRST = 32 << 20, 1 << 8


class TableService:
    """A service over a Parquet table, for trials: pages by the last key as token. Of a range it holds the keys and a stretch of rows."""

    def __init__(self, path: str, key: str, schema: str, taken: tuple[str, ...] = ()) -> None:
        self.path, self.key, self.schema, self.taken = path, key, schema, taken
        self._keys: tuple | None = None
        self._held: tuple | None = None
        self._coming: Iterator[pa.Table] | None = None
        self._rows = FIRST

    def _batches(self, condition, low: int | None, high: int | None, columns: list[str] | None = None) -> Iterator[pa.Table]:
        """Some rows at a time, of row groups that may have keys from low to high; not whole row groups, as a scanner reads them."""
        fs, path = files.open_fs(self.path)
        for name in ds.dataset(path, filesystem=fs, format="parquet").files:
            with fs.open_input_file(name) as f:
                file = pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20)
                at, groups = file.schema.names.index(self.key), []
                for g in range(file.num_row_groups):
                    known = file.metadata.row_group(g).column(at).statistics
                    if known is None or not known.has_min_max or low is None or (known.max >= low and known.min <= high):
                        groups.append(g)
                for batch in file.iter_batches(1 << 10, row_groups=groups, columns=columns, use_threads=False):
                    table = pa.Table.from_batches([batch])
                    yield table if condition is None else table.filter(condition)

    def bounds(self) -> tuple[int, int] | None:
        found = [pc.min_max(t.column(self.key)).as_py() for t in self._batches(None, None, None, [self.key])]
        found = [x for x in found if x["min"] is not None]
        return (min(x["min"] for x in found), max(x["max"] for x in found)) if found else None

    def takes(self, column: str, op: str) -> bool:
        return column in self.taken

    def page(self, low: int, high: int, token: str | None, size: int, conditions: list[Condition]) -> tuple[list[dict], str | None]:
        key = ds.field(self.key)
        where = (key >= low) & (key <= high)
        for column, op, value in conditions:
            where = where & (ds.field(column) == value if op == "==" else ds.field(column).isin([v for v in value if v is not None]))
        asked = (low, high, repr(conditions))
        if self._keys is None or self._keys[0] != asked:  # the keys of a range once
            narrow = [self.key, *dict.fromkeys(c[0] for c in conditions if c[0] != self.key)]
            found = np.concatenate([np.zeros(0, np.int64), *[t.column(self.key).to_numpy() for t in self._batches(where, low, high, narrow)]])
            self._keys, self._held, self._coming = (asked, np.sort(found), bool((np.diff(found) > 0).all())), None, None
        keys, in_order = self._keys[1:]
        first = 0 if token is None else int(np.searchsorted(keys, int(token), "right"))
        last = min(first + size, len(keys))
        if first == last:
            return [], None
        begin, table = self._held or (0, None)
        if in_order:  # read on from where the last page ended
            if self._coming is None or first < begin:
                self._coming, begin, table = self._batches(where, low, high), 0, None
            while table is None or begin + len(table) < last:
                more = next(self._coming)
                if table is not None:  # what was before this page goes
                    gone = min(len(table), max(0, first - begin))
                    more, begin = pa.concat_tables([table.slice(gone), more]), begin + gone
                table = more
        elif table is None or not (begin <= first and last <= begin + len(table)):
            self._held = table = None  # before the next is read
            upto = min(first + max(size, self._rows), len(keys))
            a, b = int(keys[first]), int(keys[upto - 1])
            begin, table = first, pa.concat_tables(self._batches(where & (key >= a) & (key <= b), a, b)).sort_by(self.key)
            self._rows = max(1, HELD * len(table) // max(1, table.nbytes))
        self._held = begin, table
        rows = table.slice(first - begin, last - first).to_pylist()
        return rows, str(keys[last - 1]) if last < len(keys) else None
