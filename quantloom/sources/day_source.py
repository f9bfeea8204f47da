"""Day files as a data source of Spark: ``spark.read``, ``spark.readStream`` and ``df.write`` with ``format("day_files")``.

A folder holds a file a symbol, ``<symbol>.day`` (the symbol percent-encoded), of 32-byte records. What the folder is on is
reached from the tasks by a path or a URI (local or shared file systems, HDFS, object stores).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from quantloom.sources.files import DAY_RECORD

SCHEMA = "symbol string, dt date, open double, high double, low double, close double, volume double, amount double"
_TYPES = pa.schema([("symbol", pa.string()), ("dt", pa.date32()), *((c, pa.float64()) for c in ("open", "high", "low", "close", "volume", "amount"))])
#: Bytes that one task reads, unless the option splitBytes says otherwise.
SPLIT_BYTES = 64 << 20
#: Records are made into batches of so many rows.
BATCH_ROWS = 1 << 16
FIRST_DAY = 19900101
Slice = tuple[str, int, int]


@dataclass
class Files(ds.InputPartition):
    """What one task reads: (path, first record, records) of each file."""

    slices: list[Slice]


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _symbol(path: str) -> str:
    return unquote(path.rsplit("/", 1)[-1].removesuffix(".day"))


def sizes(path: str) -> dict[str, int]:
    """Whole records of each day file; none if there is no folder."""
    store, root = _open(path)
    found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return {f.path: f.size // DAY_RECORD.itemsize for f in found if f.is_file and f.path.endswith(".day") and not f.base_name.startswith(("_", "."))}


def packed(slices: Iterable[Slice], most: int) -> list[Files]:
    """Slices in tasks of at most ``most`` records: small files share a task, a large one is cut."""
    tasks, room = [], 0
    for path, first, n in slices:
        while n > 0:
            if room == 0:
                tasks.append(Files([]))
                room = most
            take = min(n, room)
            tasks[-1].slices.append((path, first, take))
            first, n, room = first + take, n - take, room - take
    return tasks


def _batch(symbol: str, r: np.ndarray) -> pa.RecordBatch:
    d = r["day"].astype(np.int64)
    days = (((d // 10000 - 1970).astype("M8[Y]").astype("M8[M]") + (d // 100 % 100 - 1)).astype("M8[D]") + (d % 100 - 1)).astype("M8[D]")
    columns = [pa.array([symbol] * len(r), pa.string()), pa.array(days, pa.date32())]
    columns += [pa.array(r[c] / 100.0) for c in ("open", "high", "low", "close", "volume")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(r["amount"].astype(float))], schema=_TYPES)


def _days(r: np.ndarray) -> np.ndarray:
    """Records with a day of the calendar, from 1990 on."""
    d = r["day"].astype(np.int64)
    y, m, day = d // 10000, d // 100 % 100, d % 100
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 1, 12) - 1] + ((m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    return (d >= FIRST_DAY) & (y <= 9999) & (m >= 1) & (m <= 12) & (day >= 1) & (day <= length)


def read_slices(path: str, slices: list[Slice], low: int = 0, high: int = 99999999) -> Iterator[pa.RecordBatch]:
    """The bars of the slices whose day, as a number like 20240131, is from ``low`` to ``high``."""
    store, _ = _open(path)
    for file, first, n in slices:
        with store.open_input_file(file) as f:
            for at in range(first, first + n, BATCH_ROWS):
                take = min(BATCH_ROWS, first + n - at)
                r = np.frombuffer(f.read_at(take * DAY_RECORD.itemsize, at * DAY_RECORD.itemsize), dtype=DAY_RECORD)
                r = r[_days(r) & (r["day"] >= low) & (r["day"] <= high)]
                if len(r):
                    yield _batch(_symbol(file), r)


def _number(day: dt.date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


class DayReader(ds.DataSourceReader):
    """Conditions on the symbol choose the files, conditions on the day the records; both are met here and not tested again."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.low, self.high = path, most, 0, 99999999
        self.symbols: set[str] | None = None

    def _only(self, names: Iterable[str]) -> None:
        self.symbols = set(names) if self.symbols is None else self.symbols & set(names)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            match f:
                case ds.EqualTo(("symbol",), str(name)):
                    self._only([name])
                case ds.In(("symbol",), names) if all(isinstance(n, str) for n in names):
                    self._only(names)
                case ds.EqualTo(("dt",), dt.date() as day):
                    self.low, self.high = max(self.low, _number(day)), min(self.high, _number(day))
                case ds.GreaterThanOrEqual(("dt",), dt.date() as day):
                    self.low = max(self.low, _number(day))
                case ds.GreaterThan(("dt",), dt.date() as day):
                    self.low = max(self.low, _number(day) + 1)
                case ds.LessThanOrEqual(("dt",), dt.date() as day):
                    self.high = min(self.high, _number(day))
                case ds.LessThan(("dt",), dt.date() as day):
                    self.high = min(self.high, _number(day) - 1)
                case ds.IsNotNull(("symbol",)) | ds.IsNotNull(("dt",)):
                    pass
                case _:
                    yield f

    def partitions(self) -> list[Files]:
        found = sorted(sizes(self.path).items())
        return packed(((p, 0, n) for p, n in found if self.symbols is None or _symbol(p) in self.symbols), self.most)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        # Spark reads one partition, None, where partitions() names none
        return read_slices(self.path, partition.slices if partition else [], self.low, self.high)


class DayStream(ds.DataSourceStreamReader):
    """Records that were added to the files, and new files. The offset holds the records of each file, so it grows with the number
    of symbols only; a file that became shorter was written anew and is delivered from its start."""

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.path)

    def partitions(self, start: dict, end: dict) -> list[Files]:
        def grown() -> Iterator[Slice]:
            for path, n in sorted(end.items()):
                first = start.get(path, 0)
                first = first if first <= n else 0
                yield path, first, n - first

        return packed(grown(), self.most)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        return read_slices(self.path, partition.slices if partition else [])


class DayWriter(ds.DataSourceArrowWriter):
    """Files of the symbols that are written replace those of the folder; all other files stay, unless the mode is overwrite.

    A symbol's bars must be in one partition, in order of days (``repartition("symbol")``, ``sortWithinPartitions("symbol",
    "dt")``). Files are staged under a name of their own and moved when all tasks are done, so a task that ran twice leaves one.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        staged = f"{root}/_staged-{self.run}/{uuid.uuid4().hex}"
        names, now, out = [], None, None
        try:
            for batch in iterator:
                for symbol, r in records(batch):
                    if symbol != now:
                        if out:
                            out.close()
                        name = f"{staged}/{quote(symbol, safe='')}.day"
                        if name in names:
                            raise ValueError(f"bars of {symbol} are not together; repartition and sort by symbol and dt")
                        store.create_dir(staged, recursive=True)
                        now, out = symbol, store.open_output_stream(name)
                        names.append(name)
                    out.write(r.tobytes())
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        names = [n for m in messages if m for n in m.names]
        last = [n.rsplit("/", 1)[-1] for n in names]
        if len(set(last)) < len(last):
            self.abort(messages)
            raise ValueError("bars of a symbol are in several partitions; repartition by symbol")
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for old in sizes(self.path):
                if old.rsplit("/", 1)[-1] not in last:
                    store.delete_file(old)
        for name, to in zip(names, last, strict=True):
            store.move(name, f"{root}/{to}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: pafs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_staged-{self.run}").type == pafs.FileType.Directory:
            store.delete_dir(f"{root}/_staged-{self.run}")


def records(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """The records of a batch, run by run of one symbol. Prices and volumes become hundredths, halves go up."""
    column = {n: batch.column(batch.schema.get_field_index(n)) for n in _TYPES.names}
    if any(c.null_count for c in column.values()):
        raise ValueError("a day file holds no nulls")
    days = column["dt"].cast(pa.date32()).to_numpy(zero_copy_only=False).astype("M8[D]")
    years, months = days.astype("M8[Y]"), days.astype("M8[M]")
    made = np.zeros(batch.num_rows, dtype=DAY_RECORD)
    made["day"] = (years.astype(int) + 1970) * 10000 + ((months - years).astype(int) + 1) * 100 + (days - months).astype(int) + 1
    for name in ("open", "high", "low", "close", "volume"):
        hundredths = np.floor(column[name].to_numpy(zero_copy_only=False) * 100 + 0.5)
        if not ((hundredths >= 0) & (hundredths < 2**32)).all():
            raise ValueError(f"{name} does not fit a day file")
        made[name] = hundredths
    made["amount"] = column["amount"].to_numpy(zero_copy_only=False)
    symbols = column["symbol"].to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]) if len(symbols) else []
    for first, end in zip(starts, [*starts[1:], len(symbols)], strict=True):
        yield symbols[first], made[first:end]


class DayFiles(ds.DataSource):
    """Options: ``path``, or the argument of load and save; ``splitBytes``, what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def _most(self) -> int:
        return max(1, int(self.options.get("splitBytes", SPLIT_BYTES)) // DAY_RECORD.itemsize)

    def reader(self, schema: StructType) -> DayReader:
        return DayReader(self._path(), self._most())

    def streamReader(self, schema: StructType) -> DayStream:
        return DayStream(self._path(), self._most())

    def writer(self, schema: StructType, overwrite: bool) -> DayWriter:
        return DayWriter(self._path(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DayFiles)
