"""Register cells: a sink for ordered batches of updates, and a source that scans a range.

Sink ``costloom_cells``.  A row is one batch: the updates of an invoice, at most
``BATCH`` in a row, in the order they have to be made.  A task writes its batches to a
file of its own; the driver's commit names the files that count in one manifest, so a
task that ran twice counts once, and a run that fails leaves no file behind.

Source ``costloom_register``.  Reads "Sheet!B2:K9000" of a register export: files of
rows in order, and an index with the place of every ``BLOCK``-th row.  A task reads the
bytes of the blocks it was planned, and of their cells the columns of the range.
"""

from __future__ import annotations

import contextlib
import csv
import io
import json
import re
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from costloom.operators.keyed import Keys
from costloom.operators.ordered import row_numbers
from costloom.sources.files import names_in, read_all, store_of, write_all

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

BATCH = 20            # updates the register takes at a time
BLOCK = 1000          # rows between two places of the index
CELLS_SCHEMA = "invoice_id long, batch long, updates array<struct<place: long, range: string, value: double>>"


# Batches of updates

def batches(cells: DataFrame, order: list[str], size: int = BATCH, max_rows: int | None = None, measure: Keys | None = None) -> DataFrame:
    """Cell updates (invoice_id, range, value) in batches of ``size``, numbered per invoice
    from 1; ``order`` orders the updates of an invoice totally."""
    placed = row_numbers(cells, ["invoice_id"], order, "place", max_rows, measure)
    number = F.ceil(F.col("place") / size)
    listed = F.sort_array(F.collect_list(F.struct("place", "range", "value")))  # at most ``size`` updates
    return placed.groupBy("invoice_id", number.alias("batch")).agg(listed.alias("updates"))


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class CellWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = store_of(self.path)
        file, rows, out, lines = f"{base}/data/{self.job}-{uuid.uuid4().hex}.arrow", 0, None, None
        try:
            for batch in iterator:
                if out is None:
                    if self._aborted(store, base):
                        return Written("", 0)
                    store.create_dir(f"{base}/data", recursive=True)
                    out = store.open_output_stream(file)
                    lines = pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                lines.write_batch(batch)
                rows += len(batch)
        except BaseException:  # the rows ended before their end: what was written counts nowhere
            if out is not None:
                out.close()
                store.delete_file(file)
            raise
        if out is not None:
            lines.close()
            out.close()
            if self._aborted(store, base):
                with contextlib.suppress(FileNotFoundError):  # the driver was first
                    store.delete_file(file)
        return Written(file.removeprefix(f"{base}/"), rows)

    def commit(self, messages: list[Written | None]) -> None:
        """One file names all that count; files of attempts that don't are taken away."""
        store, base = store_of(self.path)
        counted = {m.file: m.rows for m in messages if m is not None and m.rows}
        write_all(store, f"{base}/manifest/{self.job}.json", json.dumps(counted).encode())
        self._drop(store, base, set(counted))

    def abort(self, messages: list[Written | None]) -> None:
        """Takes away what was written.  Tasks that are still at work when the job has failed see its mark, and leave nothing either."""
        store, base = store_of(self.path)
        write_all(store, f"{base}/aborted/{self.job}", b"")
        self._drop(store, base, set())

    def _aborted(self, store, base: str) -> bool:
        return bool(store.get_file_info(f"{base}/aborted/{self.job}").type)

    def _drop(self, store, base: str, kept: set[str]) -> None:
        for name in names_in(store, f"{base}/data"):
            short = name[name.index("data/"):] if name.startswith("data/") else "data/" + name.rsplit("/", 1)[1]
            if short.startswith(f"data/{self.job}-") and short not in kept:
                with contextlib.suppress(FileNotFoundError):  # a late task was first
                    store.delete_file(name)


@dataclass
class File(InputPartition):
    name: str


class CellReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        store, base = store_of(self.path)
        counted = [json.loads(read_all(store, m)) for m in names_in(store, f"{base}/manifest")]
        return [File(name) for files in counted for name, rows in sorted(files.items()) if rows] or [File("")]

    def read(self, partition: File):
        if partition.name:
            store, base = store_of(self.path)
            with store.open_input_stream(f"{base}/{partition.name}") as f:
                yield from pa.ipc.open_stream(f)


class Cells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "costloom_cells"

    def schema(self) -> str:
        return CELLS_SCHEMA

    def writer(self, schema, overwrite) -> CellWriter:
        return CellWriter(self.options["path"])

    def reader(self, schema) -> CellReader:
        return CellReader(self.options["path"])


def write_batches(rows: DataFrame, path: str) -> None:
    rows.sparkSession.dataSource.register(Cells)
    rows.select("invoice_id", "batch", "updates").write.format("costloom_cells").mode("append").save(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches that were committed to ``path``."""
    spark.dataSource.register(Cells)
    return spark.read.format("costloom_cells").load(path)


# Ranges

def write_register(lines: DataFrame, path: str, files: int) -> None:
    """Export register lines (``row_index``, ``value``: CSV text that starts with the row
    number) to about ``files`` files of rows in order, and their index."""
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(path)
        file, at, block = f"data/{uuid.uuid4().hex}.csv", 0, []
        store.create_dir(f"{base}/data", recursive=True)
        out = store.open_output_stream(f"{base}/{file}")

        def place(start):
            return pa.RecordBatch.from_pydict({"file": [file], "first": [block[0]], "last": [block[-1]], "start": [start], "size": [at - start]})

        start = 0
        for batch in found:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (value + "\n").encode()
                out.write(data)
                block.append(row)
                at += len(data)
                if len(block) == BLOCK:
                    yield place(start)
                    start, block = at, []
        out.close()
        if block:
            yield place(start)

    in_order = lines.select(F.col("row_index").cast("long"), "value").repartitionByRange(files, "row_index").sortWithinPartitions("row_index")
    index = in_order.mapInArrow(run, "file string, first long, last long, start long, size long")
    index.write.mode("overwrite").json(f"{path}/index")


@dataclass
class Rows(InputPartition):
    file: str
    start: int
    size: int


def column_number(letters: str) -> int:
    """Number of a column: A is 1, Z 26, AA 27."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def parse_range(text: str) -> tuple[int, int, int, int | None]:
    """First and last column, first and last row (None: to the end) of "Sheet!B2:K9000" or "B2:K"."""
    found = re.fullmatch(r"(?:.*!)?([A-Za-z]+)(\d+):([A-Za-z]+)(\d*)", text.strip())
    if not found:
        raise ValueError(f"not a range: {text}")
    a, first, b, last = found.groups()
    return column_number(a), column_number(b), int(first), int(last) if last else None


class RegisterReader(DataSourceReader):
    def __init__(self, path: str, wanted: str):
        self.path = path
        self.left, self.right, self.first, self.last = parse_range(wanted)

    def partitions(self) -> list[Rows]:
        """The blocks that have rows of the range: one entry per ``BLOCK`` rows, side by side ones as one scan."""
        store, base = store_of(self.path)
        blocks = [json.loads(x) for name in names_in(store, f"{base}/index") if name.endswith(".json") for x in read_all(store, name).splitlines()]
        hit = [b for b in blocks if b["last"] >= self.first and (self.last is None or b["first"] <= self.last)]
        out: list[Rows] = []
        for b in sorted(hit, key=lambda b: (b["file"], b["start"])):
            if out and out[-1].file == b["file"] and out[-1].start + out[-1].size == b["start"] and out[-1].size < 1 << 24:
                out[-1].size += b["size"]
            else:
                out.append(Rows(b["file"], b["start"], b["size"]))
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows):
        if not partition.file:
            return
        store, base = store_of(self.path)
        with store.open_input_file(f"{base}/{partition.file}") as f:
            data = f.read_at(partition.size, partition.start).decode()
        for row in csv.reader(io.StringIO(data, newline="")):
            number = int(row[0])
            if number >= self.first and (self.last is None or number <= self.last):
                # Column A is the row number; an empty cell at the end of a row is none.
                cells = [c or None for c in row[self.left - 1:self.right]]
                while cells and cells[-1] is None:
                    cells.pop()
                yield number, cells


class Register(DataSource):
    @classmethod
    def name(cls) -> str:
        return "costloom_register"

    def schema(self) -> str:
        return "row_index int, cells array<string>"

    def reader(self, schema) -> RegisterReader:
        return RegisterReader(self.options["path"], self.options["range"])


def read_range(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """``row_index`` and ``cells`` (ragged, of the range's columns) of the rows of a range."""
    spark.dataSource.register(Register)
    return spark.read.format("costloom_register").option("range", wanted).load(path)
