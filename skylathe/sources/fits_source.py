"""FITS as Spark data sources: fits_table, fits_image and fits_headers.

Reads go by byte ranges. A partition is a few megabytes of a file, whatever the file's size, and gives
the rows (of a table) or tiles (of an image) that begin in its range; the reader finds the unit by
stepping over headers, so neither the driver nor a task ever holds a file. Columns are chosen by the schema
given to the reader, comparisons are pushed into it.

Writes go file by file into a temporary folder beside the result, a folder an attempt. The driver's
commit moves what the successful attempts report and removes the rest, so killed or repeated tasks leave
nothing. Files that are there already are never replaced. Units carry DATASUM and CHECKSUM cards.

Paths are opened with pyarrow's file systems (local, HDFS, S3 and others by their scheme).
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .fits import BLOCK, CODES, columns, headers, ones_complement, ordered_cards, written_header

#: Bytes of a partition and those that opening a file counts as; rows of a batch.
SPLIT, OPEN, ROWS = 32 << 20, 1 << 20, 1 << 15
#: Unwanted bytes of a row that are read through rather than skipped.
GAP = 1 << 12
#: Bytes of a written table file.
FILE = 64 << 20
_ARROW = {"L": pa.bool_(), "B": pa.int16(), "I": pa.int16(), "J": pa.int32(), "K": pa.int64(), "A": pa.string(), "E": pa.float32(), "D": pa.float64()}
_PIXELS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


class Ranged:
    """An open file whose slices are read when they are asked for."""

    def __init__(self, store: stores.FileSystem, path: str):
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        end = min(part.stop, self.size)
        return self.file.read_at(max(0, end - part.start), part.start)

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def unit(self, number: int) -> tuple[dict, int, int] | None:
        """Header, start and size of the data of a unit."""
        return next(((h, at, size) for n, h, at, size in headers(self) if n == number), None)


@dataclass
class Spans(D.InputPartition):
    """Byte ranges (path, start, end) of files."""

    spans: list[tuple[str, int, int]]


def files(path: str, pattern: str = "*.fit*") -> list[tuple[str, int]]:
    """Path and size of a file, or of those below a folder whose names fit, in order."""
    store, root = stores.FileSystem.from_uri(path)
    told = store.get_file_info(root)
    if told.type == stores.FileType.File:
        return [(told.path, told.size)]
    below = store.get_file_info(stores.FileSelector(root, recursive=True)) if told.type == stores.FileType.Directory else []
    seen = lambda x: not any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/"))
    return sorted((x.path, x.size) for x in below if x.type == stores.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and seen(x))


def spans(found: list[tuple[str, int]], split: int) -> list[Spans]:
    """Ranges of at most `split` bytes; those of small files share a partition."""
    out, room = [], 0
    for path, size in found:
        for start in range(0, max(size, 1), split):
            own = (path, start, min(start + split, size))
            cost = own[2] - start + OPEN
            if not out or cost > room:
                out.append(Spans([]))
                room = split
            out[-1].spans.append(own)
            room -= cost
    return out


def _forms(header: dict) -> list[dict]:
    """name, count, code, at (offset in a row), null and scale of each column of a table."""
    out, at = [], 0
    for i, (name, count, code) in enumerate(columns(header), 1):
        scale = (header.get(f"TSCAL{i}", 1), header.get(f"TZERO{i}", 0))
        out.append({"name": name, "count": count, "code": code, "at": at, "null": header.get(f"TNULL{i}"), "scale": scale if scale != (1, 0) and code not in "LA" else None})
        at += count if code == "A" else count * np.dtype(CODES[code][0]).itemsize
    return out


def _spark_type(form: dict) -> T.DataType:
    kind = T.DoubleType() if form["scale"] else CODES[form["code"]][1]
    return kind if form["count"] == 1 or form["code"] == "A" else T.ArrayType(kind)


def _cells(rows: np.ndarray, form: dict) -> pa.Array:
    cells, code = rows[form["name"]], form["code"]
    if code == "A":
        return pa.array([x.decode("ascii", "replace").rstrip("\0 ") for x in cells], pa.string())
    kind = _ARROW[code]
    null = cells == form["null"] if form["null"] is not None else None
    if code == "L":
        cells = cells == ord("T")
    elif form["scale"]:
        cells, kind = cells.astype("f8") * form["scale"][0] + form["scale"][1], pa.float64()
    else:
        cells = cells.astype(kind.to_pandas_dtype())
    flat = pa.array(cells.ravel(), kind, mask=None if null is None else null.ravel())
    return flat if form["count"] == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * form["count"], pa.int32()), flat)


_COMPARE = {
    D.EqualTo: lambda x, v: x == v,
    D.GreaterThan: lambda x, v: (x > v) | np.isnan(x),  # in Spark NaN is above all numbers
    D.GreaterThanOrEqual: lambda x, v: (x >= v) | np.isnan(x),
    D.LessThan: lambda x, v: x < v,
    D.LessThanOrEqual: lambda x, v: x <= v,
}


class _Reader(D.DataSourceReader):
    def __init__(self, source: _Source, schema: T.StructType):
        self.path, self.pattern, self.split = source.path, source.options.get("pathGlobFilter", "*.fit*"), int(source.options.get("split", SPLIT))
        self.hdu, self.tile, self.schema = source.hdu, int(source.options.get("tile", 256)), schema
        self.absent_is_null = source.options.get("absent", "error") == "null"
        self.only_path, self.filters = None, []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for x in filters:
            name = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            if type(x) is D.EqualTo and name == "path":
                self.only_path = x.value
            elif type(x) in _COMPARE and isinstance(kinds.get(name), T.NumericType) and x.value == x.value and self.takes(name):
                self.filters.append(x)
            else:
                yield x

    def takes(self, name: str) -> bool:
        """Whether a comparison of this column can be made before rows become Arrow."""
        return False

    def partitions(self) -> list[Spans]:
        found = [x for x in files(self.path, self.pattern) if self.only_path in (None, x[0])]
        return spans(found, self.split) or [Spans([])]

    def read(self, partition: Spans) -> Iterator[pa.RecordBatch]:
        store, _ = stores.FileSystem.from_uri(self.path)
        for path, start, end in partition.spans:
            with Ranged(store, path) as file:
                yield from self.of_span(file, path, start, end)


class _TableReader(_Reader):
    def takes(self, name: str) -> bool:
        return name != "path"

    def of_span(self, file: Ranged, path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        unit = file.unit(self.hdu)
        if (unit is None or "TFIELDS" not in unit[0]) and self.absent_is_null:
            return
        if unit is None:
            raise ValueError(f"no unit {self.hdu} in {path}")
        header, at, _ = unit
        width, n, schema = header["NAXIS1"], header["NAXIS2"], to_arrow_schema(self.schema)
        first, last = (min(n, max(0, -(-(x - at) // width))) for x in (start, end))
        forms = {f["name"]: f for f in _forms(header)}
        asked = {f.name for f in self.schema.fields} | {x.attribute[0] for x in self.filters}
        missing = asked - set(forms) - {"path"}
        if missing & {x.attribute[0] for x in self.filters}:  # a comparison with null holds for no row
            return
        if missing and not self.absent_is_null:
            raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
        own = [forms[c] for c in forms if c in asked]
        ends = [f["at"] + (f["count"] if f["code"] == "A" else f["count"] * np.dtype(CODES[f["code"]][0]).itemsize) for f in own]
        low, high = (min(f["at"] for f in own), max(ends)) if own else (0, 0)
        whole = width - (high - low) <= GAP
        base, size = (0, width) if whole else (low, high - low)
        shapes = [(f"S{f['count']}" if f["code"] == "A" else CODES[f["code"]][0], () if f["count"] == 1 or f["code"] == "A" else (f["count"],)) for f in own]
        kind = np.dtype({"names": [f["name"] for f in own], "formats": shapes, "offsets": [f["at"] - base for f in own], "itemsize": max(size, 1)})
        step = max(1, min(ROWS, (8 << 20) // max(width, 1)))
        for a in range(first, last, step):
            b = min(a + step, last)
            if not own:
                rows = np.empty(b - a, kind)
            elif whole:
                rows = np.frombuffer(file[at + a * width : at + b * width], kind)
            else:
                rows = np.frombuffer(b"".join(file[at + i * width + low : at + i * width + high] for i in range(a, b)), kind)
            for x in self.filters:
                f = forms[x.attribute[0]]
                cells = rows[f["name"]]
                keep = _COMPARE[type(x)](cells.astype("f8") * f["scale"][0] + f["scale"][1] if f["scale"] else cells.astype(cells.dtype.newbyteorder("=")), x.value)
                rows = rows[keep & (cells != f["null"]) if f["null"] is not None else keep]
            told = [pa.array([path] * len(rows), pa.string()) if c.name == "path" else pa.nulls(len(rows), c.type) if c.name in missing else _cells(rows, forms[c.name]).cast(c.type) for c in schema]
            yield pa.RecordBatch.from_arrays(told, schema=schema)


class _ImageReader(_Reader):
    def of_span(self, file: Ranged, path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        unit, schema, tile = file.unit(self.hdu), to_arrow_schema(self.schema), self.tile
        if unit is None or unit[0].get("NAXIS") != 2:
            return
        header, at, _ = unit
        kind = np.dtype(_PIXELS[header["BITPIX"]])
        width, height = header["NAXIS1"], header["NAXIS2"]
        band = tile * width * kind.itemsize
        first, last = (min(-(-height // tile), max(0, -(-(x - at) // band))) for x in (start, end))
        scale, zero, blank = header.get("BSCALE") or 1, header.get("BZERO") or 0, header.get("BLANK")
        wanted = "pixels" in schema.names
        for y in range(first, last):
            rows = min(tile, height - y * tile)
            image = np.frombuffer(file[at + y * band : at + y * band + rows * width * kind.itemsize], kind).reshape(rows, width) if wanted else None
            for x in range(-(-width // tile)):
                cut = slice(x * tile, (x + 1) * tile)
                told = {"path": path, "tile_y": y, "tile_x": x, "height": rows, "width": min(tile, width - x * tile)}
                if wanted:
                    raw = image[:, cut].ravel()
                    told["pixels"] = pa.array(raw.astype("f8") * scale + zero, mask=(raw == blank) if blank is not None else None)
                yield pa.RecordBatch.from_arrays([pa.array([told[c.name]], c.type) if c.name != "pixels" else pa.ListArray.from_arrays(pa.array([0, len(told["pixels"])], pa.int32()), told["pixels"]) for c in schema], schema=schema)


class _HeaderReader(_Reader):
    def of_span(self, file: Ranged, path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if start:
            return
        schema = to_arrow_schema(self.schema)
        rows, begin = [], 0
        for n, h, at, size in headers(file):
            cards = [dict(zip(("key", "value", "comment"), c, strict=True)) for c in ordered_cards(file[begin:at])] if "cards" in schema.names else None
            rows.append({"path": path, "hdu": n, "header": [(k, None if v is None else str(v)) for k, v in h.items()], "cards": cards, "data_offset": at, "data_size": size})
            begin = at + -(-size // BLOCK) * BLOCK
        yield pa.RecordBatch.from_arrays([pa.array([r[c.name] for r in rows], c.type) for c in schema], schema=schema)


def checksum_code(total: int) -> str:
    """The 16 characters of a CHECKSUM card which bring a unit of this sum to all ones (FITS standard 4.0, appendix J)."""
    letters = [[0] * 4 for _ in range(4)]
    for i, byte in enumerate((0xFFFFFFFF - total).to_bytes(4, "big")):
        each = [byte // 4 + 48] * 4
        each[0] += byte % 4
        while any(58 <= c <= 64 or 91 <= c <= 96 for c in each):  # only digits and letters may stand there
            for j in (0, 2):
                if any(58 <= c <= 64 or 91 <= c <= 96 for c in each[j : j + 2]):
                    each[j], each[j + 1] = each[j] + 1, each[j + 1] - 1
        for j in range(4):
            letters[j][i] = each[j]
    text = "".join(chr(c) for row in letters for c in row)
    return text[-1] + text[:-1]


def summed_unit(cards: dict, data: bytes) -> bytes:
    """A unit of a file, its header with DATASUM and CHECKSUM."""
    data = data.ljust(-(-len(data) // BLOCK) * BLOCK, b"\0")
    total = ones_complement(data)
    cards = {k: v for k, v in cards.items() if k not in ("DATASUM", "CHECKSUM")} | {"DATASUM": str(total)}
    head = written_header(cards | {"CHECKSUM": "0" * 16})
    return written_header(cards | {"CHECKSUM": checksum_code(ones_complement(head, total))}) + data


@dataclass
class Written(D.WriterCommitMessage):
    """Files of a task by their place in its attempt's folder and their name in the result."""

    made: list[tuple[str, str]]


class _Writer(D.DataSourceArrowWriter):
    """A writer of files: a subclass makes names and bytes from batches."""

    whole_folder = False

    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        if overwrite:
            raise ValueError(f"{path}: files are never replaced; write to another folder")
        self.uri, self.schema, self.token = path, schema, uuid.uuid4().hex
        self.refuse([])

    def place(self) -> tuple[stores.FileSystem, str, str]:
        store, root = stores.FileSystem.from_uri(self.uri)
        return store, root, f"{root}/_temporary-{self.token}"

    def refuse(self, names: list[str]) -> None:
        store, root, _ = self.place()
        taken = [p for p, _ in files(self.uri)] if self.whole_folder else [x.path for x in store.get_file_info([f"{root}/{n}" for n in names]) if x.type != stores.FileType.NotFound]
        if taken:
            raise FileExistsError(f"{taken[0]} is there already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, below = self.place()
        task = TaskContext.get()
        own, made = f"{below}/{task.partitionId()}-{task.taskAttemptId()}", []
        for name, data in self.files(iterator, task.partitionId()):
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"{name!r} can't be a file's name")
            store.create_dir(own, recursive=True)
            with store.open_output_stream(f"{own}/{name}") as out:
                out.write(data)
            made.append((f"{own}/{name}", name))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, root, below = self.place()
        made = [x for m in messages if m for x in m.made]
        names = [n for _, n in made]
        try:
            if len(set(names)) < len(names):
                raise FileExistsError(f"two rows make {next(n for n in names if names.count(n) > 1)}")
            self.refuse(names)
            store.create_dir(root, recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda x: store.move(x[0], f"{root}/{x[1]}"), made))
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, below = self.place()
        if store.get_file_info(below).type != stores.FileType.NotFound:
            store.delete_dir(below)


class _TableWriter(_Writer):
    whole_folder = True

    def files(self, batches: Iterator[pa.RecordBatch], number: int) -> Iterator[tuple[str, bytes]]:
        waiting, size, part = [], 0, 0
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                waiting.append(batch.slice(a, ROWS))
                size += waiting[-1].get_total_buffer_size() if a == 0 else 0
                if size >= FILE:
                    yield f"part-{number:05d}-{part}-{self.token[:8]}.fits", table_file(pa.Table.from_batches(waiting))
                    waiting, size, part = [], 0, part + 1
        if waiting:
            yield f"part-{number:05d}-{part}-{self.token[:8]}.fits", table_file(pa.Table.from_batches(waiting))


def table_file(rows: pa.Table) -> bytes:
    """A file of an empty first unit and a binary table. Integers may be null (TNULL), floats are NaN
    then; texts are ASCII, null ones empty; arrays of a column are equally long, null ones of floats all NaN."""
    codes = {pa.bool_(): "L", pa.int8(): "I", pa.int16(): "I", pa.int32(): "J", pa.int64(): "K", pa.float32(): "E", pa.float64(): "D", pa.string(): "A"}
    parts, cards = [], {}
    for i, (name, column) in enumerate(zip(rows.column_names, rows.columns, strict=True), 1):
        count, kind, cells = 1, column.type, column.combine_chunks()
        cells = pa.concat_arrays(cells.chunks) if isinstance(cells, pa.ChunkedArray) else cells
        if pa.types.is_list(kind):
            sizes = {len(x) for x in cells if x.is_valid}
            kind = kind.value_type
            if len(sizes) > 1 or cells.null_count and not pa.types.is_floating(kind):
                raise ValueError(f"arrays of {name} aren't all there and equally long")
            count = sizes.pop() if sizes else 1
            cells = cells.fill_null([float("nan")] * count).flatten() if cells.null_count else cells.flatten()
        if kind not in codes:
            raise ValueError(f"{name}: {kind} has no column form")
        code = codes[kind]
        if code == "A":
            texts = [(x or "").encode("ascii") for x in cells.to_pylist()]
            count = max(map(len, texts), default=1) or 1
            values = np.array(texts, f"S{count}")
        elif code == "L":
            values = np.where(cells.fill_null(False).to_numpy(zero_copy_only=False), ord("T"), ord("F")).astype("u1")
        elif code in "ED":
            values = cells.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        else:
            if cells.null_count:
                cards[f"TNULL{i}"] = int(np.iinfo(CODES[code][0]).min)
            values = cells.fill_null(cards.get(f"TNULL{i}", 0)).to_numpy(zero_copy_only=False)
        cards |= {f"TTYPE{i}": name, f"TFORM{i}": f"{count}{code}"}
        parts.append((f"c{i}", values.dtype if code == "A" else CODES[code][0], () if code == "A" or count == 1 else (count,), values))
    data = np.zeros(len(rows), np.dtype([p[:3] if p[2] else p[:2] for p in parts]))
    for name, _, shape, values in parts:
        data[name] = values.reshape(-1, *shape) if shape else values
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": data.dtype.itemsize, "NAXIS2": len(rows), "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(parts)}
    return summed_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0}, b"") + summed_unit(head | cards, data.tobytes())


class _ImageWriter(_Writer):
    def files(self, batches: Iterator[pa.RecordBatch], number: int) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            cards = batch["cards"].to_pylist() if "cards" in batch.schema.names else [None] * len(batch)
            for name, width, pixels, own in zip(batch["name"].to_pylist(), batch["width"].to_pylist(), batch["pixels"], cards, strict=True):
                image = np.array(pixels.as_py(), ">f4").reshape(-1, width)  # null is NaN
                head = {"SIMPLE": True, "BITPIX": -32, "NAXIS": 2, "NAXIS1": width, "NAXIS2": len(image)}
                yield name, summed_unit(head | {k: v for k, v in own or [] if k not in head}, image.tobytes())


class _Source(D.DataSource):
    unit = 0

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.path, self.hdu = options["path"], int(options.get("hdu", self.unit))


class FitsTable(_Source):
    """Binary tables. Options: hdu (1), split (bytes of a partition), pathGlobFilter, absent (what a column that a file
    lacks is: error, the default, or null; then files without the table give nothing). The schema is the first
    file's, with path; a schema of fewer columns reads only those. Writes part files."""

    unit = 1

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> T.StructType:
        store, _ = stores.FileSystem.from_uri(self.path)
        for path, _ in files(self.path, self.options.get("pathGlobFilter", "*.fit*")):
            with Ranged(store, path) as file:
                if unit := file.unit(self.hdu):
                    return T.StructType([T.StructField("path", T.StringType()), *(T.StructField(f["name"], _spark_type(f)) for f in _forms(unit[0]))])
        raise ValueError(f"no unit {self.hdu} in {self.path}")

    def reader(self, schema: T.StructType) -> _Reader:
        return _TableReader(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _TableWriter(self.path, schema, overwrite)


class FitsImage(_Source):
    """Two-dimensional images as tiles. Options: hdu (0), tile (256), split, pathGlobFilter. Writes a file a row from
    name, width and pixels, with cards (map<string,string>) if there are any."""

    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def schema(self) -> str:
        return "path string, tile_y int, tile_x int, height int, width int, pixels array<double>"

    def reader(self, schema: T.StructType) -> _Reader:
        return _ImageReader(self, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _ImageWriter(self.path, schema, overwrite)


class FitsHeaders(_Source):
    """A row for each unit of each file, with its values by key and its cards in order; data aren't read."""

    @classmethod
    def name(cls) -> str:
        return "fits_headers"

    def schema(self) -> str:
        return "path string, hdu int, header map<string,string>, cards array<struct<key:string,value:string,comment:string>>, data_offset long, data_size long"

    def reader(self, schema: T.StructType) -> _Reader:
        return _HeaderReader(self, schema)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session and lets comparisons be pushed into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FitsTable, FitsImage, FitsHeaders):
        spark.dataSource.register(source)
