"""Python data sources for shapefile geometry (``shp``), dBASE tables (``dbf``) and text grids (``grid``).

    spark.dataSource.register(ShapeSource)
    spark.read.format("shp").load("/folder/layer.shp")

Files are cut into byte ranges (``shp``: by the records' headers; ``dbf`` and ``grid``: by fixed or line offsets), one partition for each, so that a large layer is read by many tasks.
Paths are local or on a mounted file system, as seen from the driver and every executor.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from terrane.functions.geometry import ring_area, smallest_container

ROWS = 4096


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    start: int
    stop: int


def _paths(options: dict, suffix: str) -> list[str]:
    path = options["path"].removeprefix("file://")
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.lower().endswith(suffix) and not n.startswith(".")) if os.path.isdir(path) else [path]


class DbfReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.options = options

    def partitions(self):
        out = []
        for p in _paths(self.options, ".dbf"):
            n, head, size, _ = dbf_header(p)
            out += [Piece(p, k, head + k * size, head + min(n, k + ROWS) * size) for k in range(0, n, ROWS)]
        return out

    def read(self, piece):
        _, _, size, fields = dbf_header(piece.path)
        encoding = self.options.get("encoding") or code_page(piece.path)
        with open(piece.path, "rb") as f:
            f.seek(piece.start)
            data = f.read(piece.stop - piece.start)
        for k in range(0, len(data) - size + 1, size):
            row = data[k : k + size]
            if row[:1] == b"*":  # deleted
                continue
            at, values = 1, {}
            for name, kind, width, decimals in fields:
                values[name] = dbf_value(row[at : at + width], kind, whole(kind, width, decimals), encoding)
                at += width
            yield tuple(values[n] for n in self.names)


def dbf_header(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Rows, header bytes, bytes of a row, and (name, type, width, decimals) of each field."""
    with open(path, "rb") as f:
        n, head, size = struct.unpack("<4xIHH", f.read(12))
        f.seek(32)
        fields = []
        while (block := f.read(32))[:1] != b"\r" and len(block) == 32:
            fields.append((block[:11].split(b"\0")[0].decode("ascii", "replace"), chr(block[11]), block[16], block[17]))
    return n, head, size, fields


def code_page(path: str) -> str:
    """What the .cpg file beside a table says its texts are encoded in; UTF-8 without one, or if Python doesn't know the name."""
    import codecs

    for end in (".cpg", ".CPG"):
        try:
            with open(os.path.splitext(path)[0] + end, encoding="ascii", errors="ignore") as f:
                return codecs.lookup(f.read().strip()).name
        except (FileNotFoundError, LookupError):
            continue
    return "utf-8"


def whole(kind: str, width: int, decimals: int) -> bool:
    """Whether a field holds whole numbers that a long can hold."""
    return kind == "N" and not decimals and width <= 18


def dbf_value(raw: bytes, kind: str, integer: bool, encoding: str):
    try:
        text = raw.decode(encoding)
    except UnicodeDecodeError:
        text = raw.decode("cp936", "replace")
    text = text.replace("\0", " ").strip()
    if kind in "NF":
        try:
            return int(text) if integer else float(text)
        except ValueError:
            return None
    if kind == "L":
        return {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(text.upper())
    return text or None


class DbfSource(DataSource):
    """Rows of a dBASE table: numbers without decimals as long, others as double, everything else as string; texts by the ``encoding`` option or the .cpg beside the table; blanks and what can't be read are null; deleted rows are left out."""

    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        fields = dbf_header(_paths(self.options, ".dbf")[0])[3]
        kind = lambda k, w, d: "long" if whole(k, w, d) else "double" if k in "NF" else "string"
        return ", ".join(f"`{n}` {kind(k, w, d)}" for n, k, w, d in fields)

    def reader(self, schema):
        return DbfReader(schema, self.options)


class ShapeReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        out = []
        for p in _paths(self.options, ".shp"):
            index = p[:-4] + ".shx"
            if os.path.exists(index):
                with open(index, "rb") as f:
                    data = f.read()[100:]
                ends = [(2 * o, 2 * o + 8 + 2 * n) for o, n in struct.iter_unpack(">ii", data)]
                out += [Piece(p, k, ends[k][0], ends[min(len(ends), k + ROWS) - 1][1]) for k in range(0, len(ends), ROWS)]
            else:
                out.append(Piece(p, 0, 100, os.path.getsize(p)))
        return out

    def read(self, piece):
        with open(piece.path, "rb") as f:
            f.seek(piece.start)
            data = f.read(piece.stop - piece.start)
        at, row = 0, piece.first
        while at + 8 <= len(data):
            _, words = struct.unpack_from(">ii", data, at)
            body = data[at + 8 : at + 8 + 2 * words]
            at += 8 + 2 * words
            kind = struct.unpack_from("<i", body)[0]
            parts = shape_parts(body, kind)
            xs = [x for p in parts for x, _ in p]
            ys = [y for p in parts for _, y in p]
            box = (min(xs), min(ys), max(xs), max(ys)) if xs else (None,) * 4
            yield (row, kind, *box, [[(x, y) for x, y in p] for p in parts])
            row += 1


def shape_parts(body: bytes, kind: int) -> list[list[tuple[float, float]]]:
    base = kind % 10
    if base == 0:
        return []
    if base == 1:
        return [[struct.unpack_from("<dd", body, 4)]]
    if base == 8:
        n = struct.unpack_from("<i", body, 36)[0]
        return [[struct.unpack_from("<dd", body, 40 + 16 * i)] for i in range(n)]
    parts, points = struct.unpack_from("<ii", body, 36)
    first = [*struct.unpack_from(f"<{parts}i", body, 44), points]
    at = 44 + 4 * parts
    return [[struct.unpack_from("<dd", body, at + 16 * i) for i in range(a, b)] for a, b in zip(first[:-1], first[1:], strict=True)]


@dataclass
class Written(WriterCommitMessage):
    stem: str


class ShapeWriter(DataSourceWriter):
    """A folder of layers, one for each task: .shp, .shx, .dbf and .cpg. Rows hold ``parts`` (polygons: rings); other columns but those of the reader's geometry become fields.

    A task writes under a name of its own (attempts never share one), commit renames what succeeded, so that a lost or repeated task leaves nothing behind but hidden files, which abort and commit remove.
    """

    def __init__(self, options, schema, overwrite):
        self.folder = options["path"].removeprefix("file://")
        self.columns = schema.names
        if "parts" not in self.columns:
            raise ValueError("no column parts")
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields if f.name not in ("parts", "row", "kind", "x0", "y0", "x1", "y1")]
        self.overwrite = overwrite

    def write(self, iterator):
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        stem = os.path.join(self.folder, f".part-{uuid.uuid4().hex}")
        layer_files(stem, iterator, self.fields)
        return Written(stem)

    def commit(self, messages):
        mine = {m.stem for m in messages if m}
        for name in os.listdir(self.folder):
            path = os.path.join(self.folder, name)
            stem, end = os.path.splitext(path)
            if stem in mine:
                os.replace(path, os.path.join(self.folder, name[1:]))
            elif end in LAYER and (name.startswith(".part-") or self.overwrite and name.startswith("part-")):
                os.remove(path)

    def abort(self, messages):
        for m in messages:
            for end in LAYER if m else ():
                if os.path.exists(m.stem + end):
                    os.remove(m.stem + end)


#: Files of a layer.
LAYER = (".shp", ".shx", ".dbf", ".cpg")


def layer_files(stem: str, rows, fields: list[tuple[str, str]]) -> None:
    """Writes rows as polygons, record by record: shells clockwise, holes (rings within another ring of the row) counterclockwise. A row without rings is a null shape. Texts are cut to 254 bytes at whole characters."""
    layout = [(n, *{"string": ("C", 254, 0), "boolean": ("L", 1, 0)}.get(t, ("N", 18, 0) if t in ("tinyint", "smallint", "int", "bigint") else ("N", 24, 15))) for n, t in fields]
    size = 1 + sum(w for _, _, w, _ in layout)
    box, n = [float("inf"), float("inf"), float("-inf"), float("-inf")], 0
    with open(stem + ".shp", "wb") as shp, open(stem + ".shx", "wb") as shx, open(stem + ".dbf", "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        head = b"".join(name.encode("ascii", "replace")[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([width, decimals]) + b"\0" * 14 for name, kind, width, decimals in layout) + b"\r"
        dbf.write(struct.pack("<B3xIHH20x", 3, 0, 32 + len(head), size) + head)
        for row in rows:
            body = polygon_body(row["parts"])
            n += 1
            shx.write(struct.pack(">ii", shp.tell() // 2, len(body) // 2))
            shp.write(struct.pack(">ii", n, len(body) // 2) + body)
            if len(body) > 4:
                x0, y0, x1, y1 = struct.unpack_from("<4d", body, 4)
                box = [min(box[0], x0), min(box[1], y0), max(box[2], x1), max(box[3], y1)]
            dbf.write(b" " + b"".join(dbf_bytes(row[name], kind, width) for name, kind, width, _ in layout))
        dbf.write(b"\x1a")
        dbf.seek(4)
        dbf.write(struct.pack("<I", n))
        for f in (shp, shx):
            end = f.tell() // 2
            f.seek(0)
            f.write(struct.pack(">i20xi", 9994, end) + struct.pack("<ii4d32x", 1000, 5, *(box if n and box[0] <= box[2] else (0, 0, 0, 0))))
    with open(stem + ".cpg", "w", encoding="ascii") as f:
        f.write("UTF-8")


def polygon_body(parts) -> bytes:
    rings = [np.array([(p[0], p[1]) for p in ring], dtype=float) for ring in parts or () if ring is not None and len(ring) > 2]
    if not rings:
        return struct.pack("<i", 0)
    rings = [r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]]) for r in rings]
    for i, r in enumerate(rings):
        depth = sum(smallest_container([r], [o])[0] == 0 for j, o in enumerate(rings) if j != i)
        turns_left = ring_area(r[:-1]) > 0
        if turns_left != (depth % 2 == 1):
            rings[i] = r[::-1]
    points = np.vstack(rings)
    first = np.cumsum([0, *[len(r) for r in rings[:-1]]])
    return struct.pack("<i4dii", 5, *points.min(0), *points.max(0), len(rings), len(points)) + first.astype("<i4").tobytes() + points.astype("<f8").tobytes()


def dbf_bytes(value, kind: str, width: int) -> bytes:
    if value is None or value != value:
        return b" " * width
    if kind == "C":
        return str(value).encode()[:width].decode("utf-8", "ignore").encode().ljust(width)
    if kind == "L":
        return b"T" if value else b"F"
    text = str(value) if isinstance(value, int) else next((t for t in (repr(float(value)), f"{float(value):.16g}") if len(t) <= width), "")
    if not text or len(text) > width:
        raise ValueError(f"{value} doesn't fit a field of {width}")
    return text.rjust(width).encode()


class ShapeSource(DataSource):
    """Shapes of a layer: row, kind, bounding box, and parts (arrays of points; of polygons, shells turn clockwise and holes counterclockwise)."""

    @classmethod
    def name(cls):
        return "shp"

    def schema(self):
        return "row long, kind int, x0 double, y0 double, x1 double, y1 double, parts array<array<struct<x:double,y:double>>>"

    def reader(self, schema):
        return ShapeReader(self.options)

    def writer(self, schema, overwrite):
        return ShapeWriter(self.options, schema, overwrite)


class GridReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        out = []
        for p in _paths(self.options, ".asc"):
            head, at = grid_header(p)
            rows = int(head["nrows"])
            step = int(self.options.get("rows", 256))
            offsets = [at]
            with open(p, "rb") as f:
                f.seek(at)
                for _ in range(rows):
                    f.readline()
                    offsets.append(f.tell())
            out += [Piece(p, k, offsets[k], offsets[min(rows, k + step)]) for k in range(0, rows, step)]
        return out

    def read(self, piece):
        head, _ = grid_header(piece.path)
        size, none = head["cellsize"], head.get("nodata_value")
        with open(piece.path, "rb") as f:
            f.seek(piece.start)
            lines = f.read(piece.stop - piece.start).splitlines()
        for i, line in enumerate(lines):
            row = piece.first + i
            y = head["yllcorner"] + (head["nrows"] - row - 0.5) * size
            for col, v in enumerate(map(float, line.split())):
                if v != none and v == v:
                    yield row, col, head["xllcorner"] + (col + 0.5) * size, y, v


def grid_header(path: str) -> tuple[dict[str, float], int]:
    """Settings at the head of a text grid, and where its rows start."""
    out: dict[str, float] = {}
    with open(path, "rb") as f:
        at = 0
        while (line := f.readline()) and line.lstrip()[:1].isalpha():
            k, v = line.split()
            out[k.decode().lower()] = float(v)
            at = f.tell()
    if not {"ncols", "nrows", "xllcorner", "yllcorner", "cellsize"} <= set(out):
        raise ValueError(f"not a text grid: {path}")
    return out, at


class GridSource(DataSource):
    """Cells of an ESRI text grid that hold a value: row and column from the upper left, centre, value. One partition for each block of rows."""

    @classmethod
    def name(cls):
        return "grid"

    def schema(self):
        return "row int, col int, x double, y double, value double"

    def reader(self, schema):
        return GridReader(self.options)


def register(spark) -> None:
    for source in (DbfSource, ShapeSource, GridSource):
        spark.dataSource.register(source)
