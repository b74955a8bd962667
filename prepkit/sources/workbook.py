"""Multi-sheet spreadsheet workbooks (``.xlsx``) as a Spark source.

A PySpark Python data source (``spark.read.format("workbook")``): the driver
only lists files and sheet names (workbook metadata); every ``(file, sheet)``
pair is one input partition read on an executor with a streaming XML parse,
so workbooks are read in parallel and no sheet passes through the driver.

Scope is the batch-ingest need of the reference, not a spreadsheet library:
the first row is the header; numeric, shared/inline string, boolean and
date-styled cells are decoded; formulas contribute their cached value.

Options:

``paths``   JSON list or comma-separated list of files / glob patterns
``sheet``   sheet name or 0-based index to read only that sheet (S7);
            default every sheet (S1)
``sheet_column`` / ``file_column``  names of the tag columns (default
            ``sheet`` / ``file``); the sheet name is the station tag (P1)

Without a user schema every header becomes a STRING column (outer set over
all sheets, U1) plus the two tag columns; with ``.schema(...)`` cells are
converted to the declared types (NA tokens → NULL, bad numbers → NULL).
"""

from __future__ import annotations

import datetime as _dt
import glob as _glob
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import NA_TOKENS

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
       "pr": "http://schemas.openxmlformats.org/package/2006/relationships"}
_M = "{%s}" % _NS["m"]
# Built-in number-format ids that denote dates/times (ECMA-376).
_DATE_FMT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_DATE_TOKENS = re.compile(r"[dmyhs]", re.I)


def _is_uri(p: str) -> bool:
    return re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", p) is not None or p.startswith("file:")


def _local(p: str) -> str | None:
    """Local path of a plain path or ``file:`` URI; None for other schemes."""
    if not _is_uri(p):
        return p
    if p.startswith("file:"):
        from urllib.parse import unquote, urlparse
        return unquote(urlparse(p).path)
    return None


def _remote_fs(uri: str):
    from urllib.parse import quote

    from pyarrow import fs as pafs
    return pafs.FileSystem.from_uri(quote(uri, safe=":/?=&%@[]*"))


def _open(path: str):
    """A seekable binary stream: local paths and ``file:`` URIs directly,
    other URIs (``s3://``, ``hdfs://``) through ``pyarrow.fs`` so executors
    read shared storage themselves."""
    loc = _local(path)
    if loc is not None:
        return open(loc, "rb")
    fsys, inner = _remote_fs(path)
    return fsys.open_input_file(inner)


def _expand(paths) -> list[str]:
    if isinstance(paths, str):
        paths = json.loads(paths) if paths.strip().startswith("[") else [p for p in paths.split(",") if p]
    out: list[str] = []
    for p in paths:
        loc = _local(p)
        if loc is None:
            out.extend(_expand_uri(p))
        else:
            out.extend(sorted(_glob.glob(loc)))
    return out


def _expand_uri(uri: str) -> list[str]:
    """Wildcards in the last path component only."""
    import fnmatch

    from pyarrow import fs as pafs
    fsys, inner = _remote_fs(uri)
    scheme, rest = uri.split("://", 1)
    # object stores list "bucket/key" paths; HDFS-style stores list "/path"
    prefix = f"{scheme}://" + (rest.split("/", 1)[0] if inner.startswith("/") else "")
    base, _, name = inner.rpartition("/")
    if not any(ch in name for ch in "*?["):
        info = fsys.get_file_info(inner)
        return [uri] if info.type == pafs.FileType.File else []
    infos = fsys.get_file_info(pafs.FileSelector(base or "/", recursive=False))
    return sorted(prefix + i.path for i in infos
                  if i.type == pafs.FileType.File and fnmatch.fnmatch(i.base_name, name))


def list_sheets(path: str) -> list[tuple[str, str]]:
    """``[(sheet name, member path in the zip)]`` in workbook order."""
    with _open(path) as fh, zipfile.ZipFile(fh) as z:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels.findall("pr:Relationship", _NS)}
    out = []
    for s in wb.findall("m:sheets/m:sheet", _NS):
        rid = s.get("{%s}id" % _NS["r"])
        t = targets[rid].lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else "xl/" + t))
    return out


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    try:
        data = z.open("xl/sharedStrings.xml")
    except KeyError:
        return []
    out = []
    for _ev, el in ET.iterparse(data):
        if el.tag == _M + "si":
            out.append("".join(t.text or "" for t in el.iter(_M + "t")))
            el.clear()
    return out


def _date_styles(z: zipfile.ZipFile) -> tuple[set[int], bool]:
    """Indices of cell styles that format dates; and the 1904 flag."""
    date1904 = False
    try:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        pr = wb.find("m:workbookPr", _NS)
        date1904 = pr is not None and pr.get("date1904") in ("1", "true")
    except KeyError:
        pass
    try:
        st = ET.fromstring(z.read("xl/styles.xml"))
    except KeyError:
        return set(), date1904
    custom = {}
    for nf in st.findall("m:numFmts/m:numFmt", _NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", nf.get("formatCode", ""))
        custom[int(nf.get("numFmtId"))] = bool(_DATE_TOKENS.search(code))
    idx = set()
    for i, xf in enumerate(st.findall("m:cellXfs/m:xf", _NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in _DATE_FMT_IDS or custom.get(fid, False):
            idx.add(i)
    return idx, date1904


def _serial_to_datetime(v: float, date1904: bool) -> _dt.datetime:
    base = _dt.datetime(1904, 1, 1) if date1904 else _dt.datetime(1899, 12, 30)
    return base + _dt.timedelta(microseconds=round(v * 86400 * 1_000_000))


def iter_sheet(path: str, member: str) -> Iterator[list]:
    """Yield each row as a list of decoded cell values (str, float, bool,
    datetime or None), header row included."""
    with _open(path) as fh, zipfile.ZipFile(fh) as z:
        sst = _shared_strings(z)
        dates, d1904 = _date_styles(z)
        with z.open(member) as fh:
            for _ev, el in ET.iterparse(fh):
                if el.tag != _M + "row":
                    continue
                row: list = []
                nxt = 0
                for c in el.findall(_M + "c"):
                    ref = c.get("r")
                    i = _col_index(ref) if ref else nxt
                    nxt = i + 1
                    t = c.get("t", "n")
                    v = c.find(_M + "v")
                    if t == "inlineStr":
                        val = "".join(x.text or "" for x in c.iter(_M + "t"))
                    elif v is None or v.text is None:
                        val = None
                    elif t == "s":
                        val = sst[int(v.text)]
                    elif t == "b":
                        val = v.text == "1"
                    elif t in ("str", "e"):
                        val = v.text
                    else:
                        num = float(v.text)
                        val = _serial_to_datetime(num, d1904) if int(c.get("s", "0")) in dates else num
                    if i >= len(row):
                        row.extend([None] * (i + 1 - len(row)))
                    row[i] = val
                el.clear()
                yield row


def _convert(v, dt: T.DataType):
    if v is None:
        return None
    if isinstance(v, str) and v.strip() in NA_TOKENS:
        return None
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        if isinstance(v, bool):
            return float(v)
        if isinstance(v, (int, float)):
            return None if v != v else float(v)
        try:
            f = float(str(v).strip())
            return None if f != f else f
        except ValueError:
            return None
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType)):
        try:
            f = float(v)
            return int(f) if f == int(f) else None
        except (TypeError, ValueError):
            return None
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        if isinstance(v, _dt.datetime):
            return v
        try:
            return _dt.datetime.fromisoformat(str(v).strip())
        except ValueError:
            return None
    if isinstance(dt, T.BooleanType):
        return v if isinstance(v, bool) else str(v).strip().lower() in ("true", "1")
    if isinstance(dt, T.StringType):
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(v)
        if isinstance(v, _dt.datetime):
            return v.isoformat(sep=" ")
        return str(v)
    return v


class _Part(InputPartition):
    def __init__(self, path: str, sheet: str, member: str):
        super().__init__(None)
        self.path, self.sheet, self.member = path, sheet, member


def _selected(path: str, sheet_opt):
    sheets = list_sheets(path)
    if sheet_opt is None:
        return sheets
    if str(sheet_opt).isdigit():
        i = int(sheet_opt)
        return sheets[i:i + 1]
    return [s for s in sheets if s[0] == sheet_opt]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options = options
        self.schema = schema

    def partitions(self):
        parts = []
        for p in _expand(self.options.get("paths") or self.options.get("path") or "[]"):
            for name, member in _selected(p, self.options.get("sheet")):
                parts.append(_Part(p, name, member))
        return parts

    def read(self, partition: _Part):
        sheet_col = self.options.get("sheet_column", "sheet")
        file_col = self.options.get("file_column", "file")
        fields = self.schema.fields
        rows = iter_sheet(partition.path, partition.member)
        header = next(rows, None)
        if header is None:
            return
        pos = {str(h): i for i, h in enumerate(header) if h is not None}
        for r in rows:
            if all(v is None for v in r):
                continue
            out = []
            for f in fields:
                if f.name == sheet_col:
                    out.append(partition.sheet)
                elif f.name == file_col:
                    out.append(partition.path)
                else:
                    i = pos.get(f.name)
                    out.append(_convert(r[i] if i is not None and i < len(r) else None, f.dataType))
            yield tuple(out)


class WorkbookDataSource(DataSource):
    """``spark.read.format("workbook")``; see the module docstring."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self):
        names: list[str] = []
        for p in _expand(self.options.get("paths") or self.options.get("path") or "[]"):
            for _name, member in _selected(p, self.options.get("sheet")):
                header = next(iter_sheet(p, member), []) or []
                for h in header:
                    h = _convert(h, T.StringType())
                    if h is not None and h not in names:
                        names.append(h)
        names += [self.options.get("sheet_column", "sheet"), self.options.get("file_column", "file")]
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType):
        return WorkbookReader(self.options, schema)


def register(spark) -> None:
    from ..session import ship_package
    ship_package(spark)                     # readers run on executors
    spark.dataSource.register(WorkbookDataSource)


def read_workbooks(spark, paths, schema: T.StructType | str | None = None, sheet=None,
                   sheet_column: str = "sheet", file_column: str = "file"):
    """S1 (all sheets) / S7 (``sheet=0``): read workbooks as one DataFrame.
    A declared ``schema`` must include the two tag columns."""
    register(spark)
    r = (spark.read.format("workbook")
         .option("paths", json.dumps(list(paths) if not isinstance(paths, str) else [paths]))
         .option("sheet_column", sheet_column).option("file_column", file_column))
    if sheet is not None:
        r = r.option("sheet", str(sheet))
    if schema is not None:
        r = r.schema(schema)
    return r.load()
