"""Result files as a data source, one split for each file.

    results.read(spark, folder, "fingerprints", types=["A", "B"])

or, after ``results.register(spark)``, with a JSON list of types,

    spark.read.format("stipple_results").option("kind", "fingerprints").option("types", '["A", "B"]').load(folder)

The path is a file, a folder (read whole, but for names that begin with ``_`` or
``.``) or a pattern. Kinds and their columns, after ``file`` and ``error``:

* ``fingerprints``: type and the fields of a record, from an object of records by type
* ``pairs``: type_a, type_b and the fields, from an object keyed ``a__x__b``
* ``trials``: trial, type and the fields, from a list of such objects
* ``curves``: unit, place, scale, vmr, null_mean, null_sd, from one flat object
* ``report``: meta, key and record as JSON texts, from an object with ``results``
* ``files``: kind, records and bytes, one row for each file, whatever it holds

A file that is broken or holds something else gives one row, of its name and an
error alone, so a count of errors is a count of bad files and none goes unseen. A
number that is missing, not finite or no number is null; records by type lack nothing
that ``reports`` fills in. An empty object or folder gives no rows. ``types`` names
the types whose records are wanted (of pairs: those with one of them); the reader
makes no rows of others, but bad files are still told. Types are an option, not
pushed filters, since Spark 4.1 keeps one reader in Python for all uses of a
DataFrame, and what one use pushed would also be missing from the next.

Python reads the files, so the stores are those of pyarrow: local, hdfs, s3, gs and
abfs. For others there are the readers of ``reports``, which are Spark's own.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "stipple_results"

_RECORD = "n_cells long, vmr_curve array<double>, skewness_curve array<double>, scales_um array<double>, mock_vmr_mean array<double>, mock_vmr_std array<double>, chi_squared double, f_statistic double, p_value double, peak_scale_um double, condition_number double, n_mocks_used long"
_PAIR = "scales_um array<double>, correlation_curve array<double>, null_corr_mean array<double>, null_corr_std array<double>, peak_scale_um double, peak_correlation double, significant_scales array<boolean>"
COLUMNS = {
    "fingerprints": f"type string, {_RECORD}",
    "pairs": f"type_a string, type_b string, {_PAIR}",
    "trials": f"trial long, type string, {_RECORD}",
    "curves": "unit string, place int, scale double, vmr double, null_mean double, null_sd double",
    "report": "meta string, key string, record string",
    "files": "kind string, records long, bytes long",
}
_KEYS = ("file", "error", "trial", "type", "type_a", "type_b")


class Unfit(Exception):
    """The file is no document of the kind."""


class File(InputPartition):
    def __init__(self, path: str, size: int) -> None:
        super().__init__(path)
        self.path, self.size = path, size


def _number(v: object) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else None


def _whole(v: object) -> int | None:
    n = _number(v)
    return int(n) if n is not None and n == int(n) else None


def _fitted(v: object, kind: T.DataType) -> object:
    """``v`` as a value of the column, or null."""
    if isinstance(kind, T.ArrayType):
        return [_fitted(x, kind.elementType) for x in v] if isinstance(v, list) else None
    if isinstance(kind, T.BooleanType):
        return v if isinstance(v, bool) else None
    return _whole(v) if isinstance(kind, T.LongType) else _number(v)


def _records(doc: object) -> dict[str, dict]:
    if not isinstance(doc, dict) or not all(isinstance(r, dict) for r in doc.values()):
        raise Unfit("no object of records")
    return doc


def kind_of(doc: object) -> str:
    """What a document looks like; ``other`` for none of the kinds. An empty object is ``fingerprints``, an empty list ``trials``."""
    if isinstance(doc, list):
        return "trials" if all(isinstance(m, dict) and all(isinstance(r, dict) for r in m.values()) for m in doc) else "other"
    if not isinstance(doc, dict):
        return "other"
    if isinstance(doc.get("vmr"), list) and any(isinstance(doc.get(s), list) for s in ("scales_nm", "scales_um")):
        return "curves"
    if isinstance(doc.get("results"), (dict, list)):
        return "report"
    if not all(isinstance(r, dict) for r in doc.values()):
        return "other"
    return "pairs" if doc and all("__x__" in k for k in doc) else "fingerprints"


def _curve(doc: object) -> Iterator[tuple[str, int, float | None, float | None, float | None, float | None]]:
    if kind_of(doc) != "curves":
        raise Unfit("no curve with its scales")
    unit = "nm" if isinstance(doc.get("scales_nm"), list) else "um"
    others = [doc[c] if isinstance(doc.get(c), list) else [] for c in ("vmr", "null_mean", "null_std")]
    for i, scale in enumerate(doc[f"scales_{unit}"]):
        yield unit, i, _number(scale), *[_number(c[i]) if i < len(c) else None for c in others]


class ResultReader(DataSourceReader):
    def __init__(self, path: str, kind: str, columns: T.StructType, types: Iterable[str] | None = None) -> None:
        self.path, self.kind = path, kind
        self.fields = [f for f in columns.fields if f.name not in _KEYS]
        self.types = None if types is None else frozenset(types)

    def partitions(self) -> list[File]:
        return listed(self.path)

    def _take(self, *types: str) -> bool:
        return self.types is None or not self.types.isdisjoint(types)

    def read(self, partition: File | None) -> Iterator[tuple]:
        if partition is None:  # what Spark hands over where there are no files
            return
        files, _ = _place(self.path)
        try:
            with files.open_input_stream(partition.path) as f:
                doc = json.loads(f.read().decode("utf-8-sig"), parse_constant=lambda _: None)
            error = None
            # all rows before the first is given, so a file gives its records or its error
            rows = list(self._rows(doc, partition))
        except (ValueError, RecursionError, Unfit) as e:
            nulls = [None] * (len(COLUMNS[self.kind].split(", ")) - (self.kind == "files"))
            rows = [(*nulls, partition.size) if self.kind == "files" else tuple(nulls)]
            error = f"{type(e).__name__}: {e}"[:200]
        yield from ((partition.path, error, *r) for r in rows)

    def _rows(self, doc: object, partition: File) -> Iterator[tuple]:
        if self.kind == "files":
            kind = kind_of(doc)
            inner = doc["results"] if kind == "report" else doc
            yield kind, 1 if kind == "curves" else None if kind == "other" else sum(map(len, doc)) if kind == "trials" else len(inner), partition.size
        elif self.kind == "curves":
            yield from _curve(doc)
        elif self.kind == "report":
            if kind_of(doc) != "report":
                raise Unfit("no object with results")
            meta, results = json.dumps({k: v for k, v in doc.items() if k != "results"}), doc["results"]
            for key, record in results.items() if isinstance(results, dict) else ((None, r) for r in results):
                yield meta, key, json.dumps(record)
        elif self.kind == "trials":
            if not isinstance(doc, list):
                raise Unfit("no list of trials")
            for trial, records in enumerate(doc):
                yield from ((trial, *r) for r in self._typed(records))
        elif self.kind == "pairs":
            for key, record in _records(doc).items():
                a, mark, b = key.partition("__x__")
                if not mark:
                    raise Unfit(f"no pair of types: {key}")
                if self._take(a, b):
                    yield a, b, *self._values(record)
        else:
            yield from self._typed(doc)

    def _typed(self, doc: object) -> Iterator[tuple]:
        for name, record in _records(doc).items():
            if self._take(name):
                # what older writers left out, as reports.read_fingerprints fills it in
                yield name, *self._values({"skewness_curve": [], "condition_number": 0.0, "n_mocks_used": 0} | record)

    def _values(self, record: dict) -> list[object]:
        return [_fitted(record.get(f.name), f.dataType) for f in self.fields]


class Results(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _kind(self) -> str:
        kind = self.options.get("kind", "fingerprints")
        if kind not in COLUMNS:
            raise ValueError(f"kind must be one of {', '.join(COLUMNS)}, not {kind}")
        return kind

    def schema(self) -> str:
        return f"file string, error string, {COLUMNS[self._kind()]}"

    def reader(self, schema: T.StructType) -> ResultReader:
        if not self.options.get("path"):
            raise ValueError("load needs a path")
        types = self.options.get("types")
        return ResultReader(self.options["path"], self._kind(), schema, types and json.loads(types))


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/*", "/", path))


def listed(path: str) -> list[File]:
    """The files of a path, by name."""
    files, root = _place(path)
    steps = root.split("/")
    fixed = next((i for i, s in enumerate(steps) if re.search(r"[*?\[]", s)), len(steps))
    base = "/".join(steps[:fixed]) or "/"
    top = files.get_file_info(base)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [top] if top.is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
    out = []
    for f in found:
        inside = PurePosixPath(f.path)
        hidden = f.path != base and any(s[:1] in "_." for s in inside.relative_to(base).parts)
        if f.is_file and not hidden and (fixed == len(steps) or any(p.full_match(root) for p in (inside, *inside.parents))):
            out.append(File(f.path, f.size))
    return sorted(out, key=lambda f: f.path)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(Results)


def read(spark: SparkSession, path: str, kind: str, types: Iterable[str] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format(FORMAT).option("kind", kind)
    if types is not None:
        reader = reader.option("types", json.dumps(list(types)))
    return reader.load(path)
