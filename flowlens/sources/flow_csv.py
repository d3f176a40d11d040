"""Raw capture CSVs → one text table with canonical headers (SRC-1..8, T1–T7).

All files of a folder are read by one scan of text lines, stored with (file,
start of the block, place in the scan). Everything else reads that table:

* A line's position in its file (WIN-1) is the number of lines in the file's
  earlier blocks plus its place in its own block. Places are read, never
  computed again, so a scan that is split otherwise cannot renumber them.
* The line at position 0 is the file's header. Headers are canonicalised on the
  driver, one row a file, and files with the same header are one header form.
* One ``from_csv`` with a positional all-STRING schema parses the lines of all
  forms, so repeated or oddly spaced headers never reach Spark's own header
  handling; a column picks its cell by its file's form.

A file that cannot be read, is empty or lacks the label column is a row of the
file report (status and message); the others' rows are read all the same.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.names import canonicalize
from flowlens.session import stored

ENCODING = "ISO-8859-1"  # the captures are latin1 ('latin1' is not accepted by Spark)
#: Files up to which the table of files is sent to every task.
MAX_FILES_BROADCAST = 100_000
META = ("source_file", "source_row", "dataset", "original_label", "attack_family")


@dataclass(frozen=True)
class RawCapture:
    name: str
    data: DataFrame  # canonical text columns + source_file + source_row
    columns: list[str]
    duplicates: list[str]


@dataclass(frozen=True)
class HeaderForm:
    columns: list[str]  # canonical names, in order
    cells: list[int]  # where each column stands in a line
    duplicates: list[str]
    files: list[str]


@dataclass(frozen=True)
class CaptureScan:
    data: DataFrame  # text columns of all forms (NULL where a form lacks one) + source_file + source_row
    forms: list[HeaderForm]
    files: DataFrame  # file, status (ok, empty, unreadable, no label), message, rows
    label: str

    @property
    def names(self) -> list[str]:
        """Files whose rows were read, sorted."""
        return sorted(f for form in self.forms for f in form.files)

    @property
    def candidates(self) -> list[str]:
        """Candidate feature columns: the first file's order, then new ones."""
        by_file = {f: form for form in self.forms for f in form.files}
        ordered = dict.fromkeys(c for name in sorted(by_file) for c in by_file[name].columns)
        return [c for c in ordered if c not in {self.label, *META}]

    @property
    def absent(self) -> dict[str, list[str]]:
        """Per candidate column the files that lack it."""
        return {c: sorted(f for form in self.forms if c not in form.columns for f in form.files) for c in self.candidates}

    @property
    def duplicates(self) -> dict[str, list[str]]:
        return {f: form.duplicates for form in self.forms if form.duplicates for f in form.files}


def _listing(spark: SparkSession, directory: str, fragment: str | None) -> dict[str, str]:
    """name -> path of every ``*.csv``, sorted by name; nothing is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
    found = {r["file_name"]: r["path"] for r in files.select("path", "_metadata.file_name").collect()}  # one row a file
    if fragment is not None:
        found = {n: p for n, p in found.items() if fragment.lower() in n.lower()}
    if not found:
        raise FileNotFoundError(f"No CSV files found in {directory}" + (f" matching '{fragment}'" if fragment else ""))
    return dict(sorted(found.items()))


def list_csv(spark: SparkSession, directory: str, fragment: str | None = None) -> list[str]:
    """SRC-1/SRC-4: every ``*.csv`` under ``directory`` sorted by name,
    optionally only names containing ``fragment`` (case-insensitive)."""
    return list(_listing(spark, directory, fragment).values())


def stored_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, position, line: the non-blank lines of all files, from one scan.
    Files that fail are left out."""
    scan = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(list(paths))
    raw = scan.select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.decode(F.col("value").cast("binary"), ENCODING).alias("line"),
    )
    raw = raw.where(F.trim("line") != "").withColumn("place", F.monotonically_increasing_id())
    lines = stored(raw, "capture-lines")
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    shifts = blocks.select("file", "block", shift.alias("shift"))
    return lines.join(shifts, ["file", "block"]).select("file", (F.col("place") + F.col("shift")).alias("position"), "line")


def _probe(spark: SparkSession, path: str) -> tuple[str, str]:
    """(status, message) of a file that gave no line."""
    try:
        spark.read.text(path).count()
    except PySparkException as trouble:
        return "unreadable", str(trouble).splitlines()[0][:500]
    except Exception as trouble:  # what the file system raised, as Py4J hands it on
        return "unreadable", str(getattr(trouble, "java_exception", trouble)).splitlines()[0][:500]
    return "empty", "no line with text"


def _cell(forms: Sequence[HeaderForm], column: str) -> Column:
    """The cell of ``column``, by the form of the line's file."""
    out = F.lit(None).cast("string")
    for number, form in enumerate(forms):
        if column in form.columns:
            out = F.when(F.col("form") == number, F.col(f"cells._c{form.cells[form.columns.index(column)]}")).otherwise(out)
    return out.alias(column)


def scan_directory(
    spark: SparkSession, directory: str, fragment: str | None = None, label: str | None = "label", strict: bool = True
) -> CaptureScan:
    """Every capture of a folder as one text table. ``strict`` raises on the
    first file that is empty, unreadable or has no ``label`` column; otherwise
    such files are skipped and reported (SRC-5)."""
    paths = _listing(spark, directory, fragment)
    lines = stored_lines(spark, list(paths.values()))
    heads = {r["file"]: r["line"] for r in lines.where(F.col("position") == 0).collect()}  # one row a file
    trouble, by_header = {}, {}
    for name, path in paths.items():
        if name not in heads:
            trouble[name] = _probe(spark, path)
            continue
        header = tuple(next(csv.reader([heads[name]])))
        if label is not None and label not in canonicalize(list(header))[0]:
            trouble[name] = ("no label", f"missing label column in {name}")
            continue
        by_header.setdefault(header, []).append(name)
    if strict and trouble:
        name, (status, message) = next(iter(trouble.items()))
        kind = {"no label": KeyError, "empty": ValueError}.get(status, OSError)
        raise kind(f"{name}: {status}: {message}")
    forms = []
    for header, files in by_header.items():
        names, keep, repeated = canonicalize(list(header))
        forms.append(HeaderForm([names[i] for i in keep], list(keep), repeated, files))
    told = [(f, n) for n, form in enumerate(forms) for f in form.files]
    table = spark.createDataFrame(told, "file string, form int")
    table = F.broadcast(table) if len(told) <= MAX_FILES_BROADCAST else table
    width = max((len(h) for h in by_header), default=1)
    schema = ", ".join(f"_c{i} string" for i in range(width))
    body = lines.where(F.col("position") > 0).join(table, "file").withColumn("cells", F.from_csv("line", schema, {"mode": "PERMISSIVE"}))
    columns = list(dict.fromkeys(c for form in forms for c in form.columns))
    data = body.select(*[_cell(forms, c) for c in columns], F.col("file").alias("source_file"), (F.col("position") - 1).alias("source_row"))
    rows = lines.groupBy("file").agg((F.count(F.lit(1)) - 1).alias("rows"))
    status = [(n, *trouble.get(n, ("ok", ""))) for n in paths]
    report = spark.createDataFrame(status, "file string, status string, message string").join(rows, "file", "left")
    report = report.withColumn("rows", F.when(F.col("status") == "ok", F.col("rows")).otherwise(0).cast("bigint"))
    return CaptureScan(data, forms, report, label or "label")


def read_directory(spark: SparkSession, directory: str) -> list[RawCapture]:
    """One capture per file, all of them views of one scan."""
    scan = scan_directory(spark, directory, label=None)
    form = {f: x for x in scan.forms for f in x.files}
    return [
        RawCapture(n, scan.data.where(F.col("source_file") == n).select(*form[n].columns, "source_file", "source_row"), form[n].columns, form[n].duplicates)
        for n in scan.names
    ]
