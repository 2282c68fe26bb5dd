"""Monthly CSV files: listing, and reading by header name with detected formats.

The first lines of each file, read through the file system without a Spark job, give its
delimiter, quote, column names, decimal mark and the shape of its dates. Where the shape
leaves open whether the day or the month comes first, one aggregate over the date column
of those files decides (a first number above 12 is a day, a second one a month first;
if all values fit both, the day comes first, or the month before an AM/PM time). Files
that agree in all this are one distributed read; normally that is every file.
"""

from __future__ import annotations

import csv
import fnmatch
import re
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import with_calendar
from ..schema import DATE_TIME, LOADED_COLUMNS, RAW_SCHEMA, SOURCE_FILE
from . import files

LISTING_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType(), True), T.StructField("filename", T.StringType(), True)]
)
# Delimiters and quotes told apart by the header line.
DELIMITERS = (",", ";", "\t", "|")
QUOTES = ('"', "'")
# Lines of a file that are looked at before it is read.
SAMPLE_LINES = 65
# Shapes of dates; in the last the day or the month comes first.
ISO, YEAR_FIRST, YEAR_LAST = "iso", "year first", "year last"
DAY_FIRST, MONTH_FIRST = "day first", "month first"
SHAPES = {
    ISO: r"^\s*\d{4}-\d{1,2}-\d{1,2}(?!\d)",
    YEAR_FIRST: r"^\s*\d{4}[/.]\d{1,2}[/.]\d{1,2}(?!\d)",
    YEAR_LAST: r"^\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)",
}
_AM_PM = r"(?i)\s*([ap])\.?m\.?\s*$"
_COMMA = re.compile(r"^\s*[+-]?(\d+|\d{1,3}(\.\d{3})+),\d+\s*$")
_POINT = re.compile(r"^\s*[+-]?\d+\.\d+\s*$")
# Names of hidden files are led by this while their copies are read.
SEEN = "hidden-"


@dataclass(frozen=True)
class Form:
    """How a file is written."""

    delimiter: str
    quote: str
    header: tuple[str, ...]
    dates: str = ISO
    comma: bool = False  # decimal comma
    copied: bool = False

    def place(self, name: str) -> int | None:
        """Column number of a name; the first one if it repeats."""
        known = [h.strip().lower() for h in self.header]
        return known.index(name.lower()) if name.lower() in known else None


def list_csv_files(spark: SparkSession, src_dir: str, pattern: str = "*.csv") -> DataFrame:
    """Files directly in ``src_dir`` whose name matches ``pattern`` (no recursion), as
    a DataFrame ``path, filename`` with the names as they are on disk. Only file
    metadata is read; a folder without matches, or a missing one, gives no rows."""
    found = [e for e in files.entries(spark, src_dir) if not e.is_dir and fnmatch.fnmatchcase(e.name, pattern)]
    return spark.createDataFrame([(e.path, e.name) for e in found], LISTING_SCHEMA)


def file_name() -> Column:
    """Name of the file a row comes from, as it is on disk: the reader's metadata
    gives it percent-encoded (a ``+`` stands for itself there)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def parse_header(line: str) -> Form:
    """Delimiter, quote and column names of a header line: those that find most of the
    source columns, then most columns."""
    wanted = {f.name.lower() for f in RAW_SCHEMA.fields}
    best, form = (-1, -1), Form(",", '"', ())
    for quote in QUOTES:
        for d in DELIMITERS:
            names = tuple(next(csv.reader([line.removeprefix("\ufeff")], delimiter=d, quotechar=quote), []))
            known = sum(n.strip().lower() in wanted for n in names)
            if (known, len(names)) > best:
                best, form = (known, len(names)), Form(d, quote, names)
    return form


def detect(lines: list[str]) -> Form:
    """Form of a file by its first lines; ``dates`` is ``YEAR_LAST`` or, if the dates seen
    have several shapes or none, empty where only the whole file can tell."""
    form = parse_header(lines[0] if lines else "")
    rows = list(csv.reader(lines[1:], delimiter=form.delimiter, quotechar=form.quote))

    def values(name: str) -> list[str]:
        i = form.place(name)
        return [] if i is None else [r[i] for r in rows if len(r) > i and r[i].strip()]

    dates = values(DATE_TIME)
    shapes = {next((k for k, p in SHAPES.items() if re.match(p, v)), "") for v in dates}
    numbers = [v for f in RAW_SCHEMA.fields if isinstance(f.dataType, (T.DoubleType, T.IntegerType)) for v in values(f.name)]
    comma = any(_COMMA.match(v) for v in numbers)
    if comma and any(_POINT.match(v) for v in numbers):
        comma = False  # a point is the decimal mark somewhere: let the cast tell
    return replace(form, dates=shapes.pop() if len(shapes) == 1 else "", comma=comma)


def _text(spark: SparkSession, form: Form, paths: list[str]) -> DataFrame:
    """All fields as text, named by place, so names that repeat or differ in blanks
    do no harm."""
    by_place = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(form.header))])
    reader = spark.read.schema(by_place).option("header", True).option("sep", form.delimiter)
    return reader.option("quote", form.quote).option("mode", "FAILFAST").csv([files.literal(p) for p in paths])


def _decide(spark: SparkSession, open_: dict[Form, list[str]]) -> dict[str, str]:
    """Order of the dates of each file whose first lines leave it open, by file name:
    one aggregate over their date columns."""
    parts = []
    for form, paths in open_.items():
        i = form.place(DATE_TIME)
        parts.append(_text(spark, form, paths).select(file_name().alias("file"), F.col(f"c{i}").alias("v")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = [F.regexp_extract("v", r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.]\d{4}", k).try_cast("int") for k in (1, 2)]
    seen = [F.max(F.col("v").rlike(p)).alias(k) for k, p in SHAPES.items()]
    late = [F.max(first[0]).alias("a"), F.max(first[1]).alias("b"), F.max(F.col("v").rlike(_AM_PM)).alias("am_pm")]
    made = {}
    for r in rows.where(F.col("v").isNotNull()).groupBy("file").agg(*seen, *late).collect():
        shapes = [k for k in SHAPES if r[k]]
        if len(shapes) > 1 or (r["a"] or 0) > 12 and (r["b"] or 0) > 12:
            raise ValueError(f"dates of several formats in {r['file']}")
        made[r["file"]] = shapes[0] if shapes else ISO
        if shapes == [YEAR_LAST]:
            month_first = r["b"] > 12 or r["a"] <= 12 and r["am_pm"]
            made[r["file"]] = MONTH_FIRST if month_first else DAY_FIRST
    return made


def _timestamp(c: Column, dates: str) -> Column:
    """Text to timestamp: the date is brought into ISO order, then cast, so a value
    of another format is an error."""
    shape, order = {
        YEAR_FIRST: (r"^\s*(\d{4})[/.](\d{1,2})[/.](\d{1,2})", "$1-$2-$3"),
        DAY_FIRST: (r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "$3-$2-$1"),
        MONTH_FIRST: (r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", "$3-$1-$2"),
    }.get(dates, (None, None))
    if shape is None:
        return c.cast("timestamp_ntz")
    half = F.lower(F.regexp_extract(c, _AM_PM, 1))
    at = F.regexp_replace(F.regexp_replace(c, shape, order), _AM_PM, "").cast("timestamp_ntz")
    hour = F.hour(at)
    shift = F.when((half == "p") & (hour < 12), 12).when((half == "a") & (hour == 12), -12).otherwise(0)
    return at + F.make_dt_interval(F.lit(0), shift)


def _coerce(c: Column, dtype: T.DataType, form: Form) -> Column:
    """Text field to the target type. Integer columns go through double and
    round half to even, so ``58.7`` is stored as 59 and ``2.5`` as 2."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.TimestampNTZType):
        return _timestamp(c, form.dates)
    number = (F.translate(c, ".,", "\x00.") if form.comma else c).cast("double")
    return F.rint(number).cast("int") if isinstance(dtype, T.IntegerType) else number


def forms_of(spark: SparkSession, paths: list[str]) -> list[Form]:
    """Form of each file."""
    found = [detect(lines) for lines in files.heads(spark, paths, SAMPLE_LINES)]
    open_: dict[Form, list[str]] = defaultdict(list)
    for p, form in zip(paths, found):
        missing = [f.name for f in RAW_SCHEMA.fields if form.place(f.name) is None]
        if missing:
            raise ValueError(f"CSV file {p} lacks columns {missing}")
        if form.dates in ("", YEAR_LAST):
            open_[form].append(p)
    if not open_:
        return found
    decided = _decide(spark, open_)
    return [replace(f, dates=decided.get(_name(p), ISO)) if f.dates in ("", YEAR_LAST) else f for p, f in zip(paths, found)]


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_csv_files(spark: SparkSession, found: list[tuple[str, str]], staging: str) -> DataFrame:
    """Read monthly CSV files, given as (name, path), into the stored layout (source
    columns by header name, calendar columns, ``source_file``).

    Columns are matched by header name, so their order and any extra columns in
    a file do not matter. Spark takes the column names of a multi-file CSV read from
    the first file only, so each form is a read of its own.

    Spark's readers pass over names that begin with ``_`` or ``.``; such files are
    copied, as a stream, to a name they read in ``staging``, which the caller deletes
    when the rows are written.
    """
    paths = []
    for name, path in found:
        if files.hidden(name):
            target = f"{staging}/{SEEN}{name}"
            files.copy(spark, path, target)
            path = target
        paths.append(path)
    groups: dict[Form, list[str]] = defaultdict(list)
    for (name, _), path, form in zip(found, paths, forms_of(spark, paths)):
        groups[replace(form, copied=files.hidden(name))].append(path)
    frames = []
    for form, members in groups.items():
        name = F.substring(file_name(), len(SEEN) + 1, 1 << 30) if form.copied else file_name()
        columns = [_coerce(F.col(f"c{form.place(f.name)}"), f.dataType, form).alias(f.name) for f in RAW_SCHEMA.fields]
        frames.append(_text(spark, form, members).select(*columns, name.alias(SOURCE_FILE)))
    if not frames:
        return spark.createDataFrame([], T.StructType(RAW_SCHEMA.fields + [T.StructField(SOURCE_FILE, T.StringType())]))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def to_stored(raw: DataFrame) -> DataFrame:
    """Source columns (+ ``source_file``) to what a load is made of."""
    return with_calendar(raw).select(*LOADED_COLUMNS)
