"""Delimited text sources: wide series matrices and transposed attribute sheets.

Both are read as lines and turned into cells with ``posexplode``; the header is a small
(position, name) table joined by position. The plan has the same size for ten or for a hundred
thousand columns, and the file is split across tasks by line.
"""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet import fixed
from freshet.functions.scalars import normal_name, normal_names, to_number, to_time
from freshet.sources.ledger import Ledger


def resolve_input(spark: SparkSession, path: str) -> str:
    """The path itself, or with ``.txt``, or with ``.csv``: the first that exists."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for candidate in (path, f"{path}.txt", f"{path}.csv"):
        place = jvm.org.apache.hadoop.fs.Path(candidate)
        if place.getFileSystem(conf).exists(place):
            return candidate
    raise FileNotFoundError(path)


#: Marks the cuts of a line with quotes; a control character that texts don't hold.
CUT = "\x1e"


def split_fields(line, sep: str = "\t") -> Column:
    """Fields of a line; a separator inside double quotes does not split."""
    line = F.col(line) if isinstance(line, str) else line
    plain = re.escape(sep)
    # Between quotes, every second piece is outside of them, counted from the line's end; only there
    # separators become cuts. No look-ahead: its depth and time would grow with the line.
    pieces = F.reverse(F.split(F.translate(line, CUT, " "), '"', -1))
    outside = F.reverse(
        F.transform(pieces, lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit(sep), F.lit(CUT))).otherwise(piece))
    )
    quoted = F.transform(
        F.split(F.array_join(outside, '"'), CUT, -1),
        lambda f: F.replace(
            F.regexp_replace(f, r'^\s*"(.*)"\s*$', "$1"), F.lit('""'), F.lit('"')
        ),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, plain, -1))


def undecodable_files(spark: SparkSession, place: str) -> list[str]:
    """Files with a line that is not valid UTF-8. Bytes are checked where they are read; only names come back."""
    checked = spark.read.text(place).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    bad = checked.filter(~F.col("valid")).select("file").distinct()
    return sorted(unquote(r["file"]) for r in bad.collect())


def _raw_text(spark: SparkSession, path: str, encoding: str, fallback: str | None) -> DataFrame:
    place = resolve_input(spark, path)

    def decoded(files, name: str) -> DataFrame:
        # The text source knows UTF-8 only; a CSV scan with one column decodes, still line by line.
        return spark.read.schema("value string").csv(files, sep="\u0001", quote="", encoding=name)

    if encoding.lower() not in ("utf-8", "utf8"):
        return decoded(place, encoding)
    bad = undecodable_files(spark, place) if fallback else []
    if not bad:
        return spark.read.text(place).select("value")
    name = F.col("_metadata.file_path")
    kept = ~name.isin(*bad, *[quote(f, safe=":/") for f in bad])
    return spark.read.text(place).filter(kept).select("value").union(decoded(bad, fallback))


def _bare(text: DataFrame) -> DataFrame:
    return text.select(F.regexp_replace("value", r"^\uFEFF+|\uFFFD", "").alias("line"))


def read_lines(spark: SparkSession, path: str, *, encoding: str = "utf-8", fallback: str | None = None) -> DataFrame:
    """Text lines (LF, CRLF or CR) without byte-order mark, undecodable bytes dropped.

    With a ``fallback``, the bytes of every file are checked first, and files that are not valid UTF-8 are read in that
    encoding instead; the others stay UTF-8.
    """
    return _bare(_raw_text(spark, path, encoding, fallback))


def clean_lines(lines: DataFrame, *, line: str = "line", collapse_tabs: bool = False) -> DataFrame:
    """Lines without byte-order mark and double quotes; blank lines are dropped.

    ``collapse_tabs`` turns runs of TABs into one. That shifts cells left where a cell is empty, so
    it is off unless asked for.
    """
    text = F.replace(F.regexp_replace(F.col(line), r"^\uFEFF+", ""), F.lit('"'), F.lit(""))
    if collapse_tabs:
        text = F.regexp_replace(text, "\t+", "\t")
    out = lines.withColumn(line, text)
    return out.filter(~F.col(line).rlike(r"^\s*$"))


def strip_comments(lines: DataFrame, mark: str = "#", *, line: str = "line") -> DataFrame:
    """Cut each line at the comment mark; lines left empty are dropped."""
    cut = lines.withColumn(line, F.substring_index(F.col(line), mark, 1))
    return cut.filter(F.trim(line) != "")


def _header(lines: DataFrame) -> str:
    first = lines.head(1)
    if not first:
        raise ValueError("the file has no rows")
    return first[0]["line"]


def _names(spark: SparkSession, header: str, sep: str) -> DataFrame:
    one = spark.createDataFrame([(header,)], "line string")
    return one.select(F.posexplode(split_fields("line", sep)).alias("pos", "name"))


def melt_wide(
    df: DataFrame, value: str, *, time: str, key: str = fixed.KEY, columns: list[str] | None = None
) -> DataFrame:
    """Wide frame (one column per series) to long (key, date, value)."""
    columns = [c for c in df.columns if c != time] if columns is None else columns
    return df.unpivot(time, columns, key, value).select(
        key, F.col(time).alias(fixed.TIME), value
    )


def read_wide(
    spark: SparkSession,
    path: str,
    value: str,
    *,
    sep: str = "\t",
    date_col: str | None = None,
    time_type: str = "date",
    comment: str = "#",
    na_marks: list[str] = fixed.NA_MARKS,
    encoding: str = "utf-8",
    fallback: str | None = None,
    ledger: Ledger | None = None,
) -> DataFrame:
    """Wide series matrix -> (basin_id, date, value). Rows without a readable date are dropped.

    A ``ledger`` counts, in the scan that the result's own action makes, what is dropped or becomes missing; its
    ``check`` then fails where rows were there and no date was readable.
    """
    text = _raw_text(spark, path, encoding, fallback)
    header = _header(strip_comments(_bare(text), comment))
    # the ledger counts in the action on the result, not in this look at the first line
    lines = strip_comments(_bare(text if ledger is None else ledger.bytes_of(text)), comment)
    names = normal_names(
        [r["name"] for r in _names(spark, header, sep).orderBy("pos").collect()]
    )
    if date_col is not None and date_col not in names:
        raise ValueError(f"no date column {date_col!r} in {path}: {names[:10]}")
    at = 0 if date_col is None else names.index(date_col)
    columns = _names(spark, header, sep).select("pos", normal_name("name").alias(fixed.KEY))
    # A line that ends early lacks its last cells: they are missing values, not missing rows.
    short = F.greatest(F.lit(0), F.lit(len(names)) - F.size("fields"))
    padded = F.concat("fields", F.array_repeat(F.lit(None).cast("string"), short)).alias("fields")
    parsed = lines.select((F.col("line") == header).alias("title"), split_fields("line", sep).alias("fields"))
    parsed = parsed.select("title", (F.size("fields") < len(names)).alias("short"), padded)
    parsed = parsed.select("title", "short", to_time(F.trim(F.get("fields", F.lit(at))), time_type).alias(fixed.TIME), "fields")
    if ledger is not None:
        parsed = ledger.lines_of(parsed, fixed.TIME)
    cells = (
        parsed.filter(F.col(fixed.TIME).isNotNull())
        .select(fixed.TIME, F.posexplode("fields").alias("pos", "cell"))
        .filter(F.col("pos") != at)
    )
    marks = sorted({m.strip() for m in na_marks})
    cell = F.when(~F.trim("cell").isin(marks), to_number("cell"))
    # The header is one line of the file: no larger than a row, so it may be broadcast.
    out = cells.join(F.broadcast(columns), "pos").select(fixed.KEY, fixed.TIME, "cell", cell.alias(value))
    if ledger is not None:
        out = ledger.cells_of(out, ~F.trim("cell").isin(marks) & F.col(value).isNull())
    return out.drop("cell")


def attribute_cells(
    spark: SparkSession,
    path: str,
    *,
    sep: str = "\t",
    collapse_tabs: bool = False,
    encoding: str = "utf-8",
) -> DataFrame:
    """Transposed sheet -> (attribute, basin_id, value, line_no), values still text."""
    lines = clean_lines(read_lines(spark, path, encoding=encoding), collapse_tabs=collapse_tabs)
    lines = strip_comments(lines)
    header = _header(lines)
    names = _names(spark, header, sep).select("pos", F.trim("name").alias(fixed.KEY))
    titles = [r[fixed.KEY] for r in names.orderBy("pos").collect()]
    at = _id_position(titles)
    cells = (
        lines.withColumn("line_no", F.monotonically_increasing_id())
        .filter(F.col("line") != header)
        .select("line_no", split_fields("line", sep).alias("fields"))
        .select(
            "line_no",
            F.get("fields", F.lit(at)).alias("attribute"),
            F.posexplode("fields").alias("pos", "value"),
        )
        .filter(F.col("pos") != at)
    )
    return cells.join(F.broadcast(names), "pos").select("attribute", fixed.KEY, "value", "line_no")


def _id_position(titles: list[str]) -> int:
    """Where the attribute names stand: ``gauge_id``, or the first title that spells it loosely."""
    if "gauge_id" in titles:
        return titles.index("gauge_id")
    for i, title in enumerate(titles):
        if title.lower().replace("_", "") in {"gaugeid", "gauge", "id"}:
            return i
    raise ValueError(f"no gauge_id column among {titles[:10]}")


def pivot_attributes(
    cells: DataFrame,
    names: list[str] | None = None,
    *,
    key: str = fixed.KEY,
    attribute: str = "attribute",
    value: str = "value",
    order: str = "line_no",
) -> DataFrame:
    """One row per series, one numeric column per attribute.

    The attribute names become the schema, so they are read once when not given. Where a cell occurs
    twice, the first in ``order`` that has a value wins.
    """
    cells = cells.withColumn(attribute, normal_name(attribute))
    kept = cells.filter(F.col(value).isNotNull() & (F.trim(value) != ""))
    if names is None:
        names = [r[0] for r in kept.select(attribute).distinct().orderBy(attribute).collect()]
    wide = kept.groupBy(key).pivot(attribute, names).agg(F.min_by(value, order))
    return wide.select(key, *[to_number(F.col(f"`{n}`")).alias(n) for n in names])


def read_attributes(spark: SparkSession, path: str, **options) -> DataFrame:
    """Transposed attribute sheet -> one row per series; options as in :func:`attribute_cells`."""
    return pivot_attributes(attribute_cells(spark, path, **options))
