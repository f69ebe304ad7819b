"""Log files as rows: what is in a file, how it is read, and which parser takes it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlake.sources.parsers import detect, parse_rows, resolve, row_hash  # noqa: F401

# Limits of a file.
LARGEST, DELIMITERS, NAME_LENGTH, SAMPLE_COLUMNS = 500 * 1024 * 1024, ",;\t|", 50, 20
# End of the fixed values.


def delimiter(head: list[str]) -> str:
    """The delimiter that occurs most in the first lines; the first of them in a tie, a comma without any."""
    counts = [sum(line.count(d) for line in head[:5]) for d in DELIMITERS]
    return DELIMITERS[counts.index(max(counts))]


MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def encoding(content: bytes) -> str:
    """By byte order mark, then UTF-8, else Latin-1."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return name
    try:
        content.decode()
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def encoding_of(spark: SparkSession, path: str) -> str:
    """encoding() of a whole file, whose lines are tested by all tasks until the first that isn't UTF-8."""
    # lines as they are on disk; the text reader doesn't decode them
    lines = spark.read.text(path)
    first = lines.select(F.col("value").cast("binary")).first()
    for mark, name in MARKS:
        if first and bytes(first[0]).startswith(mark):
            return name
    return "UTF-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"


def _opened(spark: SparkSession, path: str) -> tuple[str, list[str], Callable[[], DataFrame]]:
    """(encoding, first lines, reader of undivided lines) of a file."""
    charset = encoding_of(spark, path)
    text = lambda: spark.read.csv(path, sep="\x00", quote="", header=False, schema="value string", encoding=charset, multiLine=charset.startswith("UTF-16"))
    return charset, [(r[0] or "").lstrip("\ufeff") for r in text().limit(5).collect()], text


def broken_lines(text: DataFrame) -> bool:
    """Whether quotes may hold line breaks: some line has an odd number of quotes."""
    return not text.where((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1).isEmpty()


def _csv(spark: SparkSession, path: str, sep: str, charset: str, multi: bool = True, **more) -> DataFrame:
    return spark.read.csv(path, sep=sep, mode="PERMISSIVE", escape='"', multiLine=multi, encoding=charset, **more)


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """rows with row_number counted from `first` without gaps, in the order of the scan: a pass counts the rows of each
    partition, whose offsets (a row for each partition) are broadcast."""
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    offsets, at = [], first
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    table = rows.sparkSession.createDataFrame(offsets, "_p int, _from long")
    placed = rows.select(F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_i"), *rows.columns)
    # what a partition holds goes with its number, before the join
    return placed.join(F.broadcast(table), "_p").select((F.col("_from") + F.col("_i")).alias("row_number"), *(f"`{c}`" for c in rows.columns))


def read_rows(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(format, rows with row_number): `delimited` with one string column a field, or `lines` with logevent."""
    charset, head, text = _opened(spark, path)
    first = head[0] if head else ""
    if first.lstrip('"').startswith("<") and ("HTTP/" in first or "httpd[" in first):
        lines = text().where("trim(value) != ''").select(F.regexp_replace(F.regexp_replace("value", '^"(<.*)"$', "$1"), '""', '"').alias("logevent"))
        return "lines", numbered(lines, 1)
    # a file is only read by one task if a quoted field may run over lines
    multi = charset.startswith("UTF-16") or broken_lines(text())
    rows = _csv(spark, path, delimiter(head), charset, multi, header=True, enforceSchema=False)
    clean = [F.col(f"`{c}`").alias(c.strip().strip("|").strip().lower()) for c in rows.columns]
    return "delimited", numbered(rows.select(*clean), 2)


def _numeric(cell: str) -> bool:
    try:
        float(cell.replace(",", ""))
        return True
    except ValueError:
        return False


def is_header(first: list[str], second: list[str]) -> bool:
    """Whether the first row names columns: short cells without numbers, over a row that has a number; blanks don't count."""
    return all(not _numeric(c) and len(c) < NAME_LENGTH for c in first if c.strip()) and any(_numeric(c) for c in second if c.strip())


def validate(spark: SparkSession, path: str) -> dict:
    """What is found of a file: bytes, encoding, delimiter, rows without the first, columns, has_header, sample_columns,
    errors and warnings. Its content is only read if the size allows; rows are counted by Spark."""
    found: dict = {"bytes": 0, "errors": [], "warnings": [] if path.lower().endswith(".csv") else ["not a .csv file"]}
    sizes = [r[0] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    found["bytes"] = sum(sizes)
    if not 0 < found["bytes"] <= LARGEST:
        return found | {"errors": ["empty" if not found["bytes"] else "too large"]}
    charset, head, _ = _opened(spark, path)
    sep = delimiter(head)
    top = [[c or "" for c in r] for r in _csv(spark, path, sep, charset, header=False).limit(2).collect()]
    found |= {"encoding": charset, "delimiter": sep}
    if len(top) < 2:
        return found | {"rows": len(top), "errors": ["a header and a row are needed"]}
    names = [c.lstrip("\ufeff") for c in top[0]]
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "bad string"])
    rows = _csv(spark, path, sep, charset, header=False, schema=schema, columnNameOfCorruptRecord="bad")
    # the digest makes the reader parse all columns, without which it doesn't see how many there are
    rows = rows.select((F.monotonically_increasing_id() + 1).alias("row"), F.col("bad").isNotNull().alias("ragged"), F.xxhash64(*rows.columns[:-1]).alias("digest"))
    n, ragged, _ = rows.agg(F.count("*"), F.count_if(F.col("ragged") & (F.col("row") > 1)), F.bit_xor("digest")).first()
    blank = [i for i, c in enumerate(names) if not c.strip()]
    if blank:
        found["warnings"].append(f"blank headers at {blank}")
    if ragged:
        at = [r[0] for r in rows.where("ragged and row > 1").orderBy("row").limit(10).collect()] if ragged <= 10 else []
        found["warnings"].append(f"{ragged} rows of another width" + (f": {at}" if at else ""))
    return found | {"rows": n - 1, "columns": len(names), "has_header": is_header(*top), "sample_columns": names[:SAMPLE_COLUMNS]}


def parse(spark: SparkSession, path: str, order: str | None = None, parser: str | None = None) -> DataFrame:
    """The rows of a file by the named parser, or by the one that is most confident of it."""
    _, rows = read_rows(spark, path)
    return parse_rows(rows, parser, order)


def catalogue(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, bytes, modified, sha256, valid) of the files of a folder; files over the limit aren't valid, and aren't read; Spark lists no empty ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    columns = ["path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    fits = files.where(F.col("length") <= LARGEST).select(*columns, F.sha2("content", 256).alias("sha256"), F.lit(True).alias("valid"))
    return fits.union(files.where(F.col("length") > LARGEST).select(*columns, F.lit(None).cast("string"), F.lit(False)))


def storage_stats(files: DataFrame) -> DataFrame:
    """One row: how many files of a catalogue there are, their bytes, and megabytes to two decimals."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / (1 << 20), 2).alias("megabytes"))
