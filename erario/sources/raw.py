"""Reading the raw budget CSV."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from erario.functions.parsing import known

_BAD_BYTE = "�"
_PROBE = "desc_ramo"
_QUOTING = {"quote": '"', "escape": '"'}
#: Pieces of a split: whole records, its file's header, the end of a record begun before, the start of
#: one that ends later.
RECORD, HEADER, TAIL, HEAD = range(4)


def _names(spark: SparkSession, path: str, encoding: str) -> list[str]:
    return spark.read.options(header=True, encoding=encoding, multiLine=True, **_QUOTING).csv(path).columns


def _csv(spark: SparkSession, path: str, encoding: str, multiline: bool) -> DataFrame:
    """All columns declared as text under the names of the first header.  The headers of all files
    are held against it, so a file whose columns stand in another order fails the read."""
    declared = StructType([StructField(n, StringType()) for n in _names(spark, path, encoding)])
    reader = spark.read.options(header=True, encoding=encoding, multiLine=multiline, enforceSchema=False, **_QUOTING)
    return reader.schema(declared).csv(path)


def _odd_quotes() -> Column:
    """Whether a line has an odd number of quotes, so that it opens or closes a text over a line end."""
    return (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2


def _quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether a record runs over a line end: then some line has an odd number of quotes."""
    return bool(spark.read.text(path).filter(_odd_quotes() == 1).take(1))


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits (file, block, value, inside, odd) to pieces of records, in the order of lines.

    ``inside``: whether the split begins within a quoted text."""
    place, held, kind, inside = None, [], RECORD, False
    first = False
    out: list[tuple] = []

    def close() -> None:
        nonlocal held, kind, first
        if held:
            out.append((*place, kind, b"\n".join(held)))
            first = False
        held, kind = [], HEADER if first else RECORD

    for batch in batches:
        for file, block, value, begins, odd in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != place:
                if held:
                    kind = HEAD if kind != TAIL else TAIL
                close()
                place, inside, first = (file, block), begins, block == 0
                kind = TAIL if inside else HEADER if first else RECORD
            held.append(value)
            inside ^= bool(odd)
            if not inside:
                close()
        if out:
            yield _batch(out)
            out = []
    if held:
        kind = HEAD if kind != TAIL else TAIL
        close()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, kind, text = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(file), pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(text, pa.binary())],
        names=["file", "block", "kind", "text"])


def split_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, kind, text) of every record of CSV files whose records run over line ends, a task
    a split.

    The parity of quotes of the splits before one tells whether it begins within a record; so each
    split finds its own records, and only those over a border are put together from their pieces.  A
    row a split is summed up, and at most two pieces a split meet by file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        _odd_quotes().alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        lines.groupBy("file", "block").agg(F.sum("odd").alias("quotes"))
        .select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    )
    pieces = (
        lines.join(F.broadcast(begins), ["file", "block"])  # a row a split
        .select("file", "block", F.col("value").cast("binary").alias("value"), "inside", "odd")
        .mapInArrow(_pieces, "file string, block long, kind int, text binary")
    )
    along = Window.partitionBy("file").orderBy("block", "kind")  # an end stands before the start behind it
    parts = pieces.where(F.col("kind").isin(TAIL, HEAD)).withColumn("n", F.count_if(F.col("kind") == HEAD).over(along))
    ordered = F.array_sort(F.collect_list(F.struct("block", "kind", "text")))
    whole = parts.groupBy("file", "n").agg(ordered.alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.lit(RECORD).alias("kind"),
        F.aggregate(
            F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.col("p")[0]["text"],
            lambda text, x: F.concat(text, F.lit(b"\n"), x["text"])).alias("text"))
    return pieces.where(~F.col("kind").isin(TAIL, HEAD)).unionByName(whole)


def _decoded(encoding: str) -> Column:
    """The text without the carriage return of its line end."""
    text = F.make_valid_utf8(F.col("text").cast("string")) if encoding == "UTF-8" else F.decode("text", encoding)
    return F.regexp_replace(text, r"\r\z", "")


def _split_csv(spark: SparkSession, path: str, encoding: str) -> DataFrame | None:
    """All columns as text, or None if the pieces cannot be trusted: quotes stand within unquoted fields,
    so that some record has another number of fields than the header, or a header runs over a split."""
    names = _names(spark, path, encoding)
    records = split_records(spark, path).select("file", "kind", _decoded(encoding).alias("text")).where("text <> ''")
    bare = F.regexp_replace("text", r'(^|,)"(?:[^"]++|"")*+"(?=,|\z)', "$1")  # without quoted fields
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    checks = records.agg(
        F.count_if((commas != len(names) - 1) | F.contains(bare, F.lit('"'))).alias("odd"), F.count_distinct("file").alias("files"),
        F.count_if(F.col("kind") == HEADER).alias("with_header"),
        F.collect_set(F.when(F.col("kind") == HEADER, F.col("text"))).alias("headers")).first()
    if checks["odd"] or checks["files"] != checks["with_header"]:
        return None
    if len(checks["headers"]) > 1:
        raise ValueError(f"the files under {path} have different headers")
    declared = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records.where(F.col("kind") != HEADER)
    return rows.select(F.from_csv("text", declared, _QUOTING).alias("r")).select("r.*")


def read_raw_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    quoted_newlines: bool | None = None,
) -> DataFrame:
    """All columns as text, missing-value tokens as null.

    Files are split, also those with quoted line ends (a check decides which way, and
    ``quoted_newlines`` skips it); only one with quotes inside unquoted fields as well is parsed whole.
    UTF-8 is read first; if that leaves replacement characters in the branch names, the file is read
    as Latin-1."""
    def read(code: str) -> DataFrame:
        if whole:
            df = _split_csv(spark, path, code)
            return _csv(spark, path, code, True) if df is None else df
        return _csv(spark, path, code, False)

    try:
        whole = _quoted_newlines(spark, path) if quoted_newlines is None else quoted_newlines
        df = read(encoding or "UTF-8")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no budget CSV at {path}") from e
        raise
    if encoding is None and _PROBE in df.columns:
        if df.filter(F.col(_PROBE).contains(_BAD_BYTE)).take(1):
            df = read("ISO-8859-1")
    return df.select(*[known(F.col(c)).alias(c) for c in df.columns])
