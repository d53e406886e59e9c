"""Record files: positional, all text, one header line, ``NA`` for a missing value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import null_if_in
from recordloom.operators.joins import lookup_join
from recordloom.schemas import CASE_FILE_COLUMNS, CASE_FILE_SCHEMA, LOOKUP_FILE_COLUMNS, LOOKUP_FILE_SCHEMA
from recordloom.session import SMALL_CODEC, stage

_CORRUPT = "_bad_record"
#: A longer record, of text that is read in splits, is reported and not put together.
RECORD_BYTES = 64 * 1024 * 1024
#: A larger file is read in splits also where files are read by one task each.
WHOLE_BYTES = 256 * 1024 * 1024
# "\u0001" never occurs: an unquoted empty field comes back as NULL and "" as '', so both can be made ''
_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "encoding": "UTF-8",
    "nullValue": "\u0001",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_options(multi_line: bool = True) -> dict[str, str]:
    """Reader options. With ``multi_line`` a quoted field may hold line breaks, but each file is read by one task."""
    return {
        **_OPTIONS, "multiLine": str(multi_line).lower(), "columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE",
    }


def file_schema(columns: T.StructType) -> T.StructType:
    """The file columns plus a slot for records with too few or too many fields."""
    return T.StructType([*columns.fields, T.StructField(_CORRUPT, T.StringType())])


_FILE = ("file_name", "file_path", "file_size_bytes")


def _with_file(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        *columns,
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size_bytes"),
    )


def _cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    is_bad = F.col(_CORRUPT).isNotNull() | (F.octet_length(F.coalesce(F.col(columns[0]), F.lit(""))) < 0)
    values = [null_if_in(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns]
    return df.select(*values, is_bad.alias("is_bad"), *_FILE)


def clean_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Empty fields are '' and ``NA`` is NULL; adds ``is_bad`` and the file a row came from.

    ``is_bad`` also looks at a data column, because Spark refuses to read the slot for bad records alone.
    """
    return _cleaned(_with_file(df, *columns, _CORRUPT), columns)


def _ends_inside(value: str, inside: bool) -> Column:
    """Whether a line ends inside a quoted field, if it starts there (``inside``) or with a new record.

    A fold over the pieces between quotes. A quote opens a field only where the field starts; in
    other places of an unquoted field it is a character. Inside, a quote ends the field; another one right after it
    is an escaped quote, and anything but the delimiter makes the field unquoted up to its delimiter.
    """
    unquoted, quoted, closed = 1, 2, 3

    def quote_after(state: Column, piece: Column) -> Column:
        empty = F.when(state == unquoted, unquoted).otherwise(quoted)
        return F.when(state == quoted, closed).when(piece == "", empty).when(F.endswith(piece, F.lit(",")), quoted).otherwise(unquoted)

    pieces = F.split(value, '"')
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(quoted if inside else 0), quote_after) == quoted


def _entry_states(df: DataFrame, by: list[str], order: str, entry: Column) -> DataFrame:
    """Adds ``inside``, the state before each row of ``by``, to rows that each turn a state into another one.

    ``from_outside`` and ``from_inside`` are a row's results. A row that gives both the same sets the state, one that gives the
    opposite turns it round. So the state before a row is that of the last row that set it, turned round as
    often as rows after it do; or else the state at ``entry``. Also adds what the rows up to and with this one make
    of both states, ``to_outside`` and ``to_inside``.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_outside") == F.col("from_inside")
    turns = F.sum(F.when(~sets & F.col("from_outside"), 1).otherwise(0))
    odd = lambda count: F.coalesce(count, F.lit(0)) % 2 == 1
    df = df.withColumn("_set", F.when(sets, F.col("from_outside") != odd(turns.over(upto))))
    last, all_last = F.last("_set", ignorenulls=True).over(earlier), F.last("_set", ignorenulls=True).over(upto)
    return df.withColumns({
        "inside": F.coalesce(last, entry) != odd(turns.over(earlier)),
        "to_outside": F.coalesce(all_last, F.lit(False)) != odd(turns.over(upto)),
        "to_inside": F.coalesce(all_last, F.lit(True)) != odd(turns.over(upto)),
    }).drop("_set")


def split_records(spark: SparkSession, paths: str | list[str], record_bytes: int = RECORD_BYTES, larger_than: int = -1) -> DataFrame:
    """``(record, is_broken, file ...)``: records as text, out of files that are read in splits; header records are left out.

    Files of up to ``larger_than`` bytes are left out.

    Whether a line break ends a record hangs on all the quotes before it. So each line, and by composition
    each split, becomes a function: where it ends if it starts inside a quoted field, and if not. The functions of the
    splits before it, one small row each, give the state that a split starts in.

    Only line numbers and these results are shuffled. Lines that are records of their own, nearly all, stay
    where they are; those of a record with line breaks are put together. A record whose quotes never close, or
    of more than ``record_bytes``, is not: it comes as its first line, and ``is_broken``.
    """
    lines = _with_file(
        spark.read.option("lineSep", "\n").text(paths).where(F.col("_metadata.file_size") > larger_than).withColumn("line", F.monotonically_increasing_id()).withColumns({
            "block": F.col("_metadata.file_block_start"), "split": F.concat_ws("#", "_metadata.file_path", "_metadata.file_block_start"),
            "from_outside": _ends_inside("value", False), "from_inside": _ends_inside("value", True),
        }),
        "value", "line", "block", "split", "from_outside", "from_inside",
    )
    # numbers of lines and splits hold for one reading of the files, so it is written down
    lines = stage(lines, "lines", SMALL_CODEC)
    place = F.struct("block", "line")
    narrow = lines.select(
        "file_path", "block", "split", "line", "from_outside", "from_inside", F.octet_length("value").alias("bytes"), (F.col("value") == "\r").alias("is_cr")
    )
    first = lines.groupBy("file_path").agg(F.min_by(F.endswith("value", F.lit("\r")), place).alias("has_cr"))
    splits = _entry_states(narrow, ["file_path", "block", "split"], "line", F.lit(False)).groupBy("file_path", "block", "split").agg(
        F.max_by("to_outside", "line").alias("from_outside"), F.max_by("to_inside", "line").alias("from_inside")
    )
    entries = _entry_states(splits, ["file_path"], "block", F.lit(False)).select("split", F.col("inside").alias("entry"))
    states = _entry_states(lookup_join(narrow, entries, "split", "inner"), ["split"], "line", F.col("entry"))
    is_start = ~F.col("inside") & (F.col("bytes") > 0)
    start = F.last(F.when(is_start, F.col("line")), ignorenulls=True).over(Window.partitionBy("split").orderBy("line"))
    ends_inside = F.when(F.col("inside"), F.col("from_inside")).otherwise(F.col("from_outside"))
    states = states.withColumns({"start": start, "is_start": is_start, "ends_inside": ends_inside})
    states = stage(states.select("file_path", "block", "split", "line", "bytes", "is_cr", "start", "is_start", "inside", "ends_inside"), "states")

    per_split = states.groupBy("file_path", "block", "split").agg(F.max("start").alias("last_start"), F.max_by("ends_inside", "line").alias("open"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_split.select("split", F.last("last_start", ignorenulls=True).over(before).alias("carried"))
    has_start = F.when(F.col("last_start").isNotNull(), F.col("block"))
    ends = per_split.groupBy("file_path").agg(F.max_by("open", "block").alias("never_closed"), F.max_by("last_start", has_start).alias("last_start"))
    filled = lookup_join(states.where("is_start"), first, "file_path", "inner").where("not (has_cr and is_cr)")
    files = first.join(ends, "file_path").join(filled.groupBy("file_path").agg(F.min_by("line", place).alias("head")), "file_path", "left")
    # only a line that starts or ends inside a field belongs to a longer record
    several = lookup_join(states.where("inside or ends_inside"), carried, "split", "inner").withColumn("start", F.coalesce("start", "carried"))
    large = several.groupBy("start").agg(F.sum(F.col("bytes") + 1).alias("record_bytes"))
    several = several.select("line", "start").join(large, "start")
    located = lookup_join(lookup_join(lines, files, "file_path", "inner"), several, "line", "left")
    # \z: a dollar sign would also stand before the last carriage return
    value = F.when(F.col("has_cr"), F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value"))
    located = located.withColumn("value", value).withColumn("start", F.coalesce("start", "line")).where(~F.col("start").eqNullSafe(F.col("head")))
    broken = (F.col("never_closed") & (F.col("start") == F.col("last_start"))) | (F.col("record_bytes") > record_bytes)
    located = located.withColumn("is_broken", F.coalesce(broken, F.lit(False))).where("not is_broken or start = line")
    single = located.where("record_bytes is null or is_broken").select(F.col("value").alias("record"), "is_broken", *_FILE)
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record")
    longer = located.where("record_bytes is not null and not is_broken").groupBy("start", "is_broken", *_FILE).agg(joined)
    return single.unionByName(longer.select("record", "is_broken", *_FILE)).where("record <> ''")


def read_many(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """All record files of a glob in one scan, every row stamped with its file and ``is_bad``.

    With ``multi_line`` each file of up to ``WHOLE_BYTES`` is read by one task, which suits many files of moderate
    size; larger ones, and without it all files, are read in splits, so that no task reads a large file. Both give
    the same good rows and as many bad ones, whatever
    quotes and line breaks fields hold, with line feeds or carriage returns before them, as the first
    line of a file has them. They differ where a quote never closes: in splits such a record is always bad, while
    the other form takes the rest of the file as a text, which is good if it is the last field. Files whose
    lines end in carriage returns alone need ``multi_line`` and no more than ``WHOLE_BYTES``.
    """
    if not multi_line:
        return _in_splits(spark, paths)
    size = F.col("_metadata.file_size")
    raw = spark.read.schema(file_schema(CASE_FILE_SCHEMA)).options(**csv_options()).csv(paths)
    # only the sizes are asked for, so no file is opened
    if spark.read.format("binaryFile").load(paths).where(size > WHOLE_BYTES).select(size).isEmpty():
        return clean_fields(raw, CASE_FILE_COLUMNS)
    return clean_fields(raw.where(size <= WHOLE_BYTES), CASE_FILE_COLUMNS).unionByName(_in_splits(spark, paths, WHOLE_BYTES))


def _in_splits(spark: SparkSession, paths: str | list[str], larger_than: int = -1) -> DataFrame:
    options = {k: v for k, v in csv_options().items() if k not in ("header", "multiLine", "encoding")}
    parsed = F.from_csv("record", F.lit(", ".join(f"{f.name} string" for f in file_schema(CASE_FILE_SCHEMA).fields)), options)
    rows = split_records(spark, paths, larger_than=larger_than).select(parsed.alias("r"), "is_broken", "record", *_FILE)
    bad = F.when(F.col("is_broken"), F.col("record")).otherwise(F.col(_CORRUPT))
    return _cleaned(rows.select("r.*", "is_broken", "record", *_FILE).withColumn(_CORRUPT, bad), CASE_FILE_COLUMNS)


def read_cases_csv(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """The 29 text columns of well-formed records."""
    return read_many(spark, paths, multi_line).where(~F.col("is_bad")).select(*CASE_FILE_COLUMNS)


def read_lookup_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The lookup file without carriage returns and repeated header lines; rows lack no key part.

    A row without case type or subtype has no valid key: :func:`lookup_rejects` lists those.
    """
    return _lookup(spark, paths).dropna(subset=["case_type", "subtype"])


def lookup_rejects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    rows = _lookup(spark, paths)
    return rows.where(F.col("case_type").isNull() | F.col("subtype").isNull())


def _lookup(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.schema(LOOKUP_FILE_SCHEMA).options(**_OPTIONS).csv(paths)
    text = raw.select(*[
        F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r$", "").alias(c) for c in LOOKUP_FILE_COLUMNS
    ])
    return text.where(F.col("case_count") != "case_count").select(
        null_if_in(F.col("case_count")).cast("int").alias("case_count"),
        *[null_if_in(F.col(c)).alias(c) for c in LOOKUP_FILE_COLUMNS[1:]],
    )


def write_cases_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Record files in the same form: header, every text quoted, NULL as an unquoted ``NA``."""
    writer = df.select(*CASE_FILE_COLUMNS, *([by] if by else [])).write.options(
        header="true", quote='"', escape='"', quoteAll="false", nullValue="NA", emptyValue="", encoding="UTF-8"
    )
    if by:
        writer = writer.partitionBy(by)
    writer.csv(path)
