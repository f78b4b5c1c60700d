"""CSV and parquet scans and sinks, row ids, and display names."""

from collections.abc import Iterable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.schema import (
    CLUSTER,
    CUSTOMER_ID,
    DISPLAY_NAMES,
    DISPLAY_PREFIXES,
    GENERATED_ID,
    SEGMENT,
    flag_label,
)
from basketlens.session import work_path


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    null_text: str | None = None,
) -> DataFrame:
    """Scan a CSV with a header.  With a schema there is no inference pass.

    ``null_text="NA"`` reads that text as null, the convention of statistics tools.
    """
    reader = spark.read.option("header", True)
    if null_text is not None:
        reader = reader.option("nullValue", null_text)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def stringify_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps, structs and ML vectors as JSON text, since CSV holds only scalars.

    A vector stays in its sparse form, so a wide one-hot row costs one slot, not its width.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    exprs = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, VectorUDT):
            wrapped = F.to_json(F.struct(c.alias("v")))  # {"v":<vector>}
            exprs[field.name] = F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)
        elif isinstance(field.dataType, nested):
            exprs[field.name] = F.to_json(c)
    return df.withColumns(exprs) if exprs else df


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", null_text: str | None = None, compression: str | None = None
) -> str:
    """Write with one task per partition; ``fmt`` is parquet or csv.

    ``compression`` is a codec of the format.  Encoded rows are long texts that say little, so their CSV is
    best written with one; a compressed file is read by one task.
    """
    if fmt == "csv":
        writer = stringify_nested(df).write.mode("overwrite").option("header", True)
        if null_text is not None:
            writer = writer.option("nullValue", null_text)
        writer.csv(path, compression=compression)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path, compression=compression)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared work folder and read back.

    For a frame that several jobs need: they scan the columns they use instead of
    repeating its joins, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write_table(df, work_path(spark, name)))


def to_display_names(df: DataFrame) -> DataFrame:
    """Internal names to the header texts of the retail files.

    Where two columns would read the same (a category called "SMALL" beside the
    size flag), the flag of the category keeps its internal name.
    """
    names = {c: DISPLAY_NAMES.get(c, c) for c in df.columns}
    taken = {shown.lower() for shown in names.values()}
    for c in df.columns:
        for prefix, shown in DISPLAY_PREFIXES.items():
            rest = c.removeprefix(prefix)
            wanted = shown + (flag_label(c, prefix) if "%" in rest else rest)
            if c.startswith(prefix) and wanted.lower() not in taken:
                names[c] = wanted
                taken.add(wanted.lower())
    return df.withColumnsRenamed(names)


def from_display_names(df: DataFrame) -> DataFrame:
    """Header texts of the retail files to internal names."""
    return df.withColumnsRenamed({v: k for k, v in DISPLAY_NAMES.items() if v in df.columns})


def clean_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Dots in column names become spaces; also returns the mapping original -> clean."""
    mapping = {c: c.replace(".", " ") for c in df.columns}
    return df.toDF(*mapping.values()), mapping


# part-<task>-<job id>-c<file of the task>: ordered by number, past five digits too.
FILE_BLOCK = 1000
# The last "-c" counts: the job id is hexadecimal and may hold "-c" and digits too.
_FILE_NAME = r"^part-(\d+)-.*-c(\d+)"


def written_positions(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A written parquet folder with each row's 0-based place in file order.

    Place = rows in the files before + row number in the file.  Both come from the
    files themselves, so a lost executor or another split of the scan changes nothing.
    The rows before each file are summed in two levels: within blocks of ``FILE_BLOCK`` tasks' files, and over the
    blocks, of which the driver holds one number each.  A file whose name does not tell its place is an error.
    """
    table = spark.read.parquet(path)
    columns = table.columns
    table = table.select(
        *[f"`{c}`" for c in columns],
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    unknown = F.raise_error(F.concat(F.lit("no place in the name of the file "), F.col("_file")))
    place = [F.regexp_extract("_file", _FILE_NAME, i).cast("long") for i in (1, 2)]
    known = F.when(F.col("_file").rlike(_FILE_NAME), F.struct(*place)).otherwise(unknown)
    counts = table.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", known)
    block = F.floor(F.col("_place.col1") / FILE_BLOCK).alias("_block")
    files = materialised(counts.select("_file", "_n", "_place", block), "file-sizes")
    start, starts = 0, []
    for row in files.groupBy("_block").agg(F.sum("_n").alias("n")).orderBy("_block").collect():
        starts.append((row["_block"], start))
        start += row["n"]
    blocks = spark.createDataFrame(starts, "_block long, _first long")
    before = Window.partitionBy("_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_first") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    offsets = files.join(blocks, "_block").select("_file", ahead.alias("_start"))
    return table.join(offsets, "_file").select(
        *[f"`{c}`" for c in columns], (F.col("_start") + F.col("_row")).alias(name)
    )


def with_row_id(df: DataFrame, name: str = GENERATED_ID) -> DataFrame:
    """Consecutive ids 1..n without a global window: write once, then number the files."""
    spark = df.sparkSession
    path = write_table(df, work_path(spark, "rows"))
    return written_positions(spark, path, name).withColumn(name, F.col(name) + 1)


def feature_set(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Id, then segment and cluster if present, then the columns of one feature group."""
    key = CUSTOMER_ID if CUSTOMER_ID in df.columns else GENERATED_ID
    if key not in df.columns:
        df = with_row_id(df)
    extra = [c for c in (SEGMENT, CLUSTER) if c in df.columns]
    return df.select(key, *extra, *[f"`{c}`" for c in columns if c in df.columns])


def save_feature_sets(
    df: DataFrame, groups: dict[str, list[str]], folder: str, fmt: str = "parquet"
) -> dict[str, str]:
    """One table per feature group and one with everything; returns the paths."""
    if CUSTOMER_ID not in df.columns and GENERATED_ID not in df.columns:
        df = with_row_id(df)  # numbered once, so all sets agree on the id
    tables = {name: feature_set(df, columns) for name, columns in groups.items() if columns}
    paths = {
        name: write_table(to_display_names(table), f"{folder}/{name}_features", fmt)
        for name, table in tables.items()
    }
    paths["all"] = write_table(to_display_names(df), f"{folder}/all_features", fmt)
    return paths
