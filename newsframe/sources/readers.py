"""Readers. Schemas are declared, never inferred."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsframe.operators.rows import preview
from newsframe.schema import ARTICLE, STATEMENT


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType = ARTICLE, multi_line: bool = True,
             bad_rows: str | None = None) -> DataFrame:
    """CSV with a header and quoted cells; quotes inside cells are doubled.

    Columns are matched by the header's names, whatever their order; unnamed and unknown columns are dropped, and
    missing ones are null. Each path may have a header of its own; the files under one path share one.

    Rows with too many or too few cells stop the read, as does a cell that is not of its column's type. With
    ``bad_rows`` they are kept, and that column holds their raw text (null for a good row).

    ``multi_line`` allows line breaks in cells, and then a file is one task. Switch it off for files without such cells;
    write large tables with ``write_csv``, which bounds the rows of a file, and read raw files once (``ingest_csv``).
    """
    frames = [_read_by_name(spark, path, schema, multi_line, bad_rows) for path in ([paths] if isinstance(paths, str) else paths)]
    return combine(*frames)


def _read_by_name(spark, path: str, schema: T.StructType, multi_line: bool, bad_rows: str | None) -> DataFrame:
    reader = (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
              .option("encoding", "UTF-8"))
    names = reader.csv(path).columns
    cells = T.StructType([T.StructField(f"_cell{at}", T.StringType()) for at in range(len(names))] + [T.StructField("_raw", T.StringType())])
    rows = (reader.schema(cells).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").csv(path))
    place = {name: F.col(f"_cell{at}") for at, name in reversed(list(enumerate(names))) if not name.startswith("_c")}
    columns, wrong = [], F.col("_raw").isNotNull()
    for field in schema.fields:
        cell = place.get(field.name, F.lit(None).cast("string"))
        value = cell if field.dataType == T.StringType() else cell.try_cast(field.dataType)
        wrong = wrong | (cell.isNotNull() & value.isNull())
        columns.append(value.alias(field.name))
    # Every cell is read, also by a query of few columns, as the parser finds bad rows by their cells.
    text = F.coalesce("_raw", F.to_csv(F.struct(*[f"_cell{at}" for at in range(len(names))])))
    if bad_rows:
        return rows.select(*columns, F.when(wrong, text).alias(bad_rows))
    stop = F.raise_error(F.concat(F.lit("bad CSV row: "), F.substring(text, 1, 200)))
    return rows.filter(F.when(wrong, stop.cast("boolean")).otherwise(F.lit(True))).select(*columns)


def ingest_csv(spark: SparkSession, paths: str | list[str], target: str, schema: T.StructType = ARTICLE,
               bad_rows: str | None = None, multi_line: bool = True) -> DataFrame:
    """Reads raw CSV once into Parquet, which later steps read in parallel, by column and with pushed filters."""
    read_csv(spark, paths, schema, multi_line, bad_rows).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_tsv(spark: SparkSession, paths: str | list[str], schema: T.StructType = STATEMENT, multi_line: bool = False) -> DataFrame:
    """Headerless TSV under the caller's column names. ``multi_line`` as in ``read_csv``."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", False).option("multiLine", multi_line)
            .option("quote", '"').option("escape", '"').csv(paths))


def read_columns(spark: SparkSession, path: str, columns: list[str], rows: int | None = None,
                 order: str | None = None) -> DataFrame:
    """Parquet with only the named columns, optionally the first rows in key order."""
    df = spark.read.parquet(path)
    if rows is not None:
        df = preview(df.select(*columns, *([order] if order and order not in columns else [])), rows, order)
    return df.select(*columns)


def combine(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns are matched by name and missing ones are filled with nulls."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def parse_word_vectors(lines: DataFrame, line: str = "value") -> DataFrame:
    """(word, vec) from lines with a word and its numbers."""
    parts = F.split(F.col(line), " +")
    return lines.select(parts.alias("_parts")).select(
        F.col("_parts")[0].alias("word"),
        F.slice("_parts", F.lit(2), F.size("_parts") - 1).cast("array<float>").alias("vec"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_vectors(spark.read.text(path))
