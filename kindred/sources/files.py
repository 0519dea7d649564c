"""Readers for delimited files, word lists, labelled lines and vector files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.functions.codec import decode_vector

LABEL_PREFIX = "__label__"


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, line_ends_in_values: bool = False
) -> DataFrame:
    """Comma-separated file with a header line; quotes inside a quoted value are doubled.

    A file whose quoted values hold line ends can't be split and is read by one task; it has to be
    asked for by ``line_ends_in_values``.
    """
    return spark.read.schema(schema).csv(
        path, header=True, multiLine=line_ends_in_values, quote='"', escape='"'
    )


def read_word_list(spark: SparkSession, path: str, column: str = "stopword") -> DataFrame:
    """One word per line, no header, no quoting."""
    return spark.read.schema(f"{column} string").csv(path, sep="\t", quote="")


def split_labelled(lines: DataFrame) -> DataFrame:
    """``label, text, labels`` of lines like ``__label__X text``; blank lines are skipped.

    ``labels`` are all that stand before the text and ``label`` the first of them; a line without
    one has the label '' and keeps its text.
    """
    line = F.trim("value")
    leading = F.regexp_extract(line, f"^((?:{LABEL_PREFIX}\\S+\\s*)*)", 1)
    labels = F.regexp_extract_all(leading, F.lit(f"{LABEL_PREFIX}(\\S+)"), F.lit(1))
    return lines.where(line != "").select(
        F.coalesce(F.get(labels, F.lit(0)), F.lit("")).alias("label"),
        F.substr(line, F.char_length(leading) + 1).alias("text"),
        labels.alias("labels"),
    )


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    return split_labelled(spark.read.text(path))


def write_labelled_lines(df: DataFrame, label: Column, text: Column, path: str) -> None:
    """One line per row; a row without label becomes a blank line. The text must be one line."""
    line = F.when(label.isNotNull(), F.concat(F.lit(LABEL_PREFIX), label.cast("string"), F.lit(" "), text))
    df.select(F.coalesce(line, F.lit("")).alias("value")).write.text(path)


def read_vector_files(
    spark: SparkSession, path: str, key_pattern: str, key: str = "item"
) -> DataFrame:
    """One file per item with one number per line; the key is cut from the file's path.

    Files that hold anything but numbers are returned with a NULL vector.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias(key),
        decode_vector(F.rtrim(F.regexp_replace("value", r"\s+", " ")), " ").alias("vec"),
    )


def write_vector_files(df: DataFrame, item: str, vec: str, path: str) -> None:
    """The layout :func:`read_vector_files` reads: a folder per item, one number per line."""
    numbers = F.array_join(F.transform(vec, lambda x: x.cast("string")), "\n")
    files = df.select(F.col(item).alias("item"), numbers.alias("value")).repartition("item")
    files.write.partitionBy("item").text(path)
