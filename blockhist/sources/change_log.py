"""Reader for textual change logs: one record per line, ``KEYWORD field = value ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.cells import col, generated

# Fixed values of the log format: first words of the summary block at the end of a log.
SUMMARY_WORDS = ["SUMMARY:", "SUMMARY", "Total", "Estimated"]

#: Splits of a file, its last one aside, are at least this many bytes long.
LEAST_SPLIT = 1 << 20


# a word that is followed by '=' and another word; neighbouring triples may overlap. Matches
# start at word borders only and never give characters back.
_NAME = r"(?<!\S)(\S++)(?=\s++=\s++\S)"
_VALUE = r"(?<!\S)\S++(?=\s++=\s++(\S++))"


def with_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``fields``: all ``name = value`` triples of a line; a repeated name keeps its last
    value."""
    found = generated(lines, _names=F.regexp_extract_all(col(line), F.lit(_NAME), F.lit(1)),
                      _values=F.regexp_extract_all(col(line), F.lit(_VALUE), F.lit(1)))
    pairs = F.arrays_zip(F.col("_names").alias("key"), F.col("_values").alias("value"))
    last = F.filter(pairs, lambda p, i: i == F.size("_names") - F.array_position(F.reverse("_names"), p["key"]).cast("int"))
    fields = F.when(F.size(F.array_distinct("_names")) == F.size("_names"),
                    F.map_from_arrays("_names", "_values")).otherwise(F.map_from_entries(last))
    return found.withColumn("fields", fields).drop("_names", "_values")


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``keyword`` and ``fields`` of every record; blank, continuation and summary lines go.

    Works alike on batch and streaming DataFrames.
    """
    text = F.col(line)
    records = (lines.filter(text.rlike(r"\S") & ~text.rlike(r"^\s*\S+\s+=(\s|$)"))
                    .withColumn("keyword", F.regexp_extract(text, r"^\s*(\S+)", 1))
                    .filter(~F.col("keyword").isin(SUMMARY_WORDS)))
    return with_fields(records, line)


def with_line_numbers(raw: DataFrame) -> DataFrame:
    """Add ``seq``, which grows with the position of the line inside its file.

    ``raw`` must come straight from the text source. The number is built from the start of
    the file split and the row number of the task, so big files stay splittable. Two splits
    of less than 1 MiB could share a number (Spark's default minimum is 4 MiB): a file that is
    cut so finely fails the job as soon as ``seq`` is read.
    """
    start, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    split_no = F.call_function("div", start, F.lit(LEAST_SPLIT))
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # the last split of a file is as short as it comes out
    too_fine = (length < LEAST_SPLIT) & (start + length < F.col("_metadata.file_size"))
    text = F.concat(F.lit("split of "), length, F.lit(" bytes in "), F.col("_metadata.file_path"),
                    F.lit(f": the order of its lines needs {LEAST_SPLIT}, raise spark.sql.files.maxPartitionBytes"))
    return raw.select(F.col("value").alias("line"),
                      F.col("_metadata.file_path").alias("file"),
                      F.when(too_fine, F.raise_error(text).cast("long"))
                       .otherwise(F.shiftleft(split_no, 33) + in_task).alias("seq"))


def name_parts(df: DataFrame) -> DataFrame:
    """``dataset`` and ``ord`` from file names ``<dataset>@<ord>.log``."""
    base = F.element_at(F.split(F.url_decode("file"), "/"), -1)
    return (df.withColumn("dataset", F.regexp_extract(base, r"^(.*)@(\d+)\.log$", 1))
              .withColumn("ord", F.regexp_extract(base, r"^(.*)@(\d+)\.log$", 2).cast("int"))
              .drop("file"))


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(dataset, ord, seq, line, keyword, fields)`` of a folder of log files."""
    return parse_lines(name_parts(with_line_numbers(spark.read.text(path))))


def stream_change_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same records from files as they arrive."""
    raw = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
                .option("latestFirst", False).text(path))
    return parse_lines(name_parts(with_line_numbers(raw)))
