"""Text and CSV forms of sequences and search results.

Text is a sink/exchange format only: lines are parsed once into arrays with
column expressions (no Python per row) and written back with ``concat_ws``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.encode import tokens_to_csv
from ..operators.prepare import computed_once, validity
from ..spec import SequenceSpec

# Column order of a result file: sequence text, times, scores, flag, count, log.
RESULT_DDL = ("seq STRING, start_time STRING, finish_time STRING, init_pred DOUBLE, current_pred DOUBLE, "
              "working BOOLEAN, total_changes INT, change_log STRING")
CHANGE_LINE_FIELDS = ("change_num", "position", "prev_token", "new_token", "new_pred", "time_s")


# --- labelled lines -----------------------------------------------------------------

def format_labelled_lines(df: DataFrame, tokens: str = "tokens", label: str = "label", out: str = "line") -> DataFrame:
    """S3: ``"t0,t1,...,t(L-1),label"``."""
    return df.withColumn(out, F.concat_ws(",", tokens_to_csv(tokens), F.col(label).cast("string")))


def parse_labelled_lines(lines: DataFrame, line: str = "value", keep_label: bool = True) -> DataFrame:
    """A line's last field is the label, the others the tokens (lower-cased,
    comma-separated).  Blank or malformed fields parse to NULL; validate next."""
    parts = F.split(F.lower(F.trim(F.col(line))), ",")
    n = F.size(parts)
    toks = F.transform(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), lambda x: F.trim(x).try_cast("int"))
    out = lines.withColumn("tokens", toks).withColumn("label", F.trim(F.element_at(parts, -1)).try_cast("int"))
    return out if keep_label else out.drop("label")


def place_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file or folder of text files: ``(file, line_no, value)``, ``line_no`` from 1 in each file.

    A split of a file holds its lines in order, so a line's place in its split is its row number less the first one;
    the lines of the splits before it are added by prefix sums over one row per split.  Lines never move: the
    only shuffle is of the splits' counts."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value",
                                         F.monotonically_increasing_id().alias("_row"))
    before = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("file", "_at").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .select("file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (lines.join(splits, ["file", "_at"])
            .select("file", (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no"), "value"))


def checked_lines(lines: DataFrame, spec: SequenceSpec = SequenceSpec(), line: str = "value") -> DataFrame:
    """Parsed lines with ``reason``: null for a good line, else ``blank``, ``bad_label`` (neither 0 nor 1), ``bad_length`` or
    ``bad_token``."""
    parsed = parse_labelled_lines(lines, line)
    order = parsed.columns
    parsed = computed_once(parsed, tokens=F.col("tokens"), label=F.col("label")).select(*order)
    reason = (F.when(F.coalesce(F.trim(line), F.lit("")) == "", "blank")
              .when(F.col("label").isNull() | ~F.col("label").isin(0, 1), "bad_label").otherwise(validity("tokens", spec)))
    return parsed.withColumn("reason", reason)


def read_labelled_text(spark: SparkSession, path: str, spec: SequenceSpec = SequenceSpec()) -> tuple[DataFrame, DataFrame]:
    """S1 source: text files of labelled lines -> ``(good, rejected)``: ``(file, line_no, tokens, label)`` and
    ``(file, line_no, value, reason)``.  Every line of every file is in one of the two."""
    checked = checked_lines(place_lines(spark, path), spec)
    return (checked.where(F.col("reason").isNull()).select("file", "line_no", "tokens", "label"),
            checked.where(F.col("reason").isNotNull()).select("file", "line_no", "value", "reason"))


def write_lines(lines: DataFrame, path: str, line: str = "line") -> None:
    """Lines of text as files of a folder (overwrite)."""
    lines.select(line).write.mode("overwrite").text(path)


def write_labelled_text(df: DataFrame, path: str, tokens: str = "tokens", label: str = "label") -> None:
    """S3 sink: one labelled line per sequence."""
    write_lines(format_labelled_lines(df, tokens, label), path)


# --- change logs as text ----------------------------------------------------------------

def change_log_text(log, pred, times: bool = False) -> F.Column:
    """A log array as text, one line per change:
    ``change_num,position,prev_token,new_token,new_pred(8 dp),time_s(4 dp)``, each line
    ending in a newline.  ``pred`` maps an entry's ``new_z`` to its score; ``time_s``
    is written with ``times`` (the entries then have a field ``time_s``) and left empty otherwise."""
    def line(e):
        return F.concat(F.format_string("%d,%d,%d,%d,%.8f,", e["change_num"], e["position"], e["prev_token"],
                                        e["new_token"], pred(e["new_z"])),
                        F.format_string("%.4f", e["time_s"]) if times else F.lit(""), F.lit("\n"))
    return F.array_join(F.transform(F.col(log) if isinstance(log, str) else log, line), "")


def parse_change_log(df: DataFrame, keys: Sequence[str], text: str = "change_log") -> DataFrame:
    """Text log -> one typed row per change (blank lines dropped)."""
    # explode_outer: no inferred non-empty filter is pushed (with the text's whole
    # derivation) below the projection; blank and NULL lines are dropped above it.
    lines = (df.select(*keys, F.explode_outer(F.split(F.col(text), "\n")).alias("_l"))
             .where(F.col("_l").isNotNull() & (F.trim("_l") != "")))
    f = F.split("_l", ",")
    return lines.select(*keys,
                        F.get(f, 0).try_cast("int").alias("change_num"), F.get(f, 1).try_cast("int").alias("position"),
                        F.get(f, 2).try_cast("int").alias("prev_token"), F.get(f, 3).try_cast("int").alias("new_token"),
                        F.get(f, 4).try_cast("double").alias("new_pred"),
                        F.when(F.get(f, 5) != "", F.get(f, 5)).try_cast("double").alias("time_s"))


# --- result files -----------------------------------------------------------------------

# A field's line breaks are written as two characters, so a record is one line of the file and a large file is read by
# many tasks; the backslash itself is doubled.
def escape_lines(c: Column | str) -> Column:
    """``\\`` -> two of it, newline -> ``\\n``, carriage return -> ``\\r``."""
    text = F.replace(F.col(c) if isinstance(c, str) else c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def unescape_lines(c: Column | str) -> Column:
    """The text that :func:`escape_lines` was given: between doubled backslashes every other one starts a line break."""
    parts = F.split(F.col(c) if isinstance(c, str) else c, r"\\\\")
    back = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.array_join(F.transform(parts, back), "\\")


def _on_text(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def write_results(df: DataFrame, path: str, header: bool = False, fmt: str = "csv") -> None:
    """Write a result table (overwrite).  In CSV a record is one line: line breaks inside a field are escaped."""
    if fmt == "csv":
        (_on_text(df, escape_lines).write.mode("overwrite").option("header", header).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def read_results(spark: SparkSession, path: str, schema: str = RESULT_DDL, header: bool = False) -> DataFrame:
    """Read every result file of a folder (union); files are split like any text, and line breaks come back."""
    raw = (spark.read.schema(schema).option("header", header).option("escape", '"')
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return _on_text(raw, unescape_lines)


def append_changes(changes: DataFrame, path: str, round_col: str = "round") -> None:
    """Add one round's changes to the change table, partitioned by round.  A round that is written again takes the
    place of its first copy, so a retry doubles nothing."""
    (changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(round_col).parquet(path))
