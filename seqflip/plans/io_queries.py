"""Source/sink queries (S1-S16): labelled text lines, splits on disk, result
files with multi-line change logs, change-log text, persisted models.

Round trips write under the shared checkpoint folder and read back, so the
compared result is what a later job would see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import tokens_to_csv
from ..operators.model import LinearModel
from ..operators.prepare import assign_id, assign_line_id, filter_label, repartition_cache, sample_head
from ..operators.score import sigmoid
from ..operators.search import change_log, greedy_search, linear_search_loop, round_changes
from ..session import scratch_path
from ..sources.tables import load_linear_model, save_linear_model
from ..sources.text import (append_changes, change_log_text, format_labelled_lines, parse_change_log,
                            parse_labelled_lines, read_labelled_text, read_results, write_lines, write_results)
from ..spec import MICRO
from . import oracle as O
from .documents import document_model, documents, labelled, search_input
from .registry import KEYS, SPEC, _with, r6, register
from .search_queries import _state_select, _state_sql

LAB = _with(O.labelled_ctes(SPEC))
_LINES = f"SELECT doc_id, win, label, split, string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) AS tokens FROM lpos GROUP BY doc_id, win, label, split"


def _lines(spark, sf_dir):
    return format_labelled_lines(labelled(spark, sf_dir, SPEC)).select(*KEYS, F.col("line").alias("value"))


@register("format_labelled_lines", LAB + f"""
SELECT doc_id, win, tokens || ',' || CAST(label AS VARCHAR) AS line FROM ({_LINES})""")
def q_format_labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: every labelled window as ``"t0,...,t59,label"``."""
    return _lines(spark, sf_dir).withColumnRenamed("value", "line")


@register("parse_labelled_lines", LAB + f"""
SELECT doc_id, win, tokens FROM ({_LINES}) WHERE label = 0""")
def q_parse_labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 + S12: parse lines, keep label 0, drop the label."""
    parsed = parse_labelled_lines(_lines(spark, sf_dir))
    return filter_label(parsed, 0).select(*KEYS, tokens_to_csv("tokens").alias("tokens"))


@register("load_labelled_all", LAB + f"""
SELECT doc_id, win, tokens, label FROM ({_LINES})""")
def q_load_labelled_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse lines keeping both labels."""
    parsed = parse_labelled_lines(_lines(spark, sf_dir))
    return parsed.select(*KEYS, tokens_to_csv("tokens").alias("tokens"), "label")


@register("filter_label", LAB + f"""
SELECT doc_id, win, tokens FROM ({_LINES}) WHERE label = 0""")
def q_filter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 on the table form: the filter reaches the labels scan."""
    w = filter_label(labelled(spark, sf_dir, SPEC), 0)
    return w.select(*KEYS, tokens_to_csv("tokens").alias("tokens"))


@register("sample_head", LAB + f""",
l AS ({_LINES})
SELECT doc_id, win, tokens || ',' || CAST(label AS VARCHAR) AS line FROM l
QUALIFY row_number() OVER (ORDER BY doc_id, win) <= 100""")
def q_sample_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 labelled lines by key (top-k; the limit is the feature)."""
    return sample_head(_lines(spark, sf_dir).withColumnRenamed("value", "line"), 100, KEYS)


@register("write_read_splits", LAB + f"""
SELECT doc_id, win, label, split, tokens FROM ({_LINES})""")
def q_write_read_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persist all splits partitioned by ``split`` and read each one back
    (partition pruning: a split's read scans its folder only)."""
    path = scratch_path(spark, "splits")
    w = labelled(spark, sf_dir, SPEC).select(*KEYS, "label", "split", "tokens")
    w.write.mode("overwrite").partitionBy("split").parquet(path)
    parts = [spark.read.parquet(path).where(F.col("split") == s) for s in ("train", "val", "test")]
    back = reduce(DataFrame.unionByName, parts)
    return back.select(*KEYS, "label", "split", tokens_to_csv("tokens").alias("tokens"))


# --- result files and change logs -----------------------------------------------------------

_LOG_SQL = _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f""",
logtext AS (
  SELECT doc_id, win,
         string_agg(printf('%d,%d,%d,%d,%.8f,', k - 1, pos, prev_token, new_token,
                           1.0 / (1.0 + exp(-(CAST(new_z AS DOUBLE) / {MICRO})))) || chr(10), '' ORDER BY k) AS change_log
  FROM kept GROUP BY doc_id, win),
t_out AS ({O.token_csv('sw', KEYS)})"""


def _result_table(spark, sf_dir) -> DataFrame:
    """The search state in result-file form (keys first, then the reference's columns)."""
    model = document_model(spark, sf_dir, SPEC)
    st = greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC, with_times=True)
    return st.select(*KEYS, tokens_to_csv("current_tokens").alias("seq"),
                     F.col("start_ts").cast("string").alias("start_time"),
                     F.col("finish_ts").cast("string").alias("finish_time"),
                     "init_pred", "current_pred", "working", "total_changes",
                     change_log_text("log", lambda z: sigmoid(z, model)).alias("change_log"))


RESULT_KEYED_DDL = ("doc_id BIGINT, win INT, seq STRING, start_time STRING, finish_time STRING, init_pred DOUBLE, "
                    "current_pred DOUBLE, working BOOLEAN, total_changes INT, change_log STRING")

_RESULT_SQL = _LOG_SQL + f""",
cur AS (
  SELECT sw.doc_id, sw.win, sw.pos, coalesce(kept.new_token, sw.token) AS token
  FROM sw LEFT JOIN kept ON sw.doc_id = kept.doc_id AND sw.win = kept.win AND sw.pos = kept.pos),
seqs AS ({O.token_csv('cur', KEYS)})
SELECT fin.doc_id, fin.win, seqs.csv AS seq, {O.pred('fin.init_z')} AS init_pred, {O.pred('fin.zf')} AS current_pred,
       fin.status = 'working' AS working, fin.n AS total_changes, coalesce(logtext.change_log, '') AS change_log
FROM fin JOIN seqs USING (doc_id, win) LEFT JOIN logtext USING (doc_id, win)"""


def _result_compare(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, "seq", r6("init_pred").alias("init_pred"), r6("current_pred").alias("current_pred"),
                     "working", "total_changes", F.coalesce("change_log", F.lit("")).alias("change_log"))


@register("merge_result_files", _RESULT_SQL)
def q_merge_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S9: write results as header-less CSV (one line a record, line breaks of logs escaped), read the
    whole folder back."""
    path = scratch_path(spark, "results")
    write_results(_result_table(spark, sf_dir), path, header=False)
    return _result_compare(read_results(spark, path, RESULT_KEYED_DDL, header=False))


@register("write_results_header", _RESULT_SQL)
def q_write_results_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same result with a header line in every file (no collect to the driver)."""
    path = scratch_path(spark, "results-h")
    write_results(_result_table(spark, sf_dir), path, header=True)
    return _result_compare(read_results(spark, path, RESULT_KEYED_DDL, header=True))


@register("parse_change_log", _LOG_SQL + """
SELECT doc_id, win, CAST(k - 1 AS INTEGER) AS change_num, pos AS position, prev_token, new_token,
       CAST(printf('%.8f', 1.0 / (1.0 + exp(-(CAST(new_z AS DOUBLE) / 1000000)))) AS DOUBLE) AS new_pred
FROM kept""")
def q_parse_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text change log parsed back into one typed row per change."""
    text = _result_table(spark, sf_dir).select(*KEYS, "change_log")
    return parse_change_log(text, KEYS).drop("time_s")


@register("append_change_log", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f"""
SELECT doc_id, win, CAST(k - 1 AS INTEGER) AS change_num, pos AS position, prev_token, new_token, new_z,
       {O.pred('new_z')} AS new_pred
FROM kept""")
def q_append_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop path appends each round's changes to a change table
    partitioned by round; the table read back is the whole change log."""
    model = document_model(spark, sf_dir, SPEC)
    path = scratch_path(spark, "changes")

    def on_round(r, state, seconds):
        append_changes(round_changes(state, KEYS, r, lambda z: sigmoid(z, model)), path)

    linear_search_loop(search_input(spark, sf_dir, SPEC), model, SPEC, on_round=on_round)
    back = spark.read.parquet(path)
    return back.select(*KEYS, "change_num", "position", "prev_token", "new_token", "new_z",
                       r6("new_pred").alias("new_pred"))


@register("load_model_search", _state_sql(None))
def q_load_model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 + S11: persist the fitted model as a table, load it back by path and search."""
    path = scratch_path(spark, "model")
    save_linear_model(document_model(spark, sf_dir, SPEC), spark, path)
    model: LinearModel = load_linear_model(spark, path)
    return _state_select(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC))


@register("assign_id", LAB + f""",
l AS ({_LINES})
SELECT md5(concat(length(doc_id::VARCHAR), ':', doc_id, length(win::VARCHAR), ':', win)) AS seq_id, tokens || ',' || CAST(label AS VARCHAR) AS value FROM l""")
def q_assign_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable id for every line, from its natural key."""
    return assign_id(_lines(spark, sf_dir), KEYS).select("seq_id", "value")


@register("assign_line_id", """
SELECT md5(md5(concat(length(value), ':', value)) || '#' || CAST(row_number() OVER (PARTITION BY value) - 1 AS VARCHAR)) AS seq_id, value
FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)""")
def q_assign_line_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 for lines that have no key: every line of every text, equal lines (the empty one above all) numbered."""
    lines = documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("value"))
    return assign_line_id(lines).select("seq_id", "value")


#: Lines planted next to those of the windows: blank, without a proper label, a token too many, and a token out of range.
_PLANTED = f"""
l AS ({_LINES}),
good AS (SELECT doc_id, win, tokens || ',' || CAST(label AS VARCHAR) AS value FROM l),
planted AS (
  SELECT CASE (doc_id + win) % 5 WHEN 0 THEN '' WHEN 1 THEN value || ',x' WHEN 2 THEN '19,' || value
                                 ELSE '77' || substr(value, strpos(value, ',')) END AS value,
         CASE (doc_id + win) % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'bad_label' WHEN 2 THEN 'bad_length' ELSE 'bad_token' END AS reason
  FROM good WHERE (doc_id + win) % 5 <> 4)"""


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The labelled windows as text files, with the planted lines."""
    lines = _lines(spark, sf_dir)
    v, k = F.col("value"), F.pmod(F.col("doc_id") + F.col("win"), F.lit(5))
    planted = (F.when(k == 0, "").when(k == 1, F.concat(v, F.lit(",x"))).when(k == 2, F.concat(F.lit("19,"), v))
               .when(k == 3, F.concat(F.lit("77"), F.substr(v, F.instr(v, ",")))))
    both = lines.select(F.explode(F.filter(F.array(v, planted), lambda x: x.isNotNull())).alias("line"))
    path = scratch_path(spark, "text")
    write_lines(both, path)
    return path


@register("read_labelled_text", LAB + "," + _PLANTED + """
SELECT regexp_replace(value, ',[01]$', '') AS tokens, CAST(right(value, 1) AS INTEGER) AS label FROM good""")
def q_read_labelled_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + S1: windows written as text files and read back; the good lines."""
    good, _ = read_labelled_text(spark, _text_files(spark, sf_dir), SPEC)
    return good.select(tokens_to_csv("tokens").alias("tokens"), "label")


@register("read_rejected_lines", LAB + "," + _PLANTED + """
SELECT value, reason FROM planted""")
def q_read_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are no sequences, as they stand in the files, with the reason."""
    _, rejected = read_labelled_text(spark, _text_files(spark, sf_dir), SPEC)
    return rejected.select("value", "reason")


@register("labelled_text_places", LAB + "," + _PLANTED + """
SELECT (SELECT count(*) FROM good) AS good_lines, (SELECT count(*) FROM planted) AS rejected_lines, true AS gapless""")
def q_labelled_text_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and rejected lines together have every place of every file once."""
    good, rejected = read_labelled_text(spark, _text_files(spark, sf_dir), SPEC)
    places = good.select("file", "line_no", F.lit(1).alias("good")).unionByName(rejected.select("file", "line_no", F.lit(0).alias("good")))
    per_file = places.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.min("line_no").alias("lo"),
                                          F.max("line_no").alias("hi"), F.countDistinct("line_no").alias("places"))
    gapless = (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("places") == F.col("n"))
    return per_file.agg(F.sum("good").alias("good_lines"), F.sum(F.col("n") - F.col("good")).alias("rejected_lines"), F.bool_and(gapless).alias("gapless"))


@register("repartition_cache", _state_sql(None))
def q_repartition_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread the search input by key and keep it in memory before searching."""
    model = document_model(spark, sf_dir, SPEC)
    si = repartition_cache(search_input(spark, sf_dir, SPEC), *KEYS)
    return _state_select(greedy_search(si, model, SPEC))


@register("change_log_table", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f"""
SELECT doc_id, win, CAST(k - 1 AS INTEGER) AS change_num, pos AS position, prev_token, new_token, new_z,
       {O.pred('new_z')} AS new_pred
FROM kept""")
def q_change_log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 for the window path: the change log written as a parquet table and read back."""
    model = document_model(spark, sf_dir, SPEC)
    path = scratch_path(spark, "changes-w")
    change_log(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC), KEYS, model) \
        .write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("new_pred", r6("new_pred"))
