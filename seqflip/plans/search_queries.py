"""Search queries (P6-P12) over every window of every label-0 document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.encode import tokens_to_csv
from ..operators.search import change_log, greedy_search, working_count
from . import oracle as O
from .documents import document_model, search_input
from .registry import KEYS, SPEC, _with, r6, register


# --------------------------------------------------------------------------
# The search
# --------------------------------------------------------------------------

def _state_select(st: DataFrame) -> DataFrame:
    return st.select(*KEYS, tokens_to_csv("tokens").alias("tokens"),
                     tokens_to_csv("current_tokens").alias("current_tokens"),
                     "init_z", r6("init_pred").alias("init_pred"), "current_z",
                     r6("current_pred").alias("current_pred"), "total_changes", "status", "working")


def _state_sql(rounds: int | None) -> str:
    return _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC, rounds),
                 f"""
cur AS (
  SELECT sw.doc_id, sw.win, sw.pos, coalesce(kept.new_token, sw.token) AS token
  FROM sw LEFT JOIN kept ON sw.doc_id = kept.doc_id AND sw.win = kept.win AND sw.pos = kept.pos),
t_in AS ({O.token_csv('sw', KEYS)}),
t_out AS ({O.token_csv('cur', KEYS)})""") + f"""
SELECT fin.doc_id, fin.win, t_in.csv AS tokens, t_out.csv AS current_tokens,
       fin.init_z, {O.pred('fin.init_z')} AS init_pred, fin.zf AS current_z, {O.pred('fin.zf')} AS current_pred,
       fin.n AS total_changes, fin.status, fin.status = 'working' AS working
FROM fin JOIN t_in USING (doc_id, win) JOIN t_out USING (doc_id, win)"""


@register("search_until_done", _state_sql(None))
def q_search_until_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 (flagship): greedy search until every label-0 window is done."""
    model = document_model(spark, sf_dir, SPEC)
    return _state_select(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC))


@register("search_fixed_rounds", _state_sql(5))
def q_search_fixed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly five rounds; unfinished rows stay ``working``."""
    model = document_model(spark, sf_dir, SPEC)
    return _state_select(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC, rounds=5))


@register("search_one_round", _state_sql(1))
def q_search_one_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round (apply the best substitution, re-score, stop rule)."""
    model = document_model(spark, sf_dir, SPEC)
    return _state_select(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC, rounds=1))


@register("change_log", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f"""
SELECT doc_id, win, CAST(k - 1 AS INTEGER) AS change_num, pos AS position, prev_token, new_token, new_z,
       {O.pred('new_z')} AS new_pred
FROM kept""")
def q_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per change of the until-done search."""
    model = document_model(spark, sf_dir, SPEC)
    st = greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC)
    return change_log(st, KEYS, model).withColumn("new_pred", r6("new_pred"))


@register("working_count", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC), """
fr AS (SELECT CASE WHEN status = 'stuck' THEN n + 1 ELSE n END AS f FROM fin),
rounds AS (SELECT CAST(unnest(range(0, (SELECT max(f) FROM fr) + 1)) AS INTEGER) AS round)""") + """
SELECT rounds.round, CAST(count(fr.f) AS BIGINT) AS working
FROM rounds LEFT JOIN fr ON fr.f > rounds.round GROUP BY rounds.round""")
def q_working_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows still working after each round of the until-done search."""
    model = document_model(spark, sf_dir, SPEC)
    return working_count(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC))




@register("working_count_fixed", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC, 3), """
fr AS (SELECT CASE WHEN status = 'working' THEN NULL WHEN status = 'stuck' THEN n + 1 ELSE n END AS f FROM fin),
rounds AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS round)""") + """
SELECT rounds.round, CAST(count(*) FILTER (WHERE fr.f IS NULL OR fr.f > rounds.round) AS BIGINT) AS working
FROM rounds, fr GROUP BY rounds.round""")
def q_working_count_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 for a search of three rounds: rows that are not done count as working to the end."""
    model = document_model(spark, sf_dir, SPEC)
    return working_count(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC, rounds=3), rounds=3)
