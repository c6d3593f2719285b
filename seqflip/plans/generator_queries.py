"""Segment-profile queries over document windows (G1, G2, G4-G6, P14): the two-class segment model of the generator, fitted
to the train split instead of drawn from a parameter table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edits import score_edits
from ..operators.generate import fit_posterior, segment_frequencies
from ..operators.model import LinearModel
from ..operators.score import score_sequences
from ..operators.search import change_log, greedy_search
from ..sources.documents import document_windows
from ..sources.tables import spread
from ..spec import MICRO
from . import oracle as O
from .documents import document_model, documents, labelled, search_input
from .registry import KEYS, SPEC, _with, r6, register

K, S, E = SPEC.alphabet, SPEC.start, SPEC.start + SPEC.active

SEGMENT_CTES = f"""
seg0 AS (SELECT token, sum(n0) AS s FROM tr WHERE pos >= {S} AND pos < {E} GROUP BY token),
seg0t AS (SELECT sum(s) AS total FROM seg0),
lr AS (
  SELECT g.pos, g.token,
         CASE WHEN g.pos >= {S} AND g.pos < {E}
              THEN CAST(round({MICRO} * (ln((coalesce(tr.n1, 0) + 1) / (tot.t1 + {K}))
                                       - ln((coalesce(seg0.s, 0) + 1) / (seg0t.total + {K})))) AS BIGINT) ELSE 0 END AS v
  FROM grid g LEFT JOIN tr ON g.pos = tr.pos AND g.token = tr.token LEFT JOIN seg0 ON g.token = seg0.token, tot, seg0t)"""


def _logit(name: str, source: str) -> str:
    return f"""
{name} AS (SELECT s.doc_id, s.win, CAST((SELECT b FROM bias) + sum(lr.v) AS BIGINT) AS z
  FROM {source} s JOIN lr ON lr.pos = s.pos AND lr.token = s.token GROUP BY s.doc_id, s.win)"""


def segment_model(spark: SparkSession, sf_dir: str) -> LinearModel:
    return fit_posterior(labelled(spark, sf_dir, SPEC).where(F.col("split") == "train"), SPEC)


@register("segment_frequencies", _with(O.labelled_ctes(SPEC)) + f""",
seg AS (
  SELECT label, token,
         CASE WHEN pos < {S} OR pos >= {E} THEN 'background' WHEN label = 1 THEN 'state1' ELSE 'state0' END AS segment,
         CAST(CASE WHEN pos >= {S} AND pos < {E} AND label = 1 THEN pos - {S} ELSE 0 END AS INTEGER) AS seg_offset
  FROM lpos WHERE split = 'train'),
cnt AS (SELECT label, segment, seg_offset, token, count(*) AS n FROM seg GROUP BY ALL)
SELECT label, segment, seg_offset, token, n,
       round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY label, segment, seg_offset) AS DOUBLE), 9) AS share
FROM cnt""")
def q_segment_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 + G2: the profile of the train split - token shares per class and segment."""
    f = segment_frequencies(labelled(spark, sf_dir, SPEC).where(F.col("split") == "train"), SPEC)
    return f.select("label", "segment", F.col("offset").alias("seg_offset"), "token", "n", F.round("share", 9).alias("share"))


@register("generator_posterior", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.all_windows_ctes(SPEC)) + "," + SEGMENT_CTES + ","
          + _logit("post", "apos") + f"""
SELECT doc_id, win, z, {O.pred('z')} AS posterior, CASE WHEN z > 0 THEN 1 ELSE 0 END AS gen_pred FROM post""")
def q_generator_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-1 posterior of every window under the fitted segment profile, and the inferred label."""
    windows = document_windows(spread(documents(spark, sf_dir)), SPEC)
    p = score_sequences(windows, segment_model(spark, sf_dir))
    return p.select(*KEYS, "z", r6("pred").alias("posterior"), (F.col("z") > 0).cast("int").alias("gen_pred"))


@register("generator_error_rate", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC)) + "," + SEGMENT_CTES + "," + _logit("post", "lpos") + """,
lw AS (SELECT DISTINCT doc_id, win, label, split FROM lpos)
SELECT split, count(*) AS n, CAST(sum(CASE WHEN (post.z > 0)::INTEGER <> label THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       round(avg(CASE WHEN (post.z > 0)::INTEGER <> label THEN 1.0 ELSE 0.0 END), 9) AS error_rate
FROM lw JOIN post USING (doc_id, win) GROUP BY split""")
def q_generator_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labelled windows whose inferred label is wrong, per split."""
    scored = score_sequences(labelled(spark, sf_dir, SPEC), segment_model(spark, sf_dir))
    wrong = (F.col("z") > 0).cast("int") != F.col("label")
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(wrong.cast("bigint")).alias("errors"),
                                       F.round(F.avg(wrong.cast("double")), 9).alias("error_rate"))


@register("score_edits", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + "," + SEGMENT_CTES + """,
cur AS (
  SELECT sw.doc_id, sw.win, sw.pos, coalesce(kept.new_token, sw.token) AS token
  FROM sw LEFT JOIN kept ON sw.doc_id = kept.doc_id AND sw.win = kept.win AND sw.pos = kept.pos),
z1 AS (
  SELECT doc_id, win, CAST((SELECT b FROM bias) + sum(wt.w) AS BIGINT) AS z
  FROM cur JOIN wt ON cur.pos = wt.pos AND cur.token = wt.token GROUP BY doc_id, win),""" + _logit("pb", "sw") + "," + _logit("pa", "cur") + f"""
SELECT z0.doc_id, z0.win, {O.pred('z0.init_z')} AS model_before, {O.pred('z1.z')} AS model_after,
       {O.pred('pb.z')} AS gen_before, {O.pred('pa.z')} AS gen_after
FROM z0 JOIN z1 USING (doc_id, win) JOIN pb USING (doc_id, win) JOIN pa USING (doc_id, win)""")
def q_score_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's edits scored under the model and under the segment profile, before and after."""
    model = document_model(spark, sf_dir, SPEC)
    si = search_input(spark, sf_dir, SPEC)
    edits = change_log(greedy_search(si, model, SPEC), KEYS, model).select(
        *KEYS, F.col("position").alias("pos"), F.col("new_token").alias("token"), "change_num")
    s = score_edits(si, edits, KEYS, model, SPEC, segment_model(spark, sf_dir), order="change_num")
    return s.select(*KEYS, *[r6(c).alias(c) for c in ("model_before", "model_after", "gen_before", "gen_after")])
