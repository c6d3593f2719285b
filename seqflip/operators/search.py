"""Greedy counterfactual search.

One round changes the single token whose gradient gain is largest (strictly
positive; ties to the lowest position, then the lowest token) and re-scores;
a sequence stops once its score reaches the threshold (inclusive) or after
``cap`` changes.  A sequence with no positive gain left is ``stuck``.  A
satisfied sequence still gets one change unless ``skip_satisfied``.

Window path (linear models).  With ``z = bias + sum_i w[i, x_i]`` the target-0
gradient is ``sigmoid(z) * w``; the positive factor cancels in the arg-max, a
change at ``i`` leaves every other position's gain unchanged and drops its own
to zero.  So the k-th change is the k-th largest per-position gain and the
whole iterative search is one in-row expression: sort the positive gains,
accumulate until the threshold, keep the prefix.  Map-only - no shuffle, no
loop, no per-round job.

Loop path.  Literal rounds over a state table, one map-only step per round,
with the lineage cut by a reliable checkpoint every round.  It serves
non-linear models and is the reference point the window path is tested
against.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import remove_path, scratch_path
from ..spec import SequenceSpec
from .model import LinearModel
from .score import linear_logit, sigmoid



def log_type(model_sql_type: str) -> str:
    return (f"array<struct<change_num:int,position:int,prev_token:int,new_token:int,"
            f"new_z:{model_sql_type}>>")


def _rising(tokens, model: LinearModel) -> Column:
    """Positive-gain substitutions by position: ``struct(ng, pos, prev, new)`` with ``ng = -gain``."""
    K = model.alphabet
    W, WB, TB = model.weight_array(), model.best_weight_array(), model.best_token_array()
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    cand = F.transform(tok, lambda t, i: F.struct(
        (F.get(W, i * K + t) - F.get(WB, i)).alias("ng"), i.alias("pos"), t.alias("prev"),
        F.get(TB, i).alias("new")))
    return F.filter(cand, lambda c: c["ng"] < 0)


def candidates(tokens, model: LinearModel) -> Column:
    """Positive-gain substitutions, best first: the natural ascending sort of ``struct(ng, pos, prev, new)`` is gain desc,
    pos asc."""
    return F.sort_array(_rising(tokens, model))


def best_substitution(df: DataFrame, model: LinearModel, tokens: str = "tokens") -> DataFrame:
    """P5: the first change the search would make: ``position, prev_token, new_token, gain``
    (all NULL when no token change raises the score)."""
    first = F.get(candidates(tokens, model), 0)
    return df.select("*", first["pos"].alias("position"), first["prev"].alias("prev_token"),
                     first["new"].alias("new_token"), (-first["ng"]).alias("gain"))


def _changed_tokens(tokens: Column, model: LinearModel, n: Column, last_ng: Column, last_pos: Column) -> Column:
    """The tokens after ``n`` changes: a position was changed exactly if its candidate sorts at or before the last one
    taken, so one pass over the sequence replays the whole log."""
    K = model.alphabet
    W, WB, TB = model.weight_array(), model.best_weight_array(), model.best_token_array()

    def new(t, i):
        ng = F.get(W, i * K + t) - F.get(WB, i)
        return F.when((ng < last_ng) | ((ng == last_ng) & (i <= last_pos)), F.get(TB, i)).otherwise(t)

    return F.when(n > 0, F.transform(tokens, new)).otherwise(tokens)


def greedy_search(df: DataFrame, model: LinearModel, spec: SequenceSpec = SequenceSpec(),
                  tokens: str = "tokens", rounds: int | None = None, skip_satisfied: bool = False,
                  with_times: bool = False) -> DataFrame:
    """P9/P10 window path: the search state after ``rounds`` rounds (``None`` = until done).

    Adds ``init_z, init_pred, current_tokens, current_z, current_pred, working,
    status, total_changes, finish_round, log``; every input column is kept."""
    if rounds is not None and rounds < 1:
        raise ValueError("rounds must be >= 1")
    T, cap = model.threshold(spec), spec.cap
    limit = cap if rounds is None else min(cap, rounds)
    typ = model.sql_type

    staged = (df.withColumn("init_z", linear_logit(tokens, model))
                .withColumn("_cand", candidates(tokens, model)))
    init_done = (F.col("init_z") >= T) if skip_satisfied else F.lit(False)
    init = F.struct(F.col("init_z").alias("z"), F.lit(0).alias("n"), init_done.alias("done"),
                    F.lit(0).cast(typ).alias("last_ng"), F.lit(-1).alias("last_pos"),
                    F.expr(f"cast(array() as {log_type(typ)})").alias("log"))

    def merge(acc, c):
        nz = acc["z"] - c["ng"]
        entry = F.struct(acc["n"].alias("change_num"), c["pos"].alias("position"), c["prev"].alias("prev_token"),
                         c["new"].alias("new_token"), nz.alias("new_z"))
        step = F.struct(nz.alias("z"), (acc["n"] + 1).alias("n"), ((nz >= T) | (acc["n"] + 1 >= limit)).alias("done"),
                        c["ng"].alias("last_ng"), c["pos"].alias("last_pos"),
                        F.array_append(acc["log"], entry).alias("log"))
        return F.when(acc["done"], acc).otherwise(step)

    st = staged.withColumn("_r", F.aggregate("_cand", init, merge)).drop("_cand")
    n, zf = F.col("_r.n"), F.col("_r.z")
    reached = (n > 0) & (zf >= T)
    if skip_satisfied:
        reached = reached | ((n == 0) & (F.col("init_z") >= T))
    capped = ~reached & (n >= cap)
    exhausted = ~reached & ~capped & (n < limit)
    stuck = exhausted if rounds is None else exhausted & (n + 1 <= rounds)
    status = (F.when(reached, "reached").when(capped, "capped").when(stuck, "stuck").otherwise("working"))
    out = (st.withColumn("init_pred", sigmoid(F.col("init_z"), model))
             .withColumn("current_tokens", _changed_tokens(F.col(tokens), model, n, F.col("_r.last_ng"), F.col("_r.last_pos")))
             .withColumn("current_z", zf)
             .withColumn("current_pred", sigmoid(zf, model))
             .withColumn("status", status)
             .withColumn("working", F.col("status") == "working")
             .withColumn("total_changes", n)
             .withColumn("finish_round", F.when(reached | capped, n).when(stuck, n + 1).cast("int"))
             .withColumn("log", F.col("_r.log"))
             .drop("_r"))
    if with_times:
        out = (out.withColumn("start_ts", F.current_timestamp())
                  .withColumn("finish_ts", F.when(~F.col("working"), F.current_timestamp())))
    return out


def change_log(state: DataFrame, keys: Sequence[str], model: LinearModel) -> DataFrame:
    """One row per change ``(keys..., change_num, position, prev_token, new_token, new_z, new_pred)``;
    ``change_num`` counts from 0."""
    # explode_outer + a filter above the generator: a plain explode makes the optimiser
    # infer size(log) > 0 and push it - with the whole search expression - below the
    # projection, evaluating the search twice.
    return (state.select(*keys, F.explode_outer("log").alias("_e")).where(F.col("_e").isNotNull())
            .select(*keys, "_e.change_num", "_e.position", "_e.prev_token", "_e.new_token", "_e.new_z",
                    sigmoid(F.col("_e.new_z"), model).alias("new_pred")))


def working_count(state: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows still working after each round ``r = 0 .. rounds`` (the rounds that were run; without
    ``rounds`` the search ran until done, so that is the last finishing round).

    Aggregates to at most ``cap + 2`` groups first (map-side partial counts),
    so the per-round expansion runs on a table whose size is bounded."""
    per_round = (state.groupBy(F.coalesce("finish_round", F.lit(-1)).alias("f"))
                 .agg(F.count(F.lit(1)).alias("c")))
    # Unfinished rows (f = -1) count as working in every reported round.
    last = F.max(F.when(F.col("f") >= 0, F.col("f"))).over(Window.partitionBy())
    expanded = (per_round.withColumn("_last", F.coalesce(last, F.lit(0)) if rounds is None else F.lit(rounds))
                .select(F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("round"), "f", "c"))
    return (expanded.groupBy("round")
            .agg(F.sum(F.when((F.col("f") < 0) | (F.col("f") > F.col("round")), F.col("c")).otherwise(0))
                 .cast("bigint").alias("working")))


# --------------------------------------------------------------------------
# Loop path
# --------------------------------------------------------------------------

_STATE_COLS = ("current_tokens", "current_z", "current_pred", "working", "status", "total_changes",
               "finish_round", "log", "changed")


def apply_choice(state: DataFrame, choice: Column, threshold, cap: int, round_no: int,
                 pred: Callable[[Column], Column]) -> DataFrame:
    """Apply one chosen substitution per working row and test the stop rule.

    ``choice`` is ``struct(pos, prev, new, nz)`` (``nz`` = logit after the change) or
    NULL when no substitution raises the score (the row becomes ``stuck``).
    Finished rows pass through unchanged; ``changed`` marks rows changed this round."""
    st = state.withColumn("_b", F.when(F.col("working"), choice))
    b = F.col("_b")
    w = F.col("working")
    has = w & b.isNotNull()
    nz = b["nz"]
    n1 = F.col("total_changes") + 1
    new_status = F.when(~has, "stuck").when(nz >= threshold, "reached").when(n1 >= cap, "capped").otherwise("working")
    entry = F.struct(F.col("total_changes").alias("change_num"), b["pos"].alias("position"),
                     b["prev"].alias("prev_token"), b["new"].alias("new_token"), nz.alias("new_z"))
    toks = F.transform(F.col("current_tokens"), lambda t, i: F.when(i == b["pos"], b["new"]).otherwise(t))
    keep = [c for c in state.columns if c not in _STATE_COLS]
    return st.select(
        *keep,
        F.when(has, toks).otherwise(F.col("current_tokens")).alias("current_tokens"),
        F.when(has, nz).otherwise(F.col("current_z")).alias("current_z"),
        F.when(has, pred(nz)).otherwise(F.col("current_pred")).alias("current_pred"),
        F.when(w, new_status == "working").otherwise(F.col("working")).alias("working"),
        F.when(w, new_status).otherwise(F.col("status")).alias("status"),
        F.when(has, n1).otherwise(F.col("total_changes")).alias("total_changes"),
        F.when(w & (new_status != "working"), F.lit(round_no)).otherwise(F.col("finish_round"))
        .cast("int").alias("finish_round"),
        F.when(has, F.array_append(F.col("log"), entry)).otherwise(F.col("log")).alias("log"),
        has.alias("changed"))


def linear_choice(model: LinearModel, tokens: str = "current_tokens") -> Column:
    """The best substitution of a linear model (the first of the candidates if they were sorted)."""
    best = F.array_min(_rising(tokens, model))
    return F.when(best.isNotNull(), F.struct(best["pos"].alias("pos"), best["prev"].alias("prev"),
                                             best["new"].alias("new"), (F.col("current_z") - best["ng"]).alias("nz")))


def linear_round(state: DataFrame, model: LinearModel, spec: SequenceSpec, round_no: int) -> DataFrame:
    """One literal round for a linear model."""
    return apply_choice(state, linear_choice(model), model.threshold(spec), spec.cap, round_no,
                        lambda z: sigmoid(z, model))


def search_loop(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int | None = None,
                checkpoint: bool = True,
                on_round: Callable[[int, DataFrame, float], None] | None = None, chunk: int = 1) -> DataFrame:
    """P9/P10 driver: run ``step`` round after round until no row works (or ``rounds`` rounds).

    Round ``r`` processes only the rows still working and is written once as a table in the shared folder named by
    ``spark.checkpoint.dir``; rows that finish in it stay there and are never carried into later rounds.  So the cost of a
    round is proportional to its working rows, the plan never grows, and a lost executor re-reads files instead of
    replaying rounds.  The only driver traffic per round is one existence probe.  The finished rows of all rounds are then
    written together and the rounds are deleted.  ``on_round(r, rows_of_round_r, seconds)`` sees each round (e.g. to
    append its changes to a log table).  ``checkpoint=False`` keeps everything in one growing plan (small inputs only).

    ``chunk > 1`` chains that many rounds before each checkpoint.  The chained
    rounds are map-only projections, so they run in one stage and the fixed cost
    of a job, a write and a probe is paid once per chunk; rows that finish
    inside a chunk pass the remaining rounds unchanged.  It needs a ``step`` that
    keeps finished rows as they are and reads its input once (no union of
    branches), and it is ignored when ``on_round`` must see every round."""
    if on_round is not None or chunk < 1:
        chunk = 1
    if not checkpoint:
        return _search_loop_in_memory(state, step, rounds, on_round)
    spark, columns = state.sparkSession, state.columns
    paths: list[str] = []

    def written(rows: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "search-round"))
        rows.write.parquet(paths[-1])
        return spark.read.schema(rows.schema).parquet(paths[-1])

    out = written(state)
    r = 0
    # Without ``rounds`` the search ends by itself: every row changes once a round until it is reached, stuck or capped.
    while (rounds is None or r < rounds) and out.where("working").limit(1).count() > 0:
        t0 = time.time()
        step_out = out.where("working")
        for _ in range(chunk if rounds is None else min(chunk, rounds - r)):
            r += 1
            step_out = step(step_out, r)
        out = written(step_out)
        if on_round is not None:
            on_round(r, out, time.time() - t0)
    # One scan packs the small files of the late rounds together, so the result has the partitions its rows need.
    done = spark.read.schema(out.schema).parquet(*paths).where(~F.col("working"))
    result_path = scratch_path(spark, "search-result")
    result = done.unionByName(out.where("working")).select(*columns)
    result.write.parquet(result_path)
    for p in paths:
        remove_path(spark, p)
    return spark.read.schema(result.schema).parquet(result_path)


def _search_loop_in_memory(state, step, rounds, on_round):
    r = 0
    while (rounds is None or r < rounds) and state.where("working").limit(1).count() > 0:
        r += 1
        t0 = time.time()
        state = step(state, r)
        if on_round is not None:
            on_round(r, state, time.time() - t0)
    return state


def initial_state(df: DataFrame, z: Column, pred: Callable[[Column], Column], log_sql_type: str,
                  tokens: str = "tokens") -> DataFrame:
    """P3 for the loop path: state columns from a logit expression."""
    return (df.withColumn("init_z", z)
              .withColumn("init_pred", pred(F.col("init_z")))
              .withColumn("current_tokens", F.col(tokens))
              .withColumn("current_z", F.col("init_z"))
              .withColumn("current_pred", F.col("init_pred"))
              .withColumn("working", F.lit(True))
              .withColumn("status", F.lit("working"))
              .withColumn("total_changes", F.lit(0))
              .withColumn("finish_round", F.lit(None).cast("int"))
              .withColumn("log", F.expr(f"cast(array() as {log_type(log_sql_type)})"))
              .withColumn("changed", F.lit(False)))


def linear_search_loop(df: DataFrame, model: LinearModel, spec: SequenceSpec = SequenceSpec(),
                       tokens: str = "tokens", rounds: int | None = None, checkpoint: bool = True,
                       on_round=None, chunk: int = 4) -> DataFrame:
    """P9/P10 loop path for a linear model (same result as :func:`greedy_search`);
    ``chunk`` rounds run as one stage between checkpoints (see :func:`search_loop`)."""
    state = initial_state(df, linear_logit(tokens, model), lambda z: sigmoid(z, model), model.sql_type, tokens)
    return search_loop(state, lambda s, r: linear_round(s, model, spec, r), rounds=rounds,
                       checkpoint=checkpoint, on_round=on_round, chunk=chunk)


def round_changes(state: DataFrame, keys: Sequence[str], round_no: int,
                  pred: Callable[[Column], Column]) -> DataFrame:
    """The changes made in one round (S8 input): the last log entry of every changed row."""
    e = F.element_at("log", -1)
    return (state.where("changed")
            .select(*keys, e["change_num"].alias("change_num"), e["position"].alias("position"),
                    e["prev_token"].alias("prev_token"), e["new_token"].alias("new_token"),
                    e["new_z"].alias("new_z"), pred(e["new_z"]).alias("new_pred"),
                    F.lit(round_no).alias("round")))
