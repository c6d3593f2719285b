"""Document-table queries: windows, encodings, split, training, scoring,
gradient, best substitution, edits and metrics (C1-C6, T1-T6, P1-P5, P13, M1-M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import (csv_to_tokens, default_vocab, one_hot_dense, one_hot_long, one_hot_to_tokens,
                                symbols_to_tokens, tokens_to_csv, tokens_to_symbols)
from ..functions.hashing import split_name
from ..operators.edits import apply_edits, out_of_range_edits
from ..operators.metrics import max_changes, mean_changes, search_metrics
from ..operators.prepare import validate_sequences
from ..operators.score import init_search_state, input_gradient, score_selected, score_sequences
from ..operators.search import best_substitution, change_log, greedy_search
from ..operators.train import accuracy_by_split, count_weight_table, split_counts
from ..sources.documents import document_text_windows, document_windows, short_documents
from ..sources.tables import spread
from ..spec import MICRO
from . import oracle as O
from .documents import document_model, documents, labelled, search_input, table
from .registry import KEYS, SPEC, _with, r6, register

L, K = SPEC.length, SPEC.alphabet
VOCAB = default_vocab(K)
VOCAB_SQL = "[" + ", ".join(f"'{s}'" for s in VOCAB) + "]"
LAB = _with(O.labelled_ctes(SPEC))
LABW = _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC))


def _all_windows(spark, sf_dir):
    return document_windows(spread(documents(spark, sf_dir)), SPEC)


# --- sources ------------------------------------------------------------------------

@register("document_windows", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, tokens FROM ({O.token_csv('apos', KEYS).replace('AS csv', 'AS tokens')})""")
def q_document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as windows of L tokens."""
    return _all_windows(spark, sf_dir).select(*KEYS, tokens_to_csv("tokens").alias("tokens"))


@register("short_documents", f"""
SELECT doc_id, CAST(coalesce(len(string_split(text, '')), 0) AS BIGINT) AS n_chars,
       CASE WHEN text IS NULL THEN 'null_text' ELSE 'too_short' END AS reason
FROM documents WHERE text IS NULL OR len(string_split(text, '')) < {L}""")
def q_short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15 for the text source: texts that cannot form one window."""
    return short_documents(table(spark, sf_dir, "documents"), SPEC).withColumn("n_chars", F.col("n_chars").cast("bigint"))


@register("document_accounting", _with(O.labelled_ctes(SPEC)) + f"""
SELECT l.quality AS label, CAST(count(*) AS BIGINT) AS documents,
       CAST(count(*) FILTER (WHERE len(string_split(d.text, '')) >= {L}) AS BIGINT) AS windowed,
       CAST(count(*) FILTER (WHERE d.text IS NULL OR len(string_split(d.text, '')) < {L}) AS BIGINT) AS quarantined,
       CAST(coalesce(sum(ceil(len(string_split(d.text, '')) / {L}.0)) FILTER (WHERE len(string_split(d.text, '')) >= {L}), 0) AS BIGINT) AS windows
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY l.quality""")
def q_document_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is either windowed or quarantined, per label (null: not labelled)."""
    docs = documents(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    win = document_windows(spread(docs), SPEC).groupBy("doc_id").agg(F.count("*").alias("windows"))
    short = short_documents(docs, SPEC).select("doc_id", F.lit(1).alias("short"))
    rows = docs.select("doc_id").join(win, "doc_id", "left").join(short, "doc_id", "left").join(lab, "doc_id", "left")
    return rows.groupBy("label").agg(
        F.count("*").alias("documents"), F.count("windows").alias("windowed"), F.count("short").alias("quarantined"),
        F.coalesce(F.sum("windows"), F.lit(0)).cast("bigint").alias("windows"))


# --- encodings ------------------------------------------------------------------------

@register("tokens_to_csv", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, tokens FROM ({O.token_csv('apos', KEYS).replace('AS csv', 'AS tokens')})""")
def q_tokens_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: token arrays as comma-joined text."""
    return _all_windows(spark, sf_dir).select(*KEYS, tokens_to_csv("tokens").alias("tokens"))


@register("csv_to_tokens", _with(O.all_windows_ctes(SPEC)) + """
SELECT doc_id, win, CAST(sum(token) AS BIGINT) AS token_sum, CAST(sum(token * (pos + 1)) AS BIGINT) AS checksum,
       CAST(count(*) AS INTEGER) AS n
FROM apos GROUP BY doc_id, win""")
def q_csv_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse the text form back to integers (checked by position-weighted sums)."""
    t = csv_to_tokens(tokens_to_csv("tokens"))
    w = _all_windows(spark, sf_dir).select(*KEYS, t.alias("parsed"))
    return w.select(*KEYS,
                    F.aggregate("parsed", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("token_sum"),
                    F.aggregate(F.transform("parsed", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"),
                                lambda a, x: a + x).alias("checksum"),
                    F.size("parsed").alias("n"))


@register("tokens_to_symbols", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, string_agg({VOCAB_SQL}[token + 1], '' ORDER BY pos) AS symbols FROM apos GROUP BY doc_id, win""")
def q_tokens_to_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens -> symbol strings through the vocabulary."""
    return _all_windows(spark, sf_dir).select(*KEYS, tokens_to_symbols("tokens", VOCAB).alias("symbols"))


@register("symbols_to_tokens", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, tokens FROM ({O.token_csv('apos', KEYS).replace('AS csv', 'AS tokens')})""")
def q_symbols_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol strings -> tokens (round trip of C1, so equal to the windows)."""
    sym = _all_windows(spark, sf_dir).select(*KEYS, tokens_to_symbols("tokens", VOCAB).alias("symbols"))
    return sym.select(*KEYS, tokens_to_csv(symbols_to_tokens("symbols", VOCAB)).alias("tokens"))


@register("one_hot_long", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, pos, token, CAST(pos * {K} + token AS INTEGER) AS feature, 1.0 AS value
FROM apos""")
def q_one_hot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse one-hot (one row per position) of every window."""
    return one_hot_long(_all_windows(spark, sf_dir), KEYS, K)


@register("one_hot_to_tokens", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, tokens, CAST({L} AS INTEGER) AS ones
FROM ({O.token_csv('apos', KEYS).replace('AS csv', 'AS tokens')})""")
def q_one_hot_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 (and dense C5): one-hot matrix -> arg-max token per position; round trip."""
    v = one_hot_dense("tokens", K)
    rows = _all_windows(spark, sf_dir).select(*KEYS, v.alias("onehot"))
    return rows.select(*KEYS, tokens_to_csv(one_hot_to_tokens("onehot", K)).alias("tokens"),
                     F.size(F.array_remove("onehot", 0.0)).alias("ones"))


@register("validate_sequences", _with(O.all_windows_ctes(SPEC)) + f"""
SELECT doc_id, win, 'bad_token' AS reason, CAST(count(*) FILTER (WHERE NOT list_contains({VOCAB_SQL}, ch)) AS INTEGER) AS unknown
FROM apos GROUP BY doc_id, win HAVING count(*) FILTER (WHERE NOT list_contains({VOCAB_SQL}, ch)) > 0""")
def q_validate_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read each window's raw text through the vocabulary; windows with unknown
    symbols go to quarantine (with the count of unknown symbols)."""
    win = document_text_windows(spread(documents(spark, sf_dir)), SPEC)
    toks = win.select(*KEYS, symbols_to_tokens("chunk", VOCAB).alias("tokens"))
    _, bad = validate_sequences(toks, SPEC)
    return bad.select(*KEYS, "reason", F.size(F.filter("tokens", lambda t: t < 0)).alias("unknown"))


# --- split / train / evaluate --------------------------------------------------------------

@register("split_dataset", f"""
SELECT doc_id, CAST(quality AS INTEGER) AS label, {O.split_case('doc_id', SPEC.seed)} AS split FROM labels""")
def q_split_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/10/10 split of the labelled documents by a seeded hash of the id."""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").cast("int").alias("label"), split_name(SPEC.seed, F.col("doc_id")).alias("split"))


@register("split_counts", LAB + """
SELECT split, label, CAST(count(*) AS BIGINT) AS n FROM lpos WHERE pos = 0 GROUP BY split, label""")
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows per split and label."""
    return split_counts(labelled(spark, sf_dir, SPEC))


@register("train_count_weights", LABW + """
SELECT wt.pos, wt.token, wt.w, CAST(wt.n1 AS BIGINT) AS n1, CAST(wt.n0 AS BIGINT) AS n0, bias.b AS bias
FROM wt, bias""")
def q_train_count_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the count-weight model table (micro-logits) from the train split."""
    lw = labelled(spark, sf_dir, SPEC).where(F.col("split") == "train")
    return count_weight_table(lw, SPEC).select("pos", "token", "w", "n1", "n0", "bias")


@register("accuracy_by_split", LABW + """,
zw AS (
  SELECT doc_id, win, split, label, (SELECT b FROM bias) + sum(wt.w) AS z
  FROM lpos JOIN wt ON lpos.pos = wt.pos AND lpos.token = wt.token GROUP BY doc_id, win, split, label)
SELECT split, CAST(count(*) AS BIGINT) AS n,
       round(avg(CASE WHEN (CASE WHEN z > 0 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM zw GROUP BY split""")
def q_accuracy_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the count-weight model on train, val and test windows."""
    model = document_model(spark, sf_dir, SPEC)
    return accuracy_by_split(labelled(spark, sf_dir, SPEC), model).withColumn("accuracy", F.round("accuracy", 9))


# --- scoring --------------------------------------------------------------------------------

@register("score_sequences", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.all_windows_ctes(SPEC)) + f""",
zw AS (
  SELECT doc_id, win, CAST((SELECT b FROM bias) + sum(wt.w) AS BIGINT) AS z
  FROM apos JOIN wt ON apos.pos = wt.pos AND apos.token = wt.token GROUP BY doc_id, win)
SELECT doc_id, win, z, {O.pred('z')} AS pred FROM zw""")
def q_score_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every window of every document (labelled or not)."""
    model = document_model(spark, sf_dir, SPEC)
    return score_sequences(_all_windows(spark, sf_dir), model).select(*KEYS, "z", r6("pred").alias("pred"))


@register("score_selected", LABW + f""",
zw AS (
  SELECT doc_id, win, label, CAST((SELECT b FROM bias) + sum(wt.w) AS BIGINT) AS z
  FROM lpos JOIN wt ON lpos.pos = wt.pos AND lpos.token = wt.token
  WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
  GROUP BY doc_id, win, label)
SELECT doc_id, win, label, z, {O.pred('z')} AS pred FROM zw""")
def q_score_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the windows of the documents named in a key table (those labelled toxic)."""
    model = document_model(spark, sf_dir, SPEC)
    keys = table(spark, sf_dir, "labels").where(F.col("toxic") == 1)
    return score_selected(labelled(spark, sf_dir, SPEC), keys, ("doc_id",), model).select(*KEYS, "label", "z", r6("pred").alias("pred"))


@register("init_search_state", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f""",
t_in AS ({O.token_csv('sw', KEYS)})
SELECT z0.doc_id, z0.win, t_in.csv AS tokens, z0.init_z, {O.pred('z0.init_z')} AS init_pred,
       z0.init_z AS current_z, {O.pred('z0.init_z')} AS current_pred, true AS working, 'working' AS status,
       CAST(0 AS INTEGER) AS total_changes
FROM z0 JOIN t_in USING (doc_id, win)""")
def q_init_search_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search state before the first round."""
    model = document_model(spark, sf_dir, SPEC)
    st = init_search_state(search_input(spark, sf_dir, SPEC), model)
    return st.select(*KEYS, tokens_to_csv("tokens").alias("tokens"), "init_z", r6("init_pred").alias("init_pred"),
                     "current_z", r6("current_pred").alias("current_pred"), "working", "status", "total_changes")


@register("input_gradient", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f""",
sg AS (SELECT doc_id, win, 1.0 / (1.0 + exp(-(CAST(init_z AS DOUBLE) / {MICRO}))) AS s FROM z0)
SELECT sw.doc_id, sw.win, sw.pos, wt.token, sw.token AS current_token, round(sg.s * wt.w / {MICRO}, 9) + 0.0 AS grad
FROM sw JOIN sg ON sw.doc_id = sg.doc_id AND sw.win = sg.win JOIN wt ON sw.pos = wt.pos""")
def q_input_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole L x K input gradient of every searched window."""
    model = document_model(spark, sf_dir, SPEC)
    g = input_gradient(search_input(spark, sf_dir, SPEC), KEYS, model)
    # "+ 0.0" folds a rounded -0.0 into 0.0 on both engines.
    return g.withColumn("grad", F.round("grad", 9) + 0.0)


@register("best_substitution", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + """
SELECT doc_id, win, pos AS position, prev_token, new_token, gain FROM ranked WHERE k = 1""")
def q_best_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: the best single substitution of every label-0 window that has one."""
    model = document_model(spark, sf_dir, SPEC)
    b = best_substitution(search_input(spark, sf_dir, SPEC), model)
    return b.where(F.col("position").isNotNull()).select(*KEYS, "position", "prev_token", "new_token", "gain")


def _edits(si: DataFrame, model) -> DataFrame:
    """The search's changes as edits, with a repeated and an out-of-range edit for each."""
    log = change_log(greedy_search(si, model, SPEC), KEYS, model)
    edit = lambda pos, token, no: F.struct(pos.cast("int").alias("pos"), token.cast("int").alias("token"), no.alias("edit_no"))
    pos, new, no = F.col("position"), F.col("new_token"), F.col("change_num")
    return log.select(*KEYS, F.explode(F.array(
        edit(pos, (new + 7) % K, 2 * no), edit(pos, new, 2 * no + 1), edit(pos + L, new, 2 * no + 1))).alias("e")).select(*KEYS, "e.*")


@register("out_of_range_edits", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f"""
SELECT doc_id, win, CAST(pos + {L} AS INTEGER) AS pos, new_token AS token, CAST(2 * (k - 1) + 1 AS INTEGER) AS edit_no,
       'bad_position' AS reason FROM kept""")
def q_out_of_range_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits that cannot change a sequence, reported."""
    model = document_model(spark, sf_dir, SPEC)
    return out_of_range_edits(_edits(search_input(spark, sf_dir, SPEC), model), SPEC.length)


@register("apply_edits", _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC)) + f""",
cur AS (
  SELECT sw.doc_id, sw.win, sw.pos, coalesce(kept.new_token, sw.token) AS token
  FROM sw LEFT JOIN kept ON sw.doc_id = kept.doc_id AND sw.win = kept.win AND sw.pos = kept.pos)
SELECT doc_id, win, tokens FROM ({O.token_csv('cur', KEYS).replace('AS csv', 'AS tokens')})""")
def q_apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply an edits table to the input sequences: the search's own change log, each change preceded by another
    edit of its position (the later one wins) and followed by one outside the sequence."""
    model = document_model(spark, sf_dir, SPEC)
    si = search_input(spark, sf_dir, SPEC)
    edits = _edits(si, model)
    return apply_edits(si, edits, KEYS, length=SPEC.length, order="edit_no").select(*KEYS, tokens_to_csv("edited_tokens").alias("tokens"))


# --- metrics ----------------------------------------------------------------------------------

_FIN = _with(O.labelled_ctes(SPEC), O.weight_ctes(SPEC), O.search_ctes(SPEC))


@register("search_metrics", _FIN + """
SELECT CAST(count(*) AS BIGINT) AS sequences, round(avg(n), 9) AS mean_changes, max(n) AS max_changes,
       CAST(sum(n) AS BIGINT) AS changes,
       count(*) FILTER (WHERE status = 'reached') AS reached, count(*) FILTER (WHERE status = 'capped') AS capped,
       count(*) FILTER (WHERE status = 'stuck') AS stuck, count(*) FILTER (WHERE status = 'working') AS working
FROM fin""")
def q_search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 + M2 with status counts for the until-done search."""
    model = document_model(spark, sf_dir, SPEC)
    m = search_metrics(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC))
    return m.withColumn("mean_changes", F.round("mean_changes", 9))


@register("mean_changes", _FIN + "\nSELECT round(avg(n), 9) AS mean_changes FROM fin")
def q_mean_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: mean changes per trajectory."""
    model = document_model(spark, sf_dir, SPEC)
    return mean_changes(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC)).select(
        F.round("mean_changes", 9).alias("mean_changes"))


@register("max_changes", _FIN + "\nSELECT max(n) AS max_changes FROM fin")
def q_max_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: largest number of changes of one trajectory."""
    model = document_model(spark, sf_dir, SPEC)
    return max_changes(greedy_search(search_input(spark, sf_dir, SPEC), model, SPEC))
