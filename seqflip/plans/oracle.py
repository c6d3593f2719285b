"""Independent SQL formulations (DuckDB dialect) of the registered queries.

The Spark plans work in-row on token arrays; these work in long form with
joins and window functions, so agreement is a real cross-check.  They run
against the driver's pre-registered views (``documents``, ``labels``,
``orders`` ...).
"""

from __future__ import annotations

from ..spec import MICRO, SequenceSpec


def split_case(key: str, seed: int) -> str:
    b = f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key})), 1, 8))::BIGINT % 10)"
    return f"CASE WHEN {b} < 8 THEN 'train' WHEN {b} = 8 THEN 'val' ELSE 'test' END"


def labelled_ctes(spec: SequenceSpec) -> str:
    """lab(doc_id, label, split), lchars(doc_id, label, split, n, c, token), lpos(doc_id, label, split, win, pos, token).

    Characters are numbered once per text; window membership is arithmetic:
    full windows ``c // L`` and, when ``n % L <> 0``, the end-aligned last one."""
    L, K = spec.length, spec.alphabet
    return f"""
lab AS (
  SELECT doc_id, CAST(quality AS INTEGER) AS label, {split_case('doc_id', spec.seed)} AS split FROM labels),
ltxt AS (
  SELECT d.doc_id, lab.label, lab.split, string_split(d.text, '') AS chars
  FROM documents d JOIN lab ON d.doc_id = lab.doc_id
  WHERE len(string_split(d.text, '')) >= {L}),
lchars AS (
  SELECT doc_id, label, split, len(chars) AS n,
         unnest(range(0, len(chars))) AS c, ascii(unnest(chars)) % {K} AS token
  FROM ltxt),
lpos AS (
  SELECT doc_id, label, split, CAST(c // {L} AS INTEGER) AS win, CAST(c % {L} AS INTEGER) AS pos,
         CAST(token AS INTEGER) AS token
  FROM lchars WHERE c < (n // {L}) * {L}
  UNION ALL
  SELECT doc_id, label, split, CAST(n // {L} AS INTEGER) AS win, CAST(c - (n - {L}) AS INTEGER) AS pos,
         CAST(token AS INTEGER) AS token
  FROM lchars WHERE n % {L} <> 0 AND c >= n - {L})"""


def all_windows_ctes(spec: SequenceSpec) -> str:
    """apos(doc_id, win, pos, token, ch) over every document (labelled or not)."""
    L, K = spec.length, spec.alphabet
    return f"""
atxt AS (
  SELECT doc_id, string_split(text, '') AS chars FROM documents
  WHERE len(string_split(text, '')) >= {L}),
achars AS (
  SELECT doc_id, len(chars) AS n, unnest(range(0, len(chars))) AS c, unnest(chars) AS ch FROM atxt),
apos AS (
  SELECT doc_id, CAST(c // {L} AS INTEGER) AS win, CAST(c % {L} AS INTEGER) AS pos,
         CAST(ascii(ch) % {K} AS INTEGER) AS token, ch
  FROM achars WHERE c < (n // {L}) * {L}
  UNION ALL
  SELECT doc_id, CAST(n // {L} AS INTEGER) AS win, CAST(c - (n - {L}) AS INTEGER) AS pos,
         CAST(ascii(ch) % {K} AS INTEGER) AS token, ch
  FROM achars WHERE n % {L} <> 0 AND c >= n - {L})"""


def weight_ctes(spec: SequenceSpec, source: str = "lpos") -> str:
    """wt(pos, token, w, n1, n0), tot(t1, t0), bias(b), best(pos, wmax, btok) from the train split of a
    long-form source with columns (label, split, pos, token)."""
    L, K = spec.length, spec.alphabet
    return f"""
tr AS (
  SELECT pos, token, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0
  FROM {source} WHERE split = 'train' GROUP BY pos, token),
tot AS (
  SELECT count(*) FILTER (WHERE label = 1) AS t1, count(*) FILTER (WHERE label = 0) AS t0
  FROM {source} WHERE split = 'train' AND pos = 0),
grid AS (
  SELECT CAST(p AS INTEGER) AS pos, CAST(t AS INTEGER) AS token FROM range(0, {L}) a(p), range(0, {K}) b(t)),
wt AS (
  SELECT g.pos, g.token, coalesce(tr.n1, 0) AS n1, coalesce(tr.n0, 0) AS n0,
         CAST(round({MICRO} * (ln((coalesce(tr.n1, 0) + 1) / (tot.t1 + {K}))
                             - ln((coalesce(tr.n0, 0) + 1) / (tot.t0 + {K})))) AS BIGINT) AS w
  FROM grid g LEFT JOIN tr ON g.pos = tr.pos AND g.token = tr.token, tot),
bias AS (SELECT CAST(round({MICRO} * ln(t1 / t0)) AS BIGINT) AS b FROM tot),
wmax AS (SELECT pos, max(w) AS wmax FROM wt GROUP BY pos),
best AS (
  SELECT wt.pos, wmax.wmax, CAST(min(wt.token) AS INTEGER) AS btok
  FROM wt JOIN wmax ON wt.pos = wmax.pos AND wt.w = wmax.wmax GROUP BY wt.pos, wmax.wmax)"""


def pred(z: str) -> str:
    return f"round(1.0 / (1.0 + exp(-(CAST({z} AS DOUBLE) / {MICRO}))), 6)"


def search_ctes(spec: SequenceSpec, rounds: int | None = None, source: str = "lpos",
                where: str = "label = 0", keys: tuple[str, ...] = ("doc_id", "win")) -> str:
    """sw (searched positions), z0(keys, init_z), kept(keys, k, pos, prev_token, new_token, gain, new_z),
    fin(keys, init_z, n, zf, status) for the greedy search."""
    T, cap = spec.threshold_micro, spec.cap
    limit = cap if rounds is None else min(cap, rounds)
    ks = ", ".join(keys)
    on = " AND ".join(f"r.{k} = z0.{k}" for k in keys)
    stuck = f"n < {cap}" if rounds is None else f"n < {limit} AND n + 1 <= {rounds}"
    return f"""
sw AS (SELECT {ks}, pos, token FROM {source} WHERE {where}),
z0 AS (
  SELECT {ks}, CAST((SELECT b FROM bias) + sum(wt.w) AS BIGINT) AS init_z
  FROM sw JOIN wt ON sw.pos = wt.pos AND sw.token = wt.token GROUP BY {ks}),
g AS (
  SELECT {", ".join("sw." + k for k in keys)}, sw.pos, sw.token AS prev_token, best.btok AS new_token,
         best.wmax - wt.w AS gain
  FROM sw JOIN wt ON sw.pos = wt.pos AND sw.token = wt.token JOIN best ON best.pos = sw.pos
  WHERE best.wmax - wt.w > 0),
ranked AS (
  SELECT g.*, row_number() OVER (PARTITION BY {ks} ORDER BY gain DESC, pos) AS k,
         sum(gain) OVER (PARTITION BY {ks} ORDER BY gain DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cg
  FROM g),
steps AS (
  SELECT r.*, CAST(z0.init_z + r.cg AS BIGINT) AS new_z, CAST(z0.init_z + r.cg - r.gain AS BIGINT) AS prev_z
  FROM ranked r JOIN z0 ON {on}),
kept AS (SELECT * FROM steps WHERE k <= {limit} AND (k = 1 OR prev_z < {T})),
agg AS (SELECT {ks}, count(*) AS n, max(new_z) AS zmax FROM kept GROUP BY {ks}),
fin0 AS (
  SELECT {", ".join("z0." + k for k in keys)}, z0.init_z, CAST(coalesce(agg.n, 0) AS INTEGER) AS n,
         CAST(coalesce(agg.zmax, z0.init_z) AS BIGINT) AS zf
  FROM z0 LEFT JOIN agg USING ({ks})),
fin AS (
  SELECT *, CASE WHEN n > 0 AND zf >= {T} THEN 'reached' WHEN n >= {cap} THEN 'capped'
                 WHEN {stuck} THEN 'stuck' ELSE 'working' END AS status
  FROM fin0)"""


def token_csv(source: str, keys: tuple[str, ...], token: str = "token") -> str:
    ks = ", ".join(keys)
    return f"SELECT {ks}, string_agg(CAST({token} AS VARCHAR), ',' ORDER BY pos) AS csv FROM {source} GROUP BY {ks}"
