"""DuckDB SQL for every query that SQL can express."""

from __future__ import annotations

LEDGER = """
base AS (
  SELECT event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS t0, user_id AS u, user_id % 12 AS op, event_type AS et,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events),
timed AS (SELECT *, (t0 // 10800) * 10800 + (op // 2) * 600 AS q FROM base),
both_branches AS (
  SELECT id * 2 + 1 AS sig, q + CASE WHEN et IN ('view', 'signup') THEN id % 240 ELSE 0 END AS ts,
    CASE WHEN et IN ('error', 'view') THEN 'S' || u WHEN et = 'purchase' THEN 'F' || op || '_' || (k % 3)
         ELSE 'X' || op || '_' || (id // 60) END AS fee_payer,
    'S' || u AS source,
    CASE et WHEN 'error' THEN 'S' || u WHEN 'signup' THEN 'R' || u || '_' || (k % 2)
      WHEN 'view' THEN 'X' || op || '_' || (id // 60 + 1) WHEN 'click' THEN 'E' || (k % 10)
      WHEN 'purchase' THEN 'H' || op || '_' || (u // 48) END AS dest,
    CASE WHEN et = 'error' THEN 0 ELSE cents END AS amount,
    CASE et WHEN 'error' THEN 'memo' WHEN 'click' THEN 'swap' WHEN 'purchase' THEN 'stake' ELSE 'transfer' END AS kind,
    CASE WHEN et = 'view' AND k % 2 = 0 THEN NULL ELSE op END AS operator
  FROM timed
  UNION ALL
  SELECT id * 2 + 2, q + 300 + k, 'Y' || id,
    CASE WHEN et = 'purchase' THEN 'H' || op || '_' || (u // 48) ELSE 'R' || u || '_' || (k % 2) END,
    'E' || (k % 10), cents - (cents * (k % 4)) // 400, 'consolidate', op
  FROM timed WHERE (et = 'purchase' AND k % 5 = 0) OR (et = 'signup' AND k % 3 = 0)),
ledger AS (SELECT *, slot AS pos FROM (
  SELECT sig, CAST(row_number() OVER (ORDER BY ts, sig) AS BIGINT) AS slot, ts, fee_payer, source, dest, amount, kind, operator
  FROM both_branches)),
accounts AS (SELECT fee_payer AS account FROM ledger UNION SELECT source FROM ledger UNION SELECT dest FROM ledger),
owned AS (SELECT source AS account, arg_max(operator, pos) AS operator FROM ledger WHERE operator IS NOT NULL GROUP BY source),
bursts AS (
  SELECT *, max(CASE WHEN fresh THEN slot END) OVER (ORDER BY slot ROWS UNBOUNDED PRECEDING) AS group_id
  FROM (SELECT *, coalesce(ts <> lag(ts) OVER (ORDER BY slot) OR slot <> lag(slot) OVER (ORDER BY slot) + 1, true) AS fresh FROM ledger))
"""


def _windows(w: int) -> str:
    return f"""(SELECT *, max(CASE WHEN fresh THEN ts END) OVER (ORDER BY ts, slot, sig ROWS UNBOUNDED PRECEDING) AS group_id
  FROM (SELECT *, coalesce(ts - lag(ts) OVER (ORDER BY ts, slot, sig) > {w}, true) AS fresh FROM ledger))"""


def _episodes(rows: str, w: int) -> str:
    return f"""(SELECT *, max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY dest ORDER BY ts, slot, sig ROWS UNBOUNDED PRECEDING) AS group_id
  FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY dest ORDER BY ts, slot, sig) > {w}, true) AS fresh FROM {rows}))"""


ACTIVE = "(SELECT * FROM ledger WHERE dest IN (SELECT source FROM ledger))"
MOVE = "amount > 0 AND source <> dest"


def _pairs(members: str, bucket: str, gate: str = "") -> str:
    """Pairs of sources that share a bucket, with the number of buckets."""
    keep = f"WHERE ({bucket}) IN (SELECT ({bucket}) FROM ({members}) GROUP BY {bucket} HAVING {gate})" if gate else ""
    m = f"(SELECT * FROM ({members}) {keep})"
    on = " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in bucket.split(","))
    return f"SELECT x.source AS a, y.source AS b, count(*) AS w FROM {m} x JOIN {m} y ON {on} AND x.source < y.source GROUP BY 1, 2"


def _peel(window: int) -> str:
    return f"""SELECT x.source AS a, y.dest AS b FROM ledger x JOIN ledger y ON x.dest = y.source AND x.sig <> y.sig
  AND y.ts BETWEEN x.ts AND x.ts + {window} AND abs(x.amount - y.amount) <= (x.amount * 50) // 10000
  WHERE x.amount > 0 AND x.source <> x.dest AND y.amount > 0 AND y.source <> y.dest"""


FIRST = "(SELECT source, min(ts) AS t FROM ledger GROUP BY source)"
FUNDING = "SELECT DISTINCT source AS funder, dest AS fee_payer FROM ledger WHERE source <> dest AND dest IN (SELECT fee_payer FROM ledger)"


def _funded(least: int) -> str:
    return f"""SELECT DISTINCT f.funder, l.source FROM ({FUNDING}) f JOIN ledger l ON l.fee_payer = f.fee_payer AND l.fee_payer <> l.source
  WHERE f.funder IN (SELECT funder FROM ({FUNDING}) GROUP BY funder HAVING count(*) >= {least})"""


EDGES = {
    "fee": "SELECT fee_payer AS a, source AS b FROM ledger",
    "cospend": f"""SELECT dest AS a, source AS b FROM {ACTIVE} WHERE {MOVE} AND dest IN (
        SELECT dest FROM {ACTIVE} WHERE {MOVE} GROUP BY dest HAVING count(DISTINCT source) BETWEEN 2 AND 10)""",
    "peel": _peel(120),
    "activation": f"SELECT l.source AS a, l.dest AS b FROM ledger l JOIN {FIRST} f ON f.source = l.dest WHERE l.amount > 0 AND l.source <> l.dest AND f.t - l.ts BETWEEN 0 AND 172800",
    "copay_exact": _pairs("SELECT DISTINCT group_id, dest, source FROM bursts", "group_id, dest", "count(*) BETWEEN 2 AND 10"),
    "coact": _pairs("SELECT DISTINCT group_id, source FROM bursts WHERE fee_payer <> source", "group_id", "count(*) BETWEEN 2 AND 10"),
    "funder": f"SELECT funder AS a, source AS b FROM ({_funded(3)}) WHERE funder IN (SELECT funder FROM ({_funded(3)}) GROUP BY funder HAVING count(*) BETWEEN 2 AND 100000)",
}


def _copay_windowed(w: int) -> str:
    return _pairs(f"SELECT DISTINCT group_id, dest, source FROM {_episodes(ACTIVE, w)}", "group_id, dest", "count(*) BETWEEN 2 AND 10")


def _preset(name: str, w: int = 120) -> str:
    """UNION ALL of a preset's edges."""
    if name in ("fee", "cospend", "activation"):
        return EDGES[name]
    parts = [EDGES[x] for x in ("fee", "cospend", "peel", "activation")]
    if name == "exact":
        parts += [f"SELECT a, b FROM ({EDGES['copay_exact']}) WHERE w >= 2", f"SELECT a, b FROM ({EDGES['coact']}) WHERE w >= 3"]
    else:
        parts.append(f"SELECT a, b FROM ({_copay_windowed(w)}) WHERE w >= 3")
    if name == "funder_aware":
        parts.append(EDGES["funder"])
    return " UNION ALL ".join(f"({p})" for p in parts)


def _canonical(edges: str) -> str:
    return f"SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({edges}) WHERE a <> b"


def _clusters(name: str, w: int = 120, tag: str = "") -> str:
    """CTEs that end in clusters{tag}(account, cluster_id)."""
    return f"""
links{tag} AS MATERIALIZED (SELECT a, b FROM ({_preset(name, w)}) WHERE a <> b UNION SELECT b, a FROM ({_preset(name, w)}) WHERE a <> b),
cc{tag}(id, root) USING KEY (id) AS (
  SELECT account, account FROM accounts
  UNION
  SELECT e.b, min(cc{tag}.root) FROM cc{tag} JOIN links{tag} e ON e.a = cc{tag}.id JOIN recurring.cc{tag} r ON r.id = e.b
  WHERE cc{tag}.root < r.root GROUP BY e.b),
clusters{tag} AS MATERIALIZED (SELECT id AS account, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM cc{tag})"""


def _purity(grouped: str, by_group: bool = False) -> str:
    groups = f"""SELECT group_id, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS same, CAST(sum(n) * (sum(n) - 1) // 2 AS BIGINT) AS pairs FROM (
      SELECT group_id, operator, count(*) AS n FROM (
        SELECT group_id, source, arg_min(operator, pos) AS operator FROM {grouped} WHERE operator IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1"""
    if by_group:
        return groups
    return f"(SELECT CASE WHEN coalesce(sum(pairs), 0) > 0 THEN sum(same) / sum(pairs) ELSE 1.0 END FROM ({groups}))"


FUNDING_RECORDS = "SELECT sig, source, dest FROM ledger WHERE fee_payer = source AND source <> dest AND dest IN (SELECT fee_payer FROM ledger)"
ANONYMITY = f"""SELECT f.funder, any_value(g.fundees) AS fundees, count(DISTINCT p.operator) AS operators
  FROM (SELECT DISTINCT source AS funder, dest AS fee_payer FROM ({FUNDING_RECORDS})) f
  JOIN (SELECT source AS funder, count(DISTINCT dest) AS fundees FROM ({FUNDING_RECORDS}) GROUP BY 1 HAVING count(DISTINCT dest) >= 2) g ON g.funder = f.funder
  JOIN (SELECT fee_payer, arg_max(operator, pos) AS operator FROM ledger WHERE operator IS NOT NULL AND fee_payer <> source GROUP BY 1) p ON p.fee_payer = f.fee_payer
  GROUP BY 1"""


def _score(tag: str = "") -> str:
    """CTEs that end in score{tag}: one row with tp, precision, recall, f1 and sizes."""
    return f"""
labelled{tag} AS (SELECT o.operator, c.cluster_id FROM owned o LEFT JOIN clusters{tag} c USING (account)),
cells{tag} AS (SELECT operator, cluster_id, count(*) AS n FROM labelled{tag} GROUP BY ALL),
pr{tag} AS (SELECT *, tp / greatest(pp, 1) AS p, tp / greatest(ap, 1) AS r FROM (SELECT
  (SELECT sum(n * (n - 1) // 2) FROM cells{tag}) AS tp,
  (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cells{tag} GROUP BY cluster_id)) AS pp,
  (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cells{tag} GROUP BY operator)) AS ap)),
score{tag} AS (SELECT p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM pr{tag})"""


def _with(body: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((LEDGER, *ctes))} {body}"


def _report(name: str) -> str:
    w = 0 if name in ("fee", "cospend", "activation", "exact") else 120
    body = f"""SELECT (SELECT count(*) FROM accounts) AS num_accounts, (SELECT count(*) FROM owned) AS owned_accounts,
  (SELECT count(DISTINCT cluster_id) FROM clusters) AS num_clusters, round(CAST(f1 AS DOUBLE), 6) AS attribution_f1,
  round(CAST(p AS DOUBLE), 6) AS attribution_precision, round(CAST(r AS DOUBLE), 6) AS linkage_recall,
  round((SELECT coalesce(avg(n), 1.0) FROM (SELECT count(DISTINCT cluster_id) AS n FROM labelled GROUP BY operator)), 6) AS fragmentation,
  round((SELECT max(n) FROM (SELECT count(*) AS n FROM labelled GROUP BY cluster_id)) / (SELECT CAST(count(*) AS DOUBLE) FROM owned), 6) AS largest_cluster_frac,
  round(CAST({_purity('bursts')} AS DOUBLE), 6) AS burst_purity, round(CAST({_purity(_windows(w))} AS DOUBLE), 6) AS window_purity,
  CAST({w} AS BIGINT) AS window_secs, (SELECT count(*) FROM ({FUNDING_RECORDS})) AS funding_records,
  round((SELECT coalesce(avg(operators), 1.0) FROM ({ANONYMITY})), 6) AS funder_anonymity_set FROM score"""
    return _with(body, _clusters(name), _score(), recursive=True)


def _sweep(windows: tuple) -> str:
    ctes = [x for w in windows for x in (_clusters("windowed", w, f"_{w}"), _score(f"_{w}"))]
    body = " UNION ALL ".join(
        f"""SELECT CAST({w} AS BIGINT) AS window_secs, (SELECT count(DISTINCT cluster_id) FROM clusters_{w}) AS num_clusters,
        round(CAST(p AS DOUBLE), 6) AS attribution_precision, round(CAST(r AS DOUBLE), 6) AS linkage_recall, round(CAST(f1 AS DOUBLE), 6) AS attribution_f1 FROM score_{w}"""
        for w in windows
    )
    return _with(body, *ctes, recursive=True)


def _feature_ctes() -> str:
    mine = "source IN (SELECT account FROM owned)"

    def jaccard(item: str) -> str:
        sets = f"(SELECT DISTINCT source, {item} AS i FROM ledger WHERE {mine})"
        return f"""SELECT x.source AS a, y.source AS b, count(*) / (any_value(nx.n) + any_value(ny.n) - count(*)) AS v
          FROM {sets} x JOIN {sets} y ON x.i = y.i AND x.source < y.source
          JOIN (SELECT source, count(*) AS n FROM {sets} GROUP BY 1) nx ON nx.source = x.source
          JOIN (SELECT source, count(*) AS n FROM {sets} GROUP BY 1) ny ON ny.source = y.source GROUP BY 1, 2"""

    def counted(pairs: str) -> str:
        return f"""SELECT least(a, b) AS a, greatest(a, b) AS b, ln(1 + count(*)) AS v FROM ({pairs}) WHERE a <> b GROUP BY 1, 2"""

    def shared(members: str, bucket: str) -> str:
        return f"SELECT a, b, ln(1 + w) AS v FROM ({_pairs(members, bucket)})"

    parts = {
        "fee_payer_jaccard": jaccard("fee_payer"),
        "dest_jaccard": jaccard("dest"),
        "coburst": shared(f"SELECT DISTINCT group_id, source FROM bursts WHERE {mine}", "group_id"),
        "windowed_copay": shared(f"SELECT DISTINCT group_id, dest, source FROM {_windows(120)} WHERE {mine}", "group_id, dest"),
        "funding_hop": shared(f"SELECT * FROM ({_funded(1)}) WHERE {mine}", "funder"),
        "activation_lineage": counted(EDGES["activation"]),
        "peel": counted(EDGES["peel"]),
    }
    spans = f"(SELECT source, min(ts) AS t0, max(ts) AS t1 FROM ledger WHERE {mine} GROUP BY 1)"
    cols = ", ".join(f"round(CAST(coalesce({n}.v, 0) AS DOUBLE), 6) AS {n}" for n in parts)
    joins = " ".join(f"LEFT JOIN ({q}) {n} ON {n}.a = x.source AND {n}.b = y.source" for n, q in parts.items())
    return f"""features AS MATERIALIZED (SELECT x.source AS a, y.source AS b, {cols},
      round(greatest(0, least(x.t1, y.t1) - greatest(x.t0, y.t0)) / greatest(1, greatest(x.t1, y.t1) - least(x.t0, y.t0)), 6) AS timespan_overlap
      FROM {spans} x JOIN {spans} y ON x.source < y.source {joins})"""


def _single_auc() -> str:
    names = ["fee_payer_jaccard", "dest_jaccard", "coburst", "windowed_copay", "funding_hop", "activation_lineage", "peel", "timespan_overlap"]
    scored = " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {n} AS score, oa.operator = ob.operator AS y FROM features f JOIN owned oa ON oa.account = f.a JOIN owned ob ON ob.account = f.b"
        for n in names
    )
    return _with(
        """SELECT feature, round(CAST((sum(CASE WHEN y THEN rk END) - np * (np + 1) / 2) / (np * nn) AS DOUBLE), 6) AS auc FROM (
          SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2 AS rk,
            count(*) FILTER (y) OVER (PARTITION BY feature) AS np, count(*) FILTER (NOT y) OVER (PARTITION BY feature) AS nn
          FROM scored) GROUP BY feature, np, nn""",
        _feature_ctes(),
        f"scored AS ({scored})",
    )


SUFFIX = """
SELECT (SELECT count(*) FROM ledger) + n AS records, (SELECT count(DISTINCT slot) FROM ledger) + n AS slots,
  (SELECT max(slot) FROM ledger) + n AS last_slot FROM topups
"""
TOPUPS = """
hubs AS (SELECT operator, arg_min(source, pos) AS hub FROM ledger WHERE operator IS NOT NULL GROUP BY operator),
topups AS (
  SELECT count(*) AS n FROM (
    SELECT fee_payer, arg_min(operator, pos) AS operator, arg_min(operator IS NULL, pos) AS unknown FROM ledger
    WHERE fee_payer NOT IN (SELECT source FROM ledger) GROUP BY fee_payer) f
  JOIN hubs USING (operator) WHERE NOT unknown AND hub <> fee_payer)
"""
FINGERPRINT = """
SELECT sha256(string_agg(h, '' ORDER BY c)) AS fingerprint FROM (
  SELECT c, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM (
    SELECT pos, pos // 100000 AS c, sha256(concat_ws('|', sig, slot, ts, fee_payer, source, dest, amount, kind, coalesce(operator, 4294967295))) AS h
    FROM ledger) GROUP BY c)
"""


def oracle_sql(names) -> dict[str, str]:
    presets = ("fee", "cospend", "activation", "exact", "windowed", "funder_aware")
    out = {
        "ledger_view": _with("SELECT * FROM ledger"),
        "accounts_distinct": _with("SELECT * FROM accounts"),
        "ownership_last_label": _with("SELECT * FROM owned"),
        "payer_ownership": _with("SELECT fee_payer, arg_max(operator, pos) AS operator FROM ledger WHERE operator IS NOT NULL AND fee_payer <> source GROUP BY 1"),
        "burst_groups": _with("SELECT sig, group_id FROM bursts"),
        "burst_summary": _with("SELECT count(*) AS bursts, max(n) AS largest, CAST(sum(s) AS BIGINT) AS source_rows FROM (SELECT group_id, count(*) AS n, count(DISTINCT source) AS s FROM bursts GROUP BY 1)"),
        **{f"window_groups_{w}": _with(f"SELECT sig, group_id FROM {_windows(w)}") for w in (0, 120, 600)},
        "dest_episodes_120": _with(f"SELECT sig, dest, group_id FROM {_episodes('ledger', 120)}"),
        "edges_fee_payer": _with(_canonical(EDGES["fee"])),
        "edges_cospend": _with(_canonical(EDGES["cospend"])),
        "edges_peel": _with(_canonical(EDGES["peel"])),
        "edges_peel_600": _with(_canonical(_peel(600))),
        "edges_activation": _with(_canonical(EDGES["activation"])),
        "edges_copay_exact": _with(f"SELECT * FROM ({EDGES['copay_exact']}) WHERE w >= 2"),
        "edges_copay_windowed": _with(f"SELECT * FROM ({_copay_windowed(120)}) WHERE w >= 3"),
        "edges_coact": _with(f"SELECT * FROM ({EDGES['coact']}) WHERE w >= 3"),
        "edges_ceiling": _with(
            _canonical("SELECT min(source) OVER (PARTITION BY group_id) AS a, source AS b FROM (SELECT DISTINCT group_id, source FROM bursts) WHERE group_id IN (SELECT group_id FROM bursts GROUP BY 1 HAVING count(DISTINCT source) BETWEEN 2 AND 10)")
        ),
        "funding_edges": _with(FUNDING),
        "edges_funder": _with(_canonical(EDGES["funder"])),
        **{f"clusters_{p}": _with("SELECT * FROM clusters", _clusters(p), recursive=True) for p in presets},
        "cluster_sizes_fee": _with("SELECT cluster_id, count(*) AS size FROM clusters GROUP BY 1", _clusters("fee"), recursive=True),
        **{f"report_{p}": _report(p) for p in presets},
        "window_sweep": _sweep((0, 30, 60, 120, 300, 600)),
        "worst_case_f1": _with(
            "SELECT round(CAST(x.f1 AS DOUBLE), 6) AS exact_f1, round(CAST(y.f1 AS DOUBLE), 6) AS windowed_f1, round(CAST(greatest(x.f1, y.f1) AS DOUBLE), 6) AS worst_f1 FROM score_x x, score_w y",
            _clusters("exact", 120, "_x"), _score("_x"), _clusters("windowed", 120, "_w"), _score("_w"), recursive=True,
        ),
        "purity_by_group": _with(_purity("bursts", by_group=True)),
        "funding_records": _with(FUNDING_RECORDS),
        "funding_suffix_base": _with(SUFFIX, TOPUPS),
        "ledger_fingerprint": _with(FINGERPRINT),
        "funder_anonymity": _with(ANONYMITY),
        "cost_estimate": _with("SELECT count(*) AS transactions, CAST(sum(CASE WHEN fee_payer = source THEN 1 ELSE 2 END) AS BIGINT) AS signatures, CAST(sum(CASE WHEN fee_payer = source THEN 1 ELSE 2 END) * 5000 AS BIGINT) AS estimated_fees, CAST(sum(amount) AS BIGINT) AS transferred FROM ledger"),
        "pair_features": _with("SELECT * FROM features", _feature_ctes()),
        "single_feature_auc": _single_auc(),
        "monotone_time_violations": _with("SELECT count(*) FILTER (bad) AS violations FROM (SELECT ts < lag(ts) OVER (ORDER BY slot) AS bad FROM ledger)"),
        "throwaway_payers": _with("SELECT fee_payer, first_ts, first_pos, operator FROM (SELECT fee_payer, ts AS first_ts, pos AS first_pos, operator, row_number() OVER (PARTITION BY fee_payer ORDER BY pos) AS n FROM ledger WHERE fee_payer NOT IN (SELECT source FROM ledger)) WHERE n = 1"),
    }
    return {k: v for k, v in out.items() if k in names}
