"""SQL of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from ..operators.triage import ACTIONS, KEYWORDS, UNKNOWN

E = """e AS (SELECT event_id AS seq, ts AS "timestamp", event_type AS event_id, CAST(user_id AS VARCHAR) AS node,
  CAST(event_type = 'error' AS INTEGER) AS label, value AS score, props AS content FROM events)"""
T = E + """, t0 AS (SELECT min(epoch_us("timestamp")) AS t0 FROM e),
t AS (SELECT e.*, (epoch_us("timestamp") - t0) / 1e6 AS t_sec, CAST(floor((epoch_us("timestamp") - t0) / 1e6 / 3600.0) AS BIGINT) AS win FROM e, t0)"""
L = """l AS (SELECT l_orderkey AS block_id, l_linenumber AS line_no, l_returnflag || l_linestatus AS event_id, l_shipdate AS "timestamp", l_partkey AS part FROM lineitem)"""
LABELED = L + """, m AS (SELECT block_id, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS n_events FROM l GROUP BY block_id),
lab AS (SELECT o_orderkey AS block_id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM orders),
s AS (SELECT m.*, lab.label FROM m JOIN lab USING (block_id) WHERE lab.label IS NOT NULL)"""
SPLIT = LABELED + """, r AS (SELECT *, row_number() OVER (ORDER BY "start", block_id) - 1 AS pos, count(*) OVER () AS n FROM s),
sp AS (SELECT *, CASE WHEN pos < round_even(n * 0.7, 0) THEN 'train' ELSE 'test' END AS split FROM r)"""
MU, ALPHA, BETA = "0.002", "0.0002", "(1.0 / 1800)"
RATED = T + f""", x AS (SELECT a.seq, a.t_sec, coalesce(sum(exp(-{BETA} * (a.t_sec - b.t_sec))), 0) AS a
  FROM t a LEFT JOIN t b ON (b.t_sec, b.seq) < (a.t_sec, a.seq) AND b.t_sec > a.t_sec - 100000 GROUP BY ALL),
c AS (SELECT seq, t_sec, a, {MU} * t_sec + {ALPHA} / {BETA} * (row_number() OVER (ORDER BY t_sec, seq) - 1 - a) AS comp FROM x),
g AS (SELECT seq, comp - lag(comp) OVER (ORDER BY t_sec, seq) AS gap FROM c),
gaps AS (SELECT * FROM g WHERE gap IS NOT NULL)"""
SCORED = """sc AS (SELECT d.doc_id AS k, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
EVENT_SCORES = E + """, es AS (SELECT seq AS k, "timestamp", label, coalesce(score, 0.0) AS score FROM e)"""


def curve(table: str, part: str = "") -> str:
    over = f"PARTITION BY {part} " if part else ""
    cols = f"{part}, " if part else ""
    return f"""grp AS (SELECT {cols}score, count(*) AS n, sum(label) AS tp FROM {table} GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER ({over}ORDER BY score DESC) AS cn, sum(tp) OVER ({over}ORDER BY score DESC) AS ct, sum(tp) OVER ({over.strip()}) AS p FROM grp)"""


def point(table: str) -> str:
    return f"""ord AS (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rk, sum(label) OVER (ORDER BY score DESC, k ROWS UNBOUNDED PRECEDING) AS ctp, sum(label) OVER () AS pos, count(*) OVER () AS n FROM {table}),
op AS (SELECT * FROM ord WHERE ctp / pos >= 0.9 OR rk = n ORDER BY rk LIMIT 1)"""


POINT = "0.9 AS target_recall, score AS threshold, round(ctp / pos, 6) AS recall, round(ctp / rk, 6) AS precision, CAST(ctp AS BIGINT) AS tp, CAST(rk - ctp AS BIGINT) AS fp, CAST(pos - ctp AS BIGINT) AS fn"


def bins(table: str, n: int) -> str:
    return f"""ends AS (SELECT min(epoch_us("timestamp")) AS a, max(epoch_us("timestamp")) AS b FROM {table}),
binned AS (SELECT x.*, CAST(least(floor((epoch_us("timestamp") - a) * {n} / (b - a)), {n - 1}) AS INTEGER) + 1 AS bin, (b - a) / {n}.0 / 86400e6 AS days FROM {table} x, ends)"""


def pot(table: str, q: str, level: str, by: str = "k") -> str:
    """z by group of a table (by, score)."""
    return f"""q0 AS (SELECT {by}, quantile_cont(score, {level}) AS t, count(*) AS n FROM {table} GROUP BY {by}),
q1 AS (SELECT f.{by}, count(*) AS np, avg(f.score - t) AS m, var_pop(f.score - t) AS v FROM {table} f JOIN q0 USING ({by}) WHERE f.score > t GROUP BY f.{by}),
q2 AS (SELECT {by}, t, n, coalesce(np, 0) AS np, m, v, CASE WHEN np >= 10 AND v > 0 AND m > 0 THEN 0.5 * (1 - m * m / v) END AS g0 FROM q0 LEFT JOIN q1 USING ({by})),
q3 AS (SELECT *, CASE WHEN m * (1 - g0) > 0 THEN g0 ELSE 0 END AS gamma, CASE WHEN m * (1 - g0) > 0 THEN m * (1 - g0) ELSE greatest(coalesce(m, 1e-12), 1e-12) END AS sigma FROM q2),
fits AS (SELECT {by}, t, gamma, sigma, np, CASE WHEN np = 0 THEN t WHEN abs(gamma) < 1e-8 THEN t + sigma * ln(np / ({q} * n)) ELSE t + sigma / gamma * (pow({q} * n / np, -gamma) - 1) END AS z FROM q3)"""


FED = EVENT_SCORES + """, o AS (SELECT *, row_number() OVER (ORDER BY "timestamp", k) - 1 - 500 AS i, count(*) OVER () AS n FROM es),
fed AS (SELECT score, unnest(range(CAST(greatest(floor(i / 100) + 1, 0) AS BIGINT), CAST(least(floor((i + 400) / 100), greatest(0, floor((n - 500) / 100))) AS BIGINT) + 1)) AS kk FROM o)"""
ROLLED = FED + """, fits AS (SELECT kk, quantile_cont(score, 0.98) AS z FROM fed GROUP BY kk)"""
TRAIL = """, tr AS (SELECT o.k AS seq, o.i, o.label, o."timestamp", o.score > a.z AS flag, b.z AS thr FROM o LEFT JOIN fits a ON a.kk = floor(o.i / 100) LEFT JOIN fits b ON b.kk = floor((o.i + 1) / 100) WHERE o.i >= 0)"""


def anomalies(top: int) -> str:
    return E + f""", fl AS (SELECT * FROM (SELECT seq, "timestamp", node, event_id, content, round_even(score, 6) AS raw FROM e WHERE score IS NOT NULL) ORDER BY raw DESC, seq LIMIT {top}),
an AS (SELECT CAST(seq AS VARCHAR) AS id, "timestamp", (rank() OVER (ORDER BY raw) + (count(*) OVER (PARTITION BY raw) - 1) / 2.0) / count(*) OVER () AS score, node AS entity, event_id AS template, seq FROM fl)"""


DEDUP = anomalies(1000) + """, dd AS (SELECT *, row_number() OVER (PARTITION BY entity, template ORDER BY score DESC, seq) AS rn, count(*) OVER (PARTITION BY entity, template) AS dedup_n, min(seq) OVER (PARTITION BY entity, template) AS first_seq FROM an),
d AS (SELECT * FROM dd WHERE rn = 1)"""


def correlated(gap: float, same: bool) -> str:
    extra = " OR entity IS DISTINCT FROM eb" if same else ""
    return DEDUP + f""", p AS (SELECT *, lag("timestamp") OVER w AS tb, lag(entity) OVER w AS eb FROM d WINDOW w AS (ORDER BY "timestamp", first_seq)),
co AS (SELECT *, CAST(sum(CASE WHEN tb IS NULL OR epoch_us("timestamp") - epoch_us(tb) > {gap} * 1e6{extra} THEN 1 ELSE 0 END) OVER (ORDER BY "timestamp", first_seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident_no FROM p)"""


def category(text: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in KEYWORDS.items())
    return f"CASE {cases} ELSE '{UNKNOWN}' END"


INCIDENTS = correlated(1800.0, False) + """, seen AS (SELECT incident_no, template, min((epoch_us("timestamp"), first_seq)) AS f FROM co GROUP BY ALL),
tp AS (SELECT incident_no, string_agg(template, ' ' ORDER BY f) AS templates FROM seen GROUP BY incident_no),
ent AS (SELECT incident_no, string_agg(DISTINCT entity, ' ' ORDER BY entity) AS entities FROM co WHERE length(entity) > 0 GROUP BY incident_no),
inc AS (SELECT incident_no, 'INC-' || CASE WHEN incident_no < 10000 THEN lpad(CAST(incident_no AS VARCHAR), 4, '0') ELSE CAST(incident_no AS VARCHAR) END AS id, count(*) AS n_anomalies, sum(dedup_n) AS dedup_count, min("timestamp") AS "start", max("timestamp") AS "end", max(score) AS peak FROM co GROUP BY incident_no)"""


def shown(c: str) -> str:
    return f"CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%d %H:%M:%S') ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END"


RECORDS = INCIDENTS + f""", rec AS (SELECT inc.*, CASE WHEN peak >= 0.8 OR n_anomalies >= 20 THEN 'P1' WHEN peak >= 0.5 OR n_anomalies >= 5 THEN 'P2' WHEN peak >= 0.2 THEN 'P3' ELSE 'P4' END AS priority,
  {category("lower(templates)")} AS category, round_even(peak, 4) AS max_score FROM inc JOIN tp USING (incident_no))"""

RANKED = RECORDS + """, ranked AS (SELECT rec.* REPLACE (CAST(dedup_count AS BIGINT) AS dedup_count), row_number() OVER (ORDER BY priority, max_score DESC, incident_no) - 1 AS rank FROM rec)"""
TEXTS = RANKED + """, lists AS (SELECT incident_no, list(template ORDER BY f) AS all_templates FROM seen GROUP BY incident_no),
who AS (SELECT incident_no, list_sort(list(DISTINCT entity) FILTER (WHERE length(entity) > 0)) AS entities FROM co GROUP BY incident_no),
texts AS (SELECT *, coalesce(len(entities), 0) AS n_entities, (epoch_us("end") - epoch_us("start")) / 1e6 AS span FROM ranked JOIN lists USING (incident_no) JOIN who USING (incident_no))"""
ACTION = "CASE category " + " ".join(f"WHEN '{kind}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for kind, text in ACTIONS.items()) + " END"

WINDOW = """w AS (SELECT win, min("timestamp") AS "start", count(*) AS n_events, max(label) AS label, {} FROM t GROUP BY win)"""
COUNTS = ", ".join(f"count(*) FILTER (WHERE event_id = '{v}') AS {v}" for v in ("click", "error", "purchase", "signup", "view"))
QUALITY = E + """, gp AS (SELECT (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (ORDER BY seq)) / 1e6 AS gap FROM e),
kz AS (SELECT node, count(*) AS n FROM e GROUP BY node),
q AS (SELECT count(*) AS n_rows, min("timestamp") AS time_start, max("timestamp") AS time_end, count(DISTINCT event_id) AS n_templates,
  CAST(sum(CASE WHEN seq IS NULL THEN 1 ELSE 0 END + CASE WHEN "timestamp" IS NULL THEN 1 ELSE 0 END + CASE WHEN event_id IS NULL OR event_id = '' THEN 1 ELSE 0 END + CASE WHEN node IS NULL OR node = '' THEN 1 ELSE 0 END
    + CASE WHEN label IS NULL THEN 1 ELSE 0 END + CASE WHEN score IS NULL OR isnan(score) THEN 1 ELSE 0 END + CASE WHEN content IS NULL OR content = '' THEN 1 ELSE 0 END) AS BIGINT) AS null_cells,
  bool_and(epoch_us("timestamp") % 1000000 = 0) AS seconds_only, count(*) FILTER (WHERE node IS NULL AND FALSE) AS lines_without_key, count(*) - count(DISTINCT coalesce(content, '#null')) AS duplicate_content,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS exact_duplicate_rows, (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1e6 AS span_seconds FROM e),
q2 AS (SELECT count(*) FILTER (WHERE gap < 0) AS times_going_backwards, round_even(avg(CASE WHEN gap = 0 THEN 1.0 WHEN gap IS NULL THEN NULL ELSE 0.0 END), 4) AS tie_fraction FROM gp),
q3 AS (SELECT count(*) AS n_keys, median(n) AS median_events_per_key, max(n) AS max_events_per_key, round_even(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 4) AS fraction_single_event_keys FROM kz),
rep AS (SELECT q.*, q2.*, q3.*, times_going_backwards = 0 AS time_monotonic FROM q, q2, q3)"""

SQL = {
    "canonical_events": f'WITH {E} SELECT seq, "timestamp", event_id, node, label, round(score, 6) AS score, content FROM e',
    "parsed_lines": f"""WITH {E} SELECT "timestamp", left(md5(event_id), 8) AS event_id, event_id AS template, label, node, 'KERNEL' AS component, 'INFO' AS level, event_id || ' ' || content AS content FROM e""",
    "explode_keys": """WITH k AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="[^"]+"'))) AS key FROM pages) SELECT key, count(*) AS n_pages FROM k GROUP BY key""",
    "dq_report": f"WITH {QUALITY} SELECT * REPLACE (round(span_seconds, 6) AS span_seconds) FROM rep",
    "dq_flags": f"""WITH {QUALITY} SELECT 'single_event_keys' AS "check", fraction_single_event_keys AS value, coalesce(fraction_single_event_keys > 0.5, FALSE) AS flag FROM rep UNION ALL SELECT 'coarse_time', tie_fraction, seconds_only AND coalesce(tie_fraction > 0, FALSE) FROM rep
UNION ALL SELECT 'unsorted', CAST(times_going_backwards AS DOUBLE), times_going_backwards > 0 FROM rep UNION ALL SELECT 'null_cells', CAST(null_cells AS DOUBLE), null_cells > 0 FROM rep UNION ALL SELECT 'duplicate_rows', CAST(exact_duplicate_rows AS DOUBLE), exact_duplicate_rows > 0 FROM rep""",
    "level_counts": "SELECT 'INFO' AS level, count(*) AS n FROM events",
    "value_counts": f"WITH {E} SELECT event_id, count(*) AS n FROM e GROUP BY event_id",
    "topk_vocab": f"WITH {E} SELECT event_id, count(*) AS n FROM e GROUP BY event_id ORDER BY n DESC, event_id LIMIT 3",
    "per_minute_fill": f"""WITH {E}, c AS (SELECT date_trunc('minute', "timestamp") AS m, count(*) AS n FROM e GROUP BY m), a AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MINUTE)) AS m FROM c), f AS (SELECT coalesce(n, 0) AS n FROM a LEFT JOIN c USING (m)) SELECT n, count(*) AS minutes FROM f GROUP BY n""",
    "fano": f"""WITH {E}, c AS (SELECT date_trunc('minute', "timestamp") AS m, count(*) AS n FROM e GROUP BY m), a AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MINUTE)) AS m FROM c), f AS (SELECT coalesce(n, 0) AS n FROM a LEFT JOIN c USING (m)) SELECT round(var_samp(n) / avg(n), 6) AS fano, count(*) AS minutes FROM f""",
    "gap_histogram": f"""WITH {E}, g AS (SELECT (epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (ORDER BY seq)) / 1e6 AS gap FROM e), x AS (SELECT log10(gap) AS x FROM g WHERE gap > 0), b AS (SELECT min(x) AS a, max(x) AS b FROM x)
SELECT CAST(least(floor(coalesce((x - a) * 50 / nullif(b - a, 0), 0)), 49) AS INTEGER) AS bin, count(*) AS n FROM x, b GROUP BY bin""",
    "burstiness_histogram": f"""WITH {E}, m AS (SELECT date_trunc('minute', "timestamp") AS m, count(*) AS n FROM e GROUP BY 1), ends AS (SELECT min(m) AS a, max(m) AS b FROM m),
per AS (SELECT coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS m FROM ends) LEFT JOIN m USING (m))
SELECT CAST(value AS BIGINT) AS value, (SELECT count(*) FROM per WHERE n = value) AS n FROM (SELECT unnest(range(0, (SELECT max(n) FROM per) + 1)) AS value)""",
    "size_histogram": f"""WITH {L}, s AS (SELECT count(*) AS size FROM l GROUP BY block_id)
SELECT CAST(value AS BIGINT) AS value, (SELECT count(*) FROM s WHERE size = value) AS n FROM (SELECT unnest(range(1, (SELECT max(size) FROM s) + 1)) AS value)""",
    "key_sessions": f"""WITH {L} SELECT block_id, string_agg(event_id, ' ' ORDER BY line_no, part, event_id) AS event_seq, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS n_events FROM l GROUP BY block_id""",
    "key_segments": f"""WITH {L}, r AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY line_no, part, event_id, "timestamp") - 1 AS place FROM l)
SELECT block_id, CAST(place // 3 AS BIGINT) AS segment_no, string_agg(event_id, ' ' ORDER BY place) AS event_seq, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS n_events FROM r GROUP BY ALL""",
    "count_matrix": f"WITH {L} SELECT block_id, " + ", ".join(f'count(*) FILTER (WHERE event_id = \'{v}\') AS "{v}"' for v in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM l GROUP BY block_id",
    "sessions_labeled": f"WITH {LABELED} SELECT * FROM s",
    "temporal_split": f"WITH {SPLIT} SELECT block_id, split FROM sp",
    "split_summary": f"""WITH {SPLIT}, a AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, max("start") FILTER (WHERE split = 'train') AS boundary, avg(label) FILTER (WHERE split = 'train') AS tr, avg(label) FILTER (WHERE split = 'test') AS te FROM sp)
SELECT n_train, n_test, boundary, round(tr, 6) AS train_rate, round(te, 6) AS test_rate, round(te / tr, 6) AS rate_ratio FROM a""",
    "rate_by_size": f"""WITH {LABELED} SELECT CASE WHEN n_events <= 0 THEN NULL WHEN n_events <= 10 THEN '(0, 10]' WHEN n_events <= 20 THEN '(10, 20]' WHEN n_events <= 30 THEN '(20, 30]' WHEN n_events <= 50 THEN '(30, 50]' WHEN n_events <= 300 THEN '(50, 300]' END AS size, round(avg(label), 6) AS rate, count(*) AS n FROM s GROUP BY size""",
    "window_content": f"WITH {T}, {WINDOW.format(COUNTS)} SELECT * FROM w ORDER BY win",
    "window_timing": f"""WITH {T}, x AS (SELECT a.win, a.seq, coalesce(sum(exp(-(a.t_sec - b.t_sec) / 600)), 0) AS f, coalesce(sum(exp(-(a.t_sec - b.t_sec) / 3600)), 0) AS s FROM t a LEFT JOIN t b ON (b.t_sec, b.seq) < (a.t_sec, a.seq) AND b.t_sec > a.t_sec - 150000 GROUP BY ALL)
SELECT win, round(avg(f), 6) AS exc_mean_fast, round(max(f), 6) AS exc_max_fast, round(avg(s), 6) AS exc_mean_slow, round(max(s), 6) AS exc_max_slow, count(*) AS n_events FROM x GROUP BY win""",
    "window_features": f"""WITH {T.replace("3600.0", "21600.0")}, v AS (SELECT event_id, row_number() OVER (ORDER BY count(*) DESC, event_id) AS k FROM t GROUP BY event_id),
w AS (SELECT win, min("timestamp") AS "start", count(*) AS n_events, max(label) AS label, {", ".join(f"count(*) FILTER (WHERE v.k = {k}) AS top_{k}" for k in (1, 2, 3))} FROM t JOIN v USING (event_id) GROUP BY win),
x AS (SELECT a.win, a.seq, coalesce(sum(exp(-(a.t_sec - b.t_sec))), 0) AS f, coalesce(sum(exp(-(a.t_sec - b.t_sec) / 30)), 0) AS s FROM t a LEFT JOIN t b ON (b.t_sec, b.seq) < (a.t_sec, a.seq) AND b.t_sec > a.t_sec - 3000 GROUP BY ALL),
m AS (SELECT win, round(avg(f), 6) AS exc_mean_fast, round(max(f), 6) AS exc_max_fast, round(avg(s), 6) AS exc_mean_slow, round(max(s), 6) AS exc_max_slow FROM x GROUP BY win) SELECT * FROM w JOIN m USING (win)""",
    "excitation": f"WITH {RATED} SELECT seq, round(a, 6) AS excitation, round({MU} + {ALPHA} * a, 6) AS intensity, round(comp, 6) AS compensator FROM c",
    "rescaled_gaps": f"WITH {RATED} SELECT seq, round(gap, 6) AS gap FROM gaps",
    "ks_test": f"""WITH {RATED}, r AS (SELECT gap, row_number() OVER (ORDER BY gap, seq) AS k, count(*) OVER () AS n FROM gaps), s AS (SELECT max(greatest(k / n - (1 - exp(-gap)), (1 - exp(-gap)) - (k - 1) / n)) AS d, avg(gap) AS m, max(n) AS n FROM r), v AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS x FROM s)
SELECT round(d, 6) AS ks_stat, round(p, 6) AS ks_pvalue, round(m, 6) AS mean_gap, n, p > 0.05 AS accepted
FROM (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest((SELECT sum(2 * CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * x * x)) FROM (SELECT unnest(range(1, 101)) AS j)), 0.0), 1.0) END AS p FROM v)""",
    "qq_points": f"WITH {RATED}, r AS (SELECT gap, row_number() OVER (ORDER BY gap, seq) AS k, count(*) OVER () AS n FROM gaps) SELECT k, round(-ln(1 - (k - 0.5) / n), 6) AS theoretical, round(gap, 6) AS observed FROM r",
    "intensity_grid": f"""WITH {T}, gr AS (SELECT i * 2592.0 AS g FROM (SELECT unnest(range(1001)) AS i)) SELECT round(g, 6) AS g, round({MU} + {ALPHA} * coalesce(sum(exp(-{BETA} * (g - t_sec))), 0), 6) AS intensity FROM gr LEFT JOIN t ON t_sec < g AND t_sec > g - 100000 GROUP BY g""",
    "hawkes_window": f"""WITH {E}, k AS (SELECT epoch_us("timestamp") AS u FROM e WHERE label = 1 AND "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-08') SELECT count(*) AS n, round((max(u) - min(u)) / 1e6, 6) AS span FROM k""",
    "pr_auc": f"WITH {SCORED}, {curve('sc')} SELECT round(sum(ct / cn * tp / p), 6) AS pr_auc FROM cum",
    "pr_curve": f"WITH {SCORED}, {curve('sc')} SELECT score AS threshold, round(ct / cn, 6) AS precision, round(ct / p, 6) AS recall FROM cum",
    "operating_point": f"WITH {SCORED}, {point('sc')} SELECT {POINT} FROM op",
    "fa_per_day": f"""WITH {EVENT_SCORES}, {point("es")}, dy AS (SELECT greatest((max(epoch_us("timestamp")) - min(epoch_us("timestamp"))) / 86400e6, 1e-9) AS days FROM es) SELECT {POINT.replace("score AS", "round(score, 6) AS")}, round((rk - ctp) / days, 6) AS fa_per_day FROM op, dy""",
    "drift_report": f"""WITH {EVENT_SCORES}, {point("es")}, {bins("es", 4)}, {curve("binned", "bin")}, ap AS (SELECT bin, sum(ct / cn * tp / p) AS ap FROM cum GROUP BY bin),
ba AS (SELECT bin, count(*) AS n, avg(label) AS anomaly_rate, sum(label) AS pos, count(*) FILTER (WHERE score >= (SELECT score FROM op) AND label = 1) / greatest(sum(label), 1) AS rc, count(*) FILTER (WHERE score >= (SELECT score FROM op) AND label = 0) / any_value(days) AS fa FROM binned GROUP BY bin)
SELECT bin, n, round(anomaly_rate, 6) AS anomaly_rate, CASE WHEN pos > 0 AND pos < n THEN round(ap, 6) END AS pr_auc, round(rc, 6) AS recall_at_thr, round(fa, 6) AS fa_per_day FROM ba JOIN ap USING (bin)""",
    "score_atom": f"WITH {SCORED}, a AS (SELECT score, count(*) AS n FROM sc WHERE label = 0 GROUP BY score) SELECT round(max(n) / sum(n), 6) AS share FROM a",
    "metric_comparison": f"""WITH {SCORED}, ng AS (SELECT k, -score AS score, label FROM sc), {point("sc")}, {point("ng").replace("ord AS", "ord2 AS").replace("FROM ord ", "FROM ord2 ").replace("op AS", "op2 AS")},
a AS (SELECT unnest(['threshold', 'recall', 'precision', 'tp', 'fp', 'fn']) AS metric, unnest([score, ctp / pos, ctp / rk, ctp, rk - ctp, pos - ctp]) AS v FROM op), b AS (SELECT unnest(['recall', 'precision', 'tp', 'fp', 'fn']) AS metric, unnest([ctp / pos, ctp / rk, ctp, rk - ctp, pos - ctp]) AS v FROM op2)
SELECT metric, round(a.v, 6) AS "new", round(b.v, 6) AS "old", round(a.v - b.v, 6) AS change FROM a FULL JOIN b USING (metric)""",
    "invariant_check": f"WITH {L}, n AS (SELECT count(*) FILTER (WHERE event_id = 'NO') AS n_events FROM l), o AS (SELECT count(*) AS n_labels FROM orders) SELECT n_events, n_labels, n_events = n_labels AS equal FROM n, o",
    "fixed_threshold": f"WITH {EVENT_SCORES} SELECT round(quantile_cont(score, 0.98), 6) AS z FROM es",
    "log_floor_threshold": f"WITH {EVENT_SCORES} SELECT round(quantile_cont(ln(greatest(score, 1e-12)), 0.98), 6) AS z FROM es",
    "pot_threshold": f"WITH {EVENT_SCORES}, one AS (SELECT 0 AS k, score FROM es), {pot('one', '0.001', '0.98')} SELECT round(z, 6) AS z, round(t, 6) AS t, round(gamma, 6) AS gamma, round(sigma, 6) AS sigma, np AS n_peaks FROM fits",
    "rolling_quantile": f"WITH {ROLLED} {TRAIL} SELECT seq, i, flag, round(thr, 6) AS thr FROM tr",
    "adaptive_pot": f"WITH {FED}, {pot('fed', '0.01', '0.9', 'kk')} {TRAIL} SELECT seq, i, flag, round(thr, 6) AS thr FROM tr",
    "threshold_stability": f"""WITH {ROLLED} {TRAIL}, {bins("tr", 6)} SELECT bin, round(avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END), 6) AS flagged_rate, round(count(*) FILTER (WHERE flag AND label = 1) / greatest(count(*) FILTER (WHERE label = 1), 1), 6) AS recall, round(count(*) FILTER (WHERE flag AND label = 0) / any_value(days), 6) AS fa_per_day, round(median(thr), 6) AS threshold FROM binned GROUP BY bin""",
    "threshold_swing": f"""WITH {FED}, z AS (SELECT quantile_cont(score, 0.98) AS z FROM o WHERE i < 0), tr AS (SELECT o.*, score > z AS flag FROM o, z WHERE i >= 0), {bins("tr", 6)}, b AS (SELECT count(*) FILTER (WHERE flag AND label = 0) / any_value(days) AS fa FROM binned GROUP BY bin) SELECT round(max(fa) / greatest(min(fa), 1.0), 6) AS swing FROM b""",
    "severity_rank": f"WITH {anomalies(200)} SELECT id, round(score, 6) AS score FROM an",
    "dedup": f"WITH {DEDUP} SELECT id, entity, template AS templates, round(score, 6) AS score, dedup_n, first_seq FROM d",
    "correlate": f"WITH {correlated(1800.0, False)} SELECT id, incident_no FROM co",
    "correlate_same_entity": f"WITH {correlated(7200.0, True)} SELECT id, incident_no FROM co",
    "incidents": f"""WITH {INCIDENTS} SELECT id, n_anomalies, CAST(dedup_count AS BIGINT) AS dedup_count, "start", "end", round(peak, 6) AS peak, entities, templates FROM inc JOIN tp USING (incident_no) JOIN ent USING (incident_no)""",
    "incident_segments": f"""WITH {correlated(1800.0, False)}, r AS (SELECT *, row_number() OVER (PARTITION BY incident_no ORDER BY "timestamp", first_seq) - 1 AS place FROM co)
SELECT incident_no, CAST(place // 4 AS BIGINT) AS segment_no, string_agg(id, ' ' ORDER BY place) AS ids, count(*) AS n_anomalies, min("timestamp") AS "start", max("timestamp") AS "end" FROM r GROUP BY ALL""",
    "triage_records": f"""WITH {RECORDS} SELECT row_number() OVER (ORDER BY priority, max_score DESC, incident_no) - 1 AS rank, id, priority, category, n_anomalies, CAST(dedup_count AS BIGINT) AS dedup_count, {shown('"start"')} AS "start", {shown('"end"')} AS "end", max_score FROM rec""",
    "triage_texts": f"""WITH {TEXTS} SELECT rank, id, priority, category, n_anomalies || CASE WHEN n_anomalies = 1 THEN ' anomaly' ELSE ' anomalies' END || ' within ' || printf('%.0f', round_even(span, 0)) || ' s'
  || CASE WHEN n_entities = 1 THEN ' at ' || entities[1] WHEN n_entities > 1 THEN ' at ' || n_entities || ' entities' ELSE '' END || ', mostly ' || category AS summary, {ACTION} AS recommended_action,
  'Stands for ' || dedup_count || ' flagged rows from ' || {shown('"start"')} || ' to ' || {shown('"end"')} || '; highest score ' || printf('%.3f', round_even(peak, 3)) || '; templates: ' || array_to_string(all_templates[1:5], '; ') || CASE WHEN len(all_templates) > 5 THEN '; and more' ELSE '' END AS explanation,
  n_anomalies, dedup_count, {shown('"start"')} AS "start", {shown('"end"')} AS "end", max_score, array_to_string(entities[1:10], ' ') AS entities FROM texts""",
    "incident_drilldown": f"""WITH {RANKED} SELECT rank, id, priority, category, n_anomalies, dedup_count, {shown('"start"')} AS "start", {shown('"end"')} AS "end", max_score FROM ranked WHERE id = 'INC-0001'""",
    "triage_p1": f"WITH {RECORDS} SELECT id, max_score FROM rec WHERE priority = 'P1'",
    "triage_totals": f"WITH {RECORDS} SELECT priority, count(*) AS incidents, CAST(sum(dedup_count) AS BIGINT) AS flags FROM rec GROUP BY priority",
    "categories": f"SELECT {category('lower(text)')} AS category, count(*) AS n FROM documents GROUP BY category",
    "context_lookup": f"""WITH {L}, z AS (SELECT block_id, count(*) AS score FROM l GROUP BY block_id ORDER BY score DESC, block_id LIMIT 50), x AS (SELECT l.*, z.score, row_number() OVER (PARTITION BY block_id ORDER BY line_no, part, event_id, CAST(part AS VARCHAR)) AS r FROM l JOIN z USING (block_id)), f AS (SELECT block_id, event_id, min(r) AS r FROM x GROUP BY ALL), f8 AS (SELECT block_id, string_agg(event_id, ' ' ORDER BY r) AS templates FROM f GROUP BY block_id)
SELECT block_id, any_value(score) AS score, any_value(templates) AS templates, string_agg(CAST(part AS VARCHAR), ' ' ORDER BY r) FILTER (WHERE r <= 4) AS context FROM x JOIN f8 USING (block_id) GROUP BY block_id""",
    "scaler": f"""WITH {T}, w AS (SELECT win, count(*) FILTER (event_id = 'click') AS click, count(*) FILTER (event_id = 'error') AS error, count(*) FILTER (event_id = 'purchase') AS purchase,
  count(*) FILTER (event_id = 'signup') AS signup, count(*) FILTER (event_id = 'view') AS views FROM t GROUP BY win),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([ln(1 + click), ln(1 + error), ln(1 + purchase), ln(1 + signup), ln(1 + views)]) AS z FROM w) SELECT i, round(avg(z), 6) AS mean, round(stddev_pop(z), 6) AS std FROM f GROUP BY i""",
    "masked_templates": r"""WITH x AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT trim(regexp_replace(regexp_replace(line, '[0-9]+', '<*>', 'g'), '\s+', ' ', 'g')) AS template FROM x) SELECT template, count(*) AS n, left(md5(template), 8) AS event_id FROM t GROUP BY template""",
    "stream_windows": f"""WITH {E} SELECT date_trunc('hour', "timestamp") AS "start", count(*) AS n_events, CAST(sum(label) AS BIGINT) AS n_alerts FROM e GROUP BY 1""",
    "stream_sessions": f"""WITH {E}, p AS (SELECT *, lag("timestamp") OVER (ORDER BY "timestamp", seq) AS tb FROM e WHERE label = 1), c AS (SELECT *, sum(CASE WHEN tb IS NULL OR epoch_us("timestamp") - epoch_us(tb) > 1800 * 1000000 THEN 1 ELSE 0 END) OVER (ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS n_anomalies, round(max(coalesce(score, 0.0)), 6) AS peak FROM c GROUP BY g""",
    "stream_threshold": f"WITH {ROLLED} {TRAIL} SELECT seq, i, flag, round(thr, 6) AS thr FROM tr",
    "stream_decay": f"""WITH {T} SELECT a.node, a.seq, round(coalesce(sum(exp(-(a.t_sec - b.t_sec) / 3600.0)), 0), 6) AS excitation FROM t a LEFT JOIN t b ON a.node = b.node AND (b.t_sec, b.seq) < (a.t_sec, a.seq) GROUP BY ALL""",
    "stream_incidents": f"""WITH {E}, p AS (SELECT *, lag("timestamp") OVER w AS tb, lag(node) OVER w AS nb FROM e WHERE label = 1 WINDOW w AS (ORDER BY "timestamp", seq)),
c AS (SELECT *, sum(CASE WHEN tb IS NULL OR nb <> node OR epoch_us("timestamp") - epoch_us(tb) > 7200000000 THEN 1 ELSE 0 END) OVER (ORDER BY "timestamp", seq ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT CAST(g AS BIGINT) AS incident_no, min("timestamp") AS "start", max("timestamp") AS "end", min(node) AS entity, count(*) AS n_anomalies, round(max(coalesce(score, 0.0)), 6) AS peak, arg_min(seq, ("timestamp", seq)) AS first_seq FROM c GROUP BY g""",
    "stream_dedup": f"""WITH {E}, d AS (SELECT *, date_trunc('day', "timestamp") AS "start", coalesce(score, 0.0) AS sc FROM e), r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY "start", node, event_id) AS dedup_n FROM d WINDOW w AS (PARTITION BY "start", node, event_id ORDER BY sc DESC, seq))
SELECT "start", node, event_id, seq, round(sc, 6) AS score, dedup_n FROM r WHERE rn = 1""",
}
