r"""SQL twins of the registered queries, written for DuckDB.

They restate each result in plain SQL, independently of the engine.  RE2's
\d, \s and \b are ASCII, so word characters are spelled [\p{L}\p{N}_].
"""

from __future__ import annotations

# --- Fixed values: patterns that results depend on, restated -----------------------
WORD = r"[\p{L}\p{N}_]"
ISO = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
TIMES = (ISO, rf"\d{{2}}/{WORD}{{3}}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}",
         rf"{WORD}{{3}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}", r"\d{10,13}")
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
PATH = r"(?:/[\p{L}\p{N}_\-.]+)+/?"
HEX = r"\b0x[0-9a-fA-F]+\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
DROPPED = r"[^\p{L}\p{N}_\s\-.:<>\[\]()]"
LEVELS = r"(?i)\b(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\b"
# --- End of the fixed values ---------------------------------------------------------

DOC_SCORE = "(((doc_id * 37) % 1009) / 1009.0::DOUBLE)"


def replace_all(text: str, pairs) -> str:
    for pattern, new in pairs:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def clean(text: str, length: int | None = 512, times=True, ips=True, paths=False, lower=True) -> str:
    pairs = [(p, "<TIMESTAMP>") for p in TIMES] if times else []
    pairs += [(IP, "<IP>")] if ips else []
    pairs += [(PATH, "<PATH>")] if paths else []
    pairs += [(HEX, "<HEX>"), (UUID, "<UUID>"), (r"\s+", " "), (DROPPED, "")]
    out = replace_all(text, pairs)
    if lower:
        out = f"lower({out})"
    if length:
        out = f"substr({out}, 1, {length})"
    return strip(out)


SEVERITY = (
    "CASE event_type WHEN 'view' THEN 'info' WHEN 'click' THEN 'low' WHEN 'signup' THEN 'medium' "
    "WHEN 'purchase' THEN 'high' WHEN 'error' THEN 'critical' END"
)

LINES = f"""lines AS (
  SELECT event_id AS seq, ts, event_type, {SEVERITY} AS severity,
    least(value, 100.0) AS risk_score, 'svc-' || (user_id % 7) AS source,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' ||
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END ||
    ' [svc-' || (user_id % 7) || '] ' || event_type || ' by user ' || user_id || ' props ' || props
      AS raw_text
  FROM events)"""

PARSED = f"""{LINES},
timed AS (SELECT *, strptime(substr(regexp_extract(raw_text, '{ISO}'), 1, 19), '%Y-%m-%dT%H:%M:%S') AS time,
    {strip(f"regexp_replace(raw_text, '{ISO}', '')")} AS rest FROM lines),
leveled AS (SELECT *, upper(regexp_extract(rest, '{LEVELS}')) AS found,
    {strip(f"regexp_replace(rest, '{LEVELS}', '')")} AS message FROM timed),
parsed AS (SELECT *, CASE found WHEN 'WARN' THEN 'WARNING' WHEN '' THEN NULL ELSE found END AS log_level,
    {clean('message')} AS cleaned_text,
    substr(md5(raw_text || strftime(time, '%Y-%m-%d %H:%M:%S')), 1, 12) AS log_id FROM leveled)"""

APACHE, EPOCH = TIMES[1], TIMES[3]
FORMATS = rf"""raw AS (SELECT event_id AS seq, ts, event_id % 7 AS form, md5(event_id::VARCHAR) AS m, strftime(ts, '%d/%b/%Y:%H:%M:%S') AS apache FROM events),
lines AS (SELECT *, CASE form WHEN 0 THEN apache || ' INFO page ' || seq || ' served' WHEN 1 THEN (epoch_us(ts) // 1000000) || ' ERROR job ' || seq
  WHEN 2 THEN 'at ' || (epoch_us(ts) // 1000) || ' warn: job ' || seq WHEN 3 THEN strftime(ts, '%b %d %H:%M:%S') || ' host kernel: [1.5] from 10.0.0.' || seq
  WHEN 4 THEN '2024-13-45T10:00:00Z ' || apache || ' Critical state ' || seq
  WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' debug at 0x' || lower(printf('%X', seq)) || ' for ' ||
    concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12))
  ELSE '[WARNING] disk /dev/sd' || seq || ' at 85%' END AS raw_text FROM raw),
timed AS (SELECT *, CASE WHEN form IN (0, 4) THEN date_trunc('minute', ts) + to_seconds(second(ts) // 10)
    WHEN form IN (1, 2, 5) THEN date_trunc('second', ts) END AS time,
  {strip(f"CASE WHEN form IN (0, 4) THEN regexp_replace(raw_text, '{APACHE}', '') WHEN form IN (1, 2) THEN regexp_replace(raw_text, '{EPOCH}', '') "
         f"WHEN form = 5 THEN regexp_replace(raw_text, '{ISO}', '') ELSE raw_text END")} AS rest FROM lines),
leveled AS (SELECT *, upper(regexp_extract(rest, '{LEVELS}')) AS found, {strip(f"regexp_replace(rest, '{LEVELS}', '')")} AS message FROM timed),
parsed AS (SELECT *, CASE found WHEN 'WARN' THEN 'WARNING' WHEN '' THEN NULL ELSE found END AS log_level, {clean('message', None)} AS cleaned_text,
  substr(md5(raw_text || CASE WHEN time IS NULL THEN 'None' WHEN form = 2 AND epoch_us(ts) // 1000 % 1000 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || printf('.%03d000', epoch_us(ts) // 1000 % 1000)
    ELSE strftime(time, '%Y-%m-%d %H:%M:%S') END), 1, 12) AS log_id FROM leveled)"""

SIEM = f"""siem AS (
  SELECT event_id, event_type, {SEVERITY} AS severity, 'svc-' || (user_id % 7) AS source,
    event_type || ' by user ' || user_id || ' with ' || props AS description,
    'CEF:0|shop|web|1|' || event_id || '|' || event_type || '|5|suser=' || user_id AS raw_log,
    CASE WHEN event_type <> 'signup' THEN least(value, 100.0) ELSE 50.0 END AS risk_score
  FROM events),
labelled AS (SELECT *, severity IN ('high', 'critical', 'emergency') AS is_anomaly FROM siem)"""


def encoded(source: str, key: str, text: str, name: str = "enc", dim: int = 64) -> str:
    """CTEs ending in ``name(key, e DOUBLE[dim])`` for one text column."""
    n = name
    return f"""{n}_words AS (SELECT {key} AS k, unnest(string_split_regex(lower({text}), '\\s+')) AS w FROM {source}),
{n}_counts AS (SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c
  FROM {n}_words WHERE w <> '' GROUP BY 1, 2),
{n}_norms AS (SELECT k, sqrt(sum(c * c)) AS l FROM {n}_counts GROUP BY 1),
{n}_long AS (SELECT k, b, (c / l)::FLOAT::DOUBLE AS x FROM {n}_counts JOIN {n}_norms USING (k)),
{n}_maps AS (SELECT k, map_from_entries(list({{'k': b, 'v': x}})) AS m FROM {n}_long GROUP BY 1),
{n} AS (SELECT {key} AS k, list_transform(range({dim}), lambda i: coalesce(m[i], 0.0))::DOUBLE[{dim}] AS e
  FROM {source} LEFT JOIN {n}_maps ON {key} = {n}_maps.k)"""


VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e FROM embeddings)"


def ranked(cost: str, distance: str, k: int) -> str:
    return f"""WITH {VECTORS},
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {cost} AS cost, {distance} AS distance FROM v a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cost, 9), neighbor_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= {k}"""


SQUARE = "array_distance(a.e, b.e) * array_distance(a.e, b.e)"

NORMALS = """v AS (SELECT vec_id AS seq, printf('v%07d', vec_id) AS id, label, embedding::DOUBLE[64] AS e FROM embeddings),
corpus AS (SELECT * FROM v WHERE label < 8),
pairs AS (SELECT q.seq, c.id, c.seq AS cseq, array_distance(q.e, c.e) * array_distance(q.e, c.e) AS d FROM v q, corpus c),
near AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(d, 9), id) AS rank FROM pairs),
base AS (SELECT seq, round(avg(d), 9) AS mean_distance FROM near
  WHERE rank <= 6 AND d > 0 AND seq IN (SELECT seq FROM corpus) GROUP BY 1)"""


def fitted(percentile: float) -> str:
    return f"""fit AS (SELECT quantile_cont(mean_distance, {percentile}) AS threshold, avg(mean_distance) AS mu,
  stddev_pop(mean_distance) AS sd FROM base)"""


SCORED = """means AS (SELECT seq, round(avg(d), 9) AS m, string_agg(id, ',' ORDER BY rank) AS neighbors,
  avg(d) AS raw_mean FROM near WHERE rank <= 5 GROUP BY 1),
scored AS (SELECT seq, m, neighbors, raw_mean, least(m / (2 * threshold), 1.0) AS score, m > threshold AS is_anomaly,
  least(abs(m - mu) / greatest(sd, 0.01) / 3, 1.0) AS confidence FROM means, fit)"""

UNFITTED = f"""WITH {NORMALS}, means AS (SELECT seq, round(avg(d), 9) AS m FROM near WHERE rank <= 5 GROUP BY 1)
SELECT seq, round(least(m / 0.5, 1.0), 6) AS score, m > 0.5 AS is_anomaly,
  round(least(m / 0.5, 1.0), 6) AS confidence FROM means"""


def band(score: str, low, medium, high, critical, outside) -> str:
    return (
        f"CASE WHEN {score} < 0 THEN '{outside}' WHEN {score} < 0.3 THEN '{low}' WHEN {score} < 0.6 THEN '{medium}' "
        f"WHEN {score} < 0.8 THEN '{high}' WHEN {score} < 1.0 THEN '{critical}' ELSE '{outside}' END"
    )


def band_name(score: str) -> str:
    return band(score, "Low", "Medium", "High", "Critical", "Critical")


def band_text(score: str) -> str:
    return band(
        score,
        "This log shows minor deviation from normal patterns.",
        "This log shows moderate deviation from established patterns.",
        "This log shows significant deviation that warrants investigation.",
        "This log is highly anomalous and requires immediate attention.",
        "Extremely anomalous pattern detected.",
    )


def advice(score: str, text: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    name = band_name(score)
    return f"""concat_ws('|', CASE {name}
  WHEN 'Low' THEN 'Continue monitoring; no immediate action required'
  WHEN 'Medium' THEN 'Monitor for recurring patterns|Add to watchlist for future occurrences'
  ELSE 'Investigate this log immediately|Check related system components|Review recent changes in the affected service' END,
 CASE WHEN contains({t}, 'error') OR contains({t}, 'fail') THEN 'Check error handling and recovery mechanisms' END,
 CASE WHEN contains({t}, 'timeout') THEN 'Review network connectivity and service dependencies' END,
 CASE WHEN contains({t}, 'memory') OR contains({t}, 'cpu') THEN 'Monitor resource utilization trends' END,
 CASE WHEN contains({t}, 'auth') OR contains({t}, 'login') THEN 'Review authentication logs for security concerns' END)"""


EXPLAINED = f"""WITH {NORMALS}, {fitted(0.40)}, {SCORED},
odd AS (SELECT s.*, documents.text, {band_name('score')} AS band, {band_name('score')} || ' severity anomaly detected. ' || {band_text('score')} AS summary
  FROM scored s LEFT JOIN documents ON doc_id = seq WHERE is_anomaly),
alike AS (SELECT near.seq, string_agg(rank || ':' || id || ':' || substr(coalesce(text, 'N/A'), 1, 100), '|' ORDER BY rank) AS alike_logs,
  string_agg('  [' || rank || '] ' || id || ' (dist: ' || printf('%.4f', d) || ')', chr(10) ORDER BY rank) AS listed
  FROM near LEFT JOIN documents ON doc_id = cseq WHERE rank <= 3 GROUP BY 1),
explained AS (SELECT odd.seq, score, summary, 'Severity Level: ' || band AS detail_1,
  'Anomaly Score: ' || printf('%.2f', score * 100) || '%' AS detail_2,
  'Mean Distance to Neighbors: ' || printf('%.4f', raw_mean) AS detail_3, alike_logs, listed,
  {advice('score', 'text')} AS advice FROM odd JOIN alike USING (seq))"""


def window_sql(partition: str, extra: str = "") -> str:
    return f"""WITH s AS (SELECT event_id AS seq, 'svc-' || (user_id % 7) AS source,
  ts - CASE WHEN event_id % 7 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS ts,
  least(value / 193.0, 1.0) AS score FROM events),
w AS (SELECT *, coalesce(avg(score) OVER p, 0) AS m, coalesce(stddev_pop(score) OVER p, 0) AS sd,
  coalesce(min(score) OVER p, 0) AS lo, coalesce(max(score) OVER p, 0) AS hi, count(score) OVER p AS n, max(ts) OVER p AS latest,
  avg(score) OVER r AS recent, count(score) OVER r AS recent_n, avg(score) OVER o AS older, count(score) OVER o AS older_n
  FROM s WINDOW p AS ({partition} ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING),
  r AS ({partition} ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
  o AS ({partition} ORDER BY seq ROWS BETWEEN 99 PRECEDING AND 10 PRECEDING)),
x AS (SELECT *, CASE WHEN latest IS NULL THEN 1.0 ELSE greatest(pow(0.95, (epoch_us(latest) - epoch_us(ts)) / 3600000000.0), 0.1) END AS weight,
  CASE WHEN n > 10 AND sd > 0 THEN score * least(greatest(1 + (score - m) / sd * 0.3, 0.5), 2.0) ELSE score END AS in_context
  FROM w)"""


ADJUSTED = """
SELECT seq, round(m, 6) AS window_mean, round(sd, 6) AS window_std, round(lo, 6) AS window_min, round(hi, 6) AS window_max,
  n AS window_count, round(weight, 6) AS temporal_weight, round(least(in_context * weight, 1.0), 6) AS time_adjusted_score FROM x"""

HYBRID = """r AS (SELECT vec_id AS seq, printf('v%07d', vec_id) AS id, label, embedding::DOUBLE[64] AS e,
  [0.0, 0.0, 0.2, 0.2, 0.4, 0.4, 0.0, 0.2, 0.6, 0.8][label + 1] AS sev, ((vec_id * 37) % 101) / 100.0 AS risk, label < 8 AS normal FROM embeddings),
sc AS (SELECT avg(risk) AS rm, avg(sev) AS sm, stddev_pop(risk) AS rs, stddev_pop(sev) AS ss FROM r WHERE normal),
f AS (SELECT seq, id, normal, list_concat(list_transform(e::DOUBLE[], lambda x: x * 0.6),
  [(risk - rm) / CASE WHEN rs = 0 THEN 1 ELSE rs END * 0.4, (sev - sm) / CASE WHEN ss = 0 THEN 1 ELSE ss END * 0.4])::DOUBLE[66] AS e FROM r, sc)"""

HISTORY = f"""{PARSED},
h AS (SELECT seq, log_id, cleaned_text AS cleaned_log, least(risk_score / 100.0, 1.0) AS score,
  least(risk_score / 100.0, 1.0) > 0.5 AS is_anomaly, ts, event_type FROM parsed),
hist AS (SELECT *, CASE WHEN is_anomaly AND seq % 3 <> 0 THEN {band_name('score')} || ' severity anomaly detected. ' || {band_text('score')} END AS summary FROM h)"""

SHORT = "coalesce(nullif(split_part(summary, '.', 1), ''), 'Anomaly detected')"

DETECTED = f"""{PARSED}, {encoded('parsed', 'seq', 'cleaned_text')},
normal AS (SELECT enc.k AS cseq, enc.e FROM enc JOIN lines ON k = seq WHERE severity NOT IN ('high', 'critical')),
self AS (SELECT q.cseq AS seq, list_filter(min(array_distance(q.e, c.e) * array_distance(q.e, c.e), 6), lambda x: x > 0) AS ds FROM normal q, normal c GROUP BY 1),
base AS (SELECT round(list_avg(ds), 9) AS mean_distance FROM self WHERE len(ds) > 0),
{fitted(0.95)},
found AS (SELECT q.k AS seq, round(list_avg(min(array_distance(q.e, c.e) * array_distance(q.e, c.e), 5)), 9) AS m FROM enc q, normal c GROUP BY 1),
scored AS (SELECT seq, least(m / (2 * threshold), 1.0) AS score, m > threshold AS is_anomaly,
  least(abs(m - mu) / greatest(sd, 0.01) / 3, 1.0) AS confidence FROM found, fit)"""


def quality(counts: str, keys: str = "") -> str:
    return f"""q AS (SELECT {keys} tp, tn, fp, fn, n, (tp + tn) / n::DOUBLE AS accuracy,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM {counts}),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q)"""


CELLS = """count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic = 0 AND quality = 1) AS tn,
  count(*) FILTER (toxic = 0 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality = 1) AS fn, count(*) AS n"""


# The documents hold no time but numbers of 10 to 13 digits, and no level.
_TEXT = "coalesce(text, '')"
_EPOCH_MATCH = f"regexp_extract({_TEXT}, '{EPOCH}')"
_NUMBER = f"nullif({_EPOCH_MATCH}, '')::BIGINT"
DETECTED_TEXTS = clean(
    f"CASE WHEN {_NUMBER} > 1000000000000 OR {_NUMBER} <= 253402300799 THEN {strip(f'regexp_replace({_TEXT}, {chr(39)}{EPOCH}{chr(39)}, {chr(39)}{chr(39)})')} ELSE {_TEXT} END",
    None,
)

HYBRID_DISTANCES = """pairs AS (SELECT q.seq, q.normal, array_distance(q.e, c.e) AS d, c.id FROM f q, f c WHERE c.normal),
near AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(d, 9), id) AS rank FROM pairs),
means AS (SELECT seq, normal, round(avg(d), 9) AS m FROM near WHERE rank BETWEEN 2 AND 6 GROUP BY 1, 2),
fit AS (SELECT avg(m) AS mu, stddev_pop(m) AS sd FROM means WHERE normal),
far AS (SELECT seq, m, (m - mu) / greatest(sd, 0.01) AS z FROM means, fit)"""


def registry() -> dict[str, str]:
    from workload import forest_oracle  # it builds on the pieces above

    two_pi = "2 * pi()"
    features = (
        "[hour(ts) / 24.0, minute(ts) / 60.0, (isodow(ts) - 1) / 7.0, day(ts) / 31.0, month(ts) / 12.0, "
        f"sin({two_pi} * hour(ts) / 24), cos({two_pi} * hour(ts) / 24), "
        f"sin({two_pi} * (isodow(ts) - 1) / 7), cos({two_pi} * (isodow(ts) - 1) / 7), 0, 0, 0, 0, 0, 0, 0]::DOUBLE[]"
    )
    out = {
        "parse_event_logs": f"""WITH {PARSED} SELECT seq, strftime(time, '%Y-%m-%d %H:%M:%S') AS ts_text, log_level, message, cleaned_text,
  log_id, length(raw_text) AS original_length, length(cleaned_text) AS cleaned_length FROM parsed""",
        "level_counts": f"WITH {PARSED} SELECT source, log_level, count(*) AS n FROM parsed GROUP BY ALL",
        "clean_documents": f"""WITH c AS (SELECT doc_id, {clean('text')} AS cleaned_text, {clean('text', None)} AS whole FROM documents)
SELECT doc_id, cleaned_text, md5(whole) AS whole_md5, length(whole) AS whole_length FROM c""",
        "mask_paths": f"""SELECT page_id, {clean('url', None, times=False, ips=False, paths=True, lower=False)} AS cleaned_url FROM pages""",
        "document_inputs": """SELECT doc_id, md5(coalesce(text, '')) AS text_md5, md5(CASE quality WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE '' END) AS severity_md5,
  CASE WHEN toxic = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS risk, CASE quality WHEN 0 THEN 0.6 WHEN 1 THEN 0.2 ELSE 0.0 END::DOUBLE AS severity_weight,
  CASE quality WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS severity FROM documents LEFT JOIN labels USING (doc_id)""",
        "log_file_scan": f"WITH {PARSED} SELECT raw_text, 'events.log' AS source, log_level, log_id FROM parsed",
        "csv_scan": f"WITH {LINES} SELECT seq, raw_text, source, event_type, severity, risk_score FROM lines",
        "json_scan": f"WITH {SIEM} SELECT event_id, severity, risk_score, is_anomaly FROM labelled",
        "siem_labels": f"""WITH {SIEM} SELECT event_id, severity, risk_score, is_anomaly,
  CASE severity WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 5 END AS severity_number,
  CASE severity WHEN 'info' THEN 0.0 WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.4 WHEN 'high' THEN 0.6 WHEN 'critical' THEN 0.8 ELSE 1.0 END::DOUBLE AS severity_weight FROM labelled""",
        "siem_split": f"WITH {SIEM} SELECT event_id, description, CASE WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS part FROM labelled",
        "siem_metadata": f"WITH {SIEM} SELECT event_id, event_type, severity, source, risk_score, is_anomaly, substr(description, 1, 200) AS description FROM labelled",
        "siem_texts": f"WITH {SIEM} SELECT 'description' AS kind, description AS value FROM siem UNION ALL SELECT 'raw_log', raw_log FROM siem",
        "siem_totals": f"""WITH {SIEM} SELECT count(*) AS total_records, count(*) FILTER (is_anomaly) AS anomaly_count,
  count(*) FILTER (NOT is_anomaly) AS normal_count, round(avg(risk_score), 6) AS avg_risk_score FROM labelled""",
        "siem_stats_by_type": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
        "siem_stats_by_severity": f"WITH {SIEM} SELECT severity, count(*) AS n FROM siem GROUP BY 1",
        "hash_encode_documents": f"""WITH c AS (SELECT doc_id, {clean('text', None)} AS t FROM documents), {encoded('c', 'doc_id', 't')}
SELECT k AS doc_id, 'token-hash' AS model_name, 64 AS embedding_dim, b::INTEGER AS bucket, round(x, 6) AS weight FROM enc_long WHERE x > 0""",
        "knn_l2": ranked(SQUARE, SQUARE, 6),
        "knn_euclid": ranked("array_distance(a.e, b.e)", "array_distance(a.e, b.e)", 6),
        "knn_ip": ranked("-array_inner_product(a.e, b.e)", "array_inner_product(a.e, b.e)", 6),
        "knn_ivf_all_cells": ranked(SQUARE, SQUARE, 5),
        "neighborhood_stats": f"""WITH n AS ({ranked(SQUARE, SQUARE, 5).replace('round(distance, 6) AS distance', 'distance')})
SELECT query_id, count(*) AS num_neighbors, round(avg(distance), 6) AS mean_distance, round(stddev_pop(distance), 6) AS std_distance,
  round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance FROM n GROUP BY 1""",
        "text_search": f"""WITH c AS (SELECT doc_id, source, {clean('text', None)} AS t FROM documents), {encoded('c', 'doc_id', 't', 'docs')},
p AS (SELECT item_id, {clean('text', None)} AS t FROM benchmark), {encoded('p', 'item_id', 't', 'items')},
d AS (SELECT a.k AS query_id, b.k AS neighbor_id, {SQUARE} AS distance FROM items a, docs b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM d),
n AS (SELECT * FROM r WHERE rank <= 5)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance, source,
  round(avg(distance) OVER q, 6) AS mean_distance, round(min(distance) OVER q, 6) AS min_distance, round(max(distance) OVER q, 6) AS max_distance
FROM n JOIN documents ON doc_id = neighbor_id WINDOW q AS (PARTITION BY query_id)""",
        "label_similarity": f"""WITH {VECTORS}, l AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2),
means AS (SELECT label, list(m ORDER BY i)::DOUBLE[64] AS e FROM l GROUP BY 1)
SELECT v.vec_id, means.label, round(array_cosine_similarity(v.e, means.e), 6) AS similarity FROM v JOIN means USING (label)""",
        "neighbor_cosine": f"""WITH n AS ({ranked(SQUARE, SQUARE, 2)}), {VECTORS}
SELECT query_id AS left_id, neighbor_id AS right_id, round(array_cosine_similarity(a.e, b.e), 6) AS similarity
FROM n JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = neighbor_id""",
        "normalized_vectors": f"""WITH {VECTORS} SELECT vec_id, (i - 1)::INTEGER AS pos,
  round(e[i] / sqrt(array_inner_product(e, e)), 6) AS x FROM v, range(1, 65) t(i)""",
        "corpus_latest": """WITH a AS (SELECT vec_id AS seq, 'id-' || (vec_id % 90) AS id, embedding, label::VARCHAR AS label, vec_id * 60 AS at_s FROM embeddings WHERE label < 6
  UNION ALL SELECT vec_id + 1000000, 'id-' || (vec_id % 90), embedding, NULL, NULL FROM embeddings WHERE label >= 6)
SELECT id, round(list_sum(arg_max(embedding, seq)::DOUBLE[]), 6) AS embedding_sum, arg_max(label, seq) FILTER (label IS NOT NULL) AS label,
  strftime(make_timestamp(arg_max(at_s, seq) FILTER (at_s IS NOT NULL) * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM a GROUP BY 1""",
        "corpus_stats": """SELECT count(*) AS total_vectors, max(len(embedding))::INTEGER AS embedding_dim, 'Flat' AS index_type,
  TRUE AS is_trained, bool_or(label < 6) AS has_metadata, bool_or(label < 6) AS has_timestamps FROM embeddings""",
        "baseline_distances": f"WITH {NORMALS} SELECT seq AS query_id, round(mean_distance, 6) AS mean_distance FROM base",
        "baseline_threshold": f"""WITH {NORMALS}, {fitted(0.95)} SELECT round(threshold, 6) AS threshold, round(mu, 6) AS mean, round(sd, 6) AS std FROM fit""",
        "anomaly_scores": f"""WITH {NORMALS}, {fitted(0.95)}, {SCORED} SELECT seq, round(m, 6) AS mean_distance, round(score, 6) AS score, is_anomaly,
  round(confidence, 6) AS confidence, neighbors FROM scored""",
        "reloaded_scores": f"""WITH {NORMALS}, {fitted(0.95)}, {SCORED} SELECT seq, round(score, 6) AS score, is_anomaly, round(confidence, 6) AS confidence FROM scored""",
        "unfitted_scores": UNFITTED,
        "sure_anomalies": f"""WITH {NORMALS}, {fitted(0.95)}, {SCORED} SELECT seq, round(score, 6) AS score, round(confidence, 6) AS confidence FROM scored
  WHERE is_anomaly AND confidence >= 0.3""",
        "time_adjusted_scores": window_sql("PARTITION BY source") + ADJUSTED,
        "time_adjusted_scores_global": window_sql("") + ADJUSTED,
        "burst_flags": window_sql("PARTITION BY source")
        + "SELECT seq, source, coalesce(recent_n >= 10 AND older_n >= 5 AND recent > 1.2 * older, FALSE) AS is_burst FROM w",
        "score_windows": window_sql("PARTITION BY source")
        + """, z AS (SELECT seq, count(*) OVER t AS window_rows, first_value(ts) OVER t AS first_ts, ts AS last_ts, sum(score) OVER t AS score_sum
  FROM s WINDOW t AS (PARTITION BY source ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT seq, window_rows::INTEGER AS window_rows, strftime(first_ts, '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
  strftime(last_ts, '%Y-%m-%d %H:%M:%S.%f') AS last_ts, round(score_sum, 6) AS score_sum FROM z""",
        "temporal_features": f"""WITH t AS (SELECT event_id, {features} AS f FROM events)
SELECT event_id, (i - 1)::INTEGER AS pos, round(f[i], 6) AS x FROM t, range(1, 17) r(i)""",
        "augmented_vectors": f"""WITH t AS (SELECT event_id, vec_id, list_concat(embedding::DOUBLE[], {features}) AS f FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings))
SELECT event_id, vec_id, len(f)::INTEGER AS dim, round(list_sum(f), 6) AS total, round(f[65], 6) AS hour_share FROM t""",
        "score_bands": f"""WITH s AS (SELECT event_id, value / 100.0 - 0.05 AS s FROM events) SELECT event_id, {band_name('s')} AS band, {band_text('s')} AS sentence,
  CASE WHEN s > 0.7 THEN 'CRITICAL' WHEN s > 0.4 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS display,
  CASE WHEN s > 0.7 THEN 'Critical' ELSE 'High' END AS alert FROM s""",
        "recommendations": f"SELECT doc_id, {advice('((doc_id % 100) / 100.0)', 'text')} AS advice FROM documents",
        "explanations": EXPLAINED + " SELECT seq, summary, detail_1, detail_2, detail_3, alike_logs AS \"similar\", advice FROM explained",
        "reports": EXPLAINED
        + """ SELECT seq, concat_ws(chr(10), '╔══ ANOMALY REPORT ══╗', 'Log ID: ' || printf('v%07d', seq), 'Score: ' || printf('%.2f', score * 100) || '%',
  chr(10) || summary, chr(10) || '--- Details ---', '  • ' || detail_1, '  • ' || detail_2, '  • ' || detail_3,
  chr(10) || '--- Similar Logs ---', listed, chr(10) || '--- Recommendations ---',
  '  → ' || replace(advice, '|', chr(10) || '  → '), '╚════════════════════╝') AS report FROM explained""",
        "hybrid_features": f"WITH {HYBRID} SELECT seq, (i - 1)::INTEGER AS pos, round(e[i], 6) AS x FROM f, range(1, 67) t(i)",
        "hybrid_distance_scores": f"""WITH {HYBRID}, {HYBRID_DISTANCES}
SELECT seq, round(m, 6) AS mean_distance, round(z, 6) AS distance_score FROM far""",
        "scored_table_metrics": f"""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND p) AS tp, count(*) FILTER (toxic = 0 AND NOT p) AS tn, count(*) FILTER (toxic = 0 AND p) AS fp,
  count(*) FILTER (toxic = 1 AND NOT p) AS fn, count(toxic) AS n, count(*) - count(toxic) AS unlabelled FROM (SELECT toxic, {DOC_SCORE} > 0.7 AS p FROM documents LEFT JOIN labels USING (doc_id))), {quality('c', 'unlabelled,')}
SELECT tp, tn, fp, fn, n, unlabelled, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1""",
        "scored_table_top": f"""SELECT doc_id AS seq, round({DOC_SCORE}, 6) AS anomaly_score, substr(text, 1, 100) AS text FROM documents WHERE {DOC_SCORE} > 0.7 ORDER BY {DOC_SCORE} DESC, doc_id LIMIT 5""",
        "scored_table_anomalies": f"SELECT doc_id AS seq, round({DOC_SCORE}, 6) AS anomaly_score, md5(text) AS text_md5 FROM documents WHERE {DOC_SCORE} > 0.7",
        "scored_table_csv": f"""SELECT md5(text) AS text_md5, toxic, round({DOC_SCORE}, 6) AS anomaly_score, {DOC_SCORE} > 0.7 AS is_anomaly_pred
FROM documents LEFT JOIN labels USING (doc_id)""",
        "hybrid_scores_given_forest": f"""WITH {SIEM}, z AS (SELECT event_id, is_anomaly, (risk_score / 10 - 4) / 2.5 AS z, (event_id % 41) / 40.0 - 0.3 AS f FROM labelled)
SELECT event_id, round(least(greatest(least(z / 3, 1), 0) * 0.5 + greatest(least(0.5 - f, 1), 0) * 0.5, 1), 6) AS score,
  f < 0 OR z > 2 OR is_anomaly AS flag FROM z""",
        "json_folder_scan": f"WITH {SIEM} SELECT event_id, severity FROM siem",
        "label_quality": f"""WITH c AS (SELECT {CELLS} FROM labels), {quality('c')}
SELECT tp, tn, fp, fn, n, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1""",
        "quality_by_source": f"""WITH c AS (SELECT source, {CELLS} FROM labels JOIN documents USING (doc_id) GROUP BY 1), {quality('c', 'source,')}
SELECT source, tp, tn, fp, fn, n, round(f1, 6) AS f1 FROM f1""",
        "detection_rates": f"""WITH {SIEM} SELECT is_anomaly, count(*) AS n, count(*) FILTER (risk_score > 40) AS flagged,
  round(avg((risk_score > 40)::INTEGER), 6) AS rate FROM labelled GROUP BY 1""",
        "first_of_class_rates": f"""WITH {SIEM}, o AS (SELECT *, row_number() OVER (PARTITION BY is_anomaly ORDER BY event_id) AS rank FROM labelled),
c AS (SELECT count(*) FILTER (NOT is_anomaly AND risk_score <= 40) AS tn, count(*) FILTER (is_anomaly AND risk_score > 40) AS tp,
  count(*) FILTER (NOT is_anomaly) AS n, count(*) FILTER (is_anomaly) AS p FROM o)
SELECT tn AS true_negatives, tp AS true_positives, round(tn / n::DOUBLE, 6) AS tnr, round(tp / p::DOUBLE, 6) AS tpr, round((tn + tp) / (n + p)::DOUBLE, 6) AS accuracy FROM c""",
        "history_status": """SELECT TRUE AS is_fitted, (SELECT count(*) FROM embeddings WHERE label < 8) AS vector_db_size, (SELECT count(*) FROM events) AS history_count""",
        "history_rate": f"""WITH {HISTORY} SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, round(count(*) FILTER (is_anomaly) / count(*)::DOUBLE, 6) AS rate FROM hist""",
        "recent_history": f"WITH {HISTORY} SELECT seq, log_id, round(score, 6) AS score, is_anomaly FROM hist ORDER BY seq DESC LIMIT 50",
        "recent_alerts": f"""WITH {HISTORY}, last AS (SELECT * FROM hist ORDER BY seq DESC LIMIT 50)
SELECT seq, substr(log_id, 1, 8) || '...' AS short_id, printf('%.0f', score * 100) || '%' AS score_text,
  CASE WHEN score > 0.7 THEN 'Critical' ELSE 'High' END AS severity, {SHORT} AS summary FROM last WHERE is_anomaly ORDER BY seq DESC LIMIT 5""",
        "all_alerts": f"""WITH {HISTORY} SELECT seq, substr(log_id, 1, 8) || '...' AS short_id, CASE WHEN score > 0.7 THEN 'Critical' ELSE 'High' END AS severity,
  {SHORT} AS summary FROM hist WHERE is_anomaly""",
        "detection_responses": f"WITH {HISTORY} SELECT seq, log_id, cleaned_log, round(score, 6) AS score, is_anomaly, 0.5::DOUBLE AS confidence, summary FROM hist",
        "anomaly_trend": f"""WITH {HISTORY} SELECT strftime(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S.%f') AS bucket_start,
  count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies FROM hist GROUP BY 1""",
        "alerts_by_category": f"""WITH {HISTORY} SELECT event_type, count(*) AS alerts, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM hist WHERE is_anomaly GROUP BY 1""",
        "appended_history": f"WITH {HISTORY} SELECT seq, log_id, round(score, 6) AS score, is_anomaly FROM hist",
        "detect_event_logs": f"""WITH {DETECTED},
s AS (SELECT seq, source, parsed.time AS ts, log_id, score, is_anomaly, confidence FROM scored JOIN parsed USING (seq)),
w AS (SELECT *, coalesce(avg(score) OVER p, 0) AS m, coalesce(stddev_pop(score) OVER p, 0) AS sd, count(score) OVER p AS n, max(ts) OVER p AS latest
  FROM s WINDOW p AS (PARTITION BY source ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, CASE WHEN latest IS NULL THEN 1.0 ELSE greatest(pow(0.95, (epoch_us(latest) - epoch_us(ts)) / 3600000000.0), 0.1) END AS weight,
  CASE WHEN n > 10 AND sd > 0 THEN score * least(greatest(1 + (score - m) / sd * 0.3, 0.5), 2.0) ELSE score END AS in_context FROM w),
y AS (SELECT *, least(in_context * weight, 1.0) AS adjusted FROM x)
SELECT seq, log_id, round(adjusted, 6) AS score, round(score, 6) AS original_score, round(weight, 6) AS weight, is_anomaly,
  round(confidence, 6) AS confidence,
  CASE WHEN is_anomaly THEN {band_name('adjusted')} || ' severity anomaly detected. ' || {band_text('adjusted')} END AS summary FROM y""",
        "stream_parse": f"""WITH {PARSED} SELECT seq, strftime(time, '%Y-%m-%d %H:%M:%S') AS ts_text, log_level, message, cleaned_text,
  log_id, length(raw_text) AS original_length, length(cleaned_text) AS cleaned_length FROM parsed""",
        "stream_scores": f"WITH {DETECTED} SELECT seq, round(score, 6) AS score, is_anomaly, round(confidence, 6) AS confidence FROM scored",
        "stream_windows": window_sql("PARTITION BY source")
        + """SELECT seq, round(weight, 6) AS temporal_weight, round(least(in_context * weight, 1.0), 6) AS time_adjusted_score,
  coalesce(recent_n >= 10 AND older_n >= 5 AND recent > 2.0 * older, FALSE) AS is_burst FROM x""",
        "stream_trend": """WITH s AS (SELECT ts - CASE WHEN event_id % 7 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS ts, value > 60 AS odd FROM events),
b AS (SELECT time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS b, count(*) AS total, count(*) FILTER (odd) AS anomalies FROM s GROUP BY 1)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS bucket_start, total, anomalies FROM b""",
        "stream_alert_rate": """SELECT count(*) AS total, count(*) FILTER (value > 60) AS anomalies, round(count(*) FILTER (value > 60) / count(*)::DOUBLE, 6) AS rate,
  count(*) FILTER (value > 60) AS stored_alerts FROM events""",
    }
    out["line_formats"] = f"""WITH {FORMATS} SELECT seq, strftime(time, '%Y-%m-%d %H:%M:%S') AS ts_text, log_level, message, cleaned_text,
  log_id, length(raw_text) AS original_length, length(cleaned_text) AS cleaned_length FROM parsed"""
    out["knn_two_levels"] = f"""WITH {VECTORS}, l AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2),
cells AS MATERIALIZED (SELECT label % 5 AS node, label, 2 * (label % 5) + label // 5 AS cell, list(m ORDER BY i)::DOUBLE[64] AS e FROM l GROUP BY 2),
g AS (SELECT label % 5 AS node, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT node, list(m ORDER BY i)::DOUBLE[64] AS e FROM g GROUP BY 1),
routed AS MATERIALIZED (SELECT vec_id, node, row_number() OVER (PARTITION BY vec_id ORDER BY array_distance(v.e, nodes.e), node) AS place FROM v, nodes),
homes AS MATERIALIZED (SELECT vec_id, arg_min(cell, array_distance(v.e, cells.e)) AS cell FROM v JOIN routed USING (vec_id) JOIN cells USING (node) WHERE place = 1 GROUP BY 1),
asked AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY array_distance(v.e, cells.e), cell) AS place
  FROM v JOIN routed USING (vec_id) JOIN cells USING (node) WHERE routed.place <= 3 AND cell IN (SELECT cell FROM homes)),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {SQUARE} AS distance
  FROM asked JOIN homes USING (cell) JOIN v a ON a.vec_id = asked.vec_id JOIN v b ON b.vec_id = homes.vec_id WHERE place <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 5"""
    out["knn_label_cells"] = f"""WITH {VECTORS}, l AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY 1, 2),
means AS (SELECT label AS cell, list(m ORDER BY i)::DOUBLE[64] AS e FROM l GROUP BY 1),
homes AS (SELECT vec_id, arg_min(cell, array_distance(v.e, means.e)) AS cell FROM v, means GROUP BY 1),
near AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY array_distance(v.e, means.e), cell) AS place
  FROM v, means WHERE cell IN (SELECT cell FROM homes)),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, {SQUARE} AS distance
  FROM near JOIN homes USING (cell) JOIN v a ON a.vec_id = near.vec_id JOIN v b ON b.vec_id = homes.vec_id WHERE place <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM d)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 5"""
    out["reloaded_hybrid_scores"] = out["stream_hybrid_scores"] = out["hybrid_distance_scores"]
    out["isolation_forest_counts"] = """SELECT 100::BIGINT AS trees, 0::BIGINT AS broken_trees, 0::BIGINT AS oversized_trees,
  count(*) AS scored, ceil((count(*) - 1) / 10)::BIGINT AS flagged FROM embeddings"""
    out["detected_responses"] = (
        f"SELECT seq, log_id, score, is_anomaly, confidence, 3::INTEGER AS neighbors, summary FROM ({out['detect_event_logs']})"
    )
    out["corpus_lookup"] = (
        f"SELECT * FROM ({out['corpus_latest']}) WHERE id IN (SELECT 'id-' || doc_id FROM labels)"
    )
    out["stream_detect"] = (
        f"SELECT seq, log_id, score, original_score, weight, is_anomaly, confidence FROM ({out['detect_event_logs']})"
    )
    out["stream_keyed_detect"], out["stream_keyed_windows"] = out["stream_detect"], out["stream_windows"]
    out["stream_event_trend"] = out["stream_trend"]
    out["similar_vectors"] = """WITH u AS MATERIALIZED (SELECT min(vec_id) AS id, count(*) AS n, any_value(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))))::DOUBLE[64]) AS e FROM embeddings GROUP BY embedding)
SELECT a.id AS left_id, b.id AS right_id, round(array_inner_product(a.e, b.e), 6) AS similarity, a.n AS left_rows, b.n AS right_rows
FROM u a JOIN u b ON a.id < b.id WHERE round(array_inner_product(a.e, b.e), 9) >= 0.3"""
    out["grown_scores"] = f"""WITH {NORMALS}, {fitted(0.95)}, {SCORED} SELECT seq, round(m, 6) AS mean_distance, round(score, 6) AS score, is_anomaly,
  round(confidence, 6) AS confidence FROM scored"""
    products = NORMALS.replace(
        "array_distance(q.e, c.e) * array_distance(q.e, c.e) AS d", "array_inner_product(q.e, c.e) AS d"
    ).replace("round(d, 9), id", "round(-d, 9), id")
    out["anomaly_scores_ip"] = f"""WITH {products}, {fitted(0.95)}, {SCORED.replace("rank <= 5", "rank <= 5 AND d >= 0")}
SELECT seq, round(m, 6) AS mean_distance, round(score, 6) AS score, is_anomaly, round(confidence, 6) AS confidence FROM scored"""
    out["model_encode_documents"] = f"""WITH c AS (SELECT doc_id, {clean('text', None)} AS t FROM documents),
words AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, ' ')) AS w FROM c) WHERE w <> '' GROUP BY ALL),
digits AS (SELECT w, md5('0:' || w) || md5('1:' || w) || md5('2:' || w) AS h FROM (SELECT DISTINCT w FROM words)),
signs AS MATERIALIZED (SELECT w, i, 2 * (('0x' || h[i // 4 + 1])::INTEGER >> (3 - i % 4) & 1) - 1 AS s FROM digits, range(384) r(i)),
sums AS MATERIALIZED (SELECT doc_id, i, sum(n * s)::DOUBLE AS x FROM words JOIN signs USING (w) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(x * x)) AS l FROM sums GROUP BY 1),
unit AS (SELECT doc_id, i, (x / CASE WHEN l = 0 THEN 1 ELSE l END)::FLOAT::DOUBLE AS x FROM sums JOIN norms USING (doc_id))
SELECT c.doc_id, 'word-signs' AS model_name, 384 AS embedding_dim, 384 AS "values", round(coalesce(max(x) FILTER (i = 0), 0), 5) AS "first",
  round(coalesce(max(x) FILTER (i = 383), 0), 5) AS "last", round(coalesce(sum(x * (i + 1)), 0), 3) AS weighted
FROM c LEFT JOIN unit USING (doc_id) GROUP BY 1"""
    return {**out, **forest_oracle.registry()}
