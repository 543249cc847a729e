"""SQL that grows and asks the hash-drawn forest, and the hybrid results that rest on it."""

from __future__ import annotations

from workload.oracles import DETECTED_TEXTS, HYBRID, HYBRID_DISTANCES, PARSED, band_name, band_text, clean, encoded, quality

EULER = "0.5772156649015329"
PRIME = 2147483647


def path_length(n: str) -> str:
    return f"""CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE
  ELSE 2 * (ln({n} - 1) + {EULER}::DOUBLE) - 2 * ({n} - 1) / {n}::DOUBLE END"""


def number(text: str, at: int, digits: int) -> str:
    return f"('0x' || substr(md5({text}), {at}, {digits}))::BIGINT"


def forest(rows: str, training: str, dim: int, seed: int = 42, trees: int = 100, sample: int = 256, share: str = "0.1") -> str:
    """CTEs ending in ``decided(id, decision)`` for ``rows(id, e)``, grown from ``training(id, e)``."""
    steps = [
        f"ft AS MATERIALIZED (SELECT id, e FROM {training})",
        f"""size AS (SELECT least({sample}, count(*)) AS n, ceil(log2(greatest(least({sample}, count(*)), 2)))::INTEGER AS depth FROM ft)""",
        f"""factors AS (SELECT t, 1 + {number(f"'{seed}:' || t", 1, 8)} % {PRIME - 1} AS a, {number(f"'{seed}:' || t", 9, 8)} % {PRIME} AS b FROM range({trees}) r(t))""",
        f"""keyed AS (SELECT t, id, row_number() OVER (PARTITION BY t ORDER BY (a * ({number('id::VARCHAR', 1, 8)} % {PRIME}) + b) % {PRIME}, id) AS place FROM ft, factors)""",
        f"""n0 AS MATERIALIZED (SELECT t, id, 1::BIGINT AS node FROM keyed WHERE place <= {sample})""",
    ]
    node = f"'{seed}:' || t || ':' || node"
    for level in range(8):
        steps += [
            f"""s{level} AS (SELECT t, node, i, min(e[i]) AS lo, max(e[i]) AS hi FROM n{level} JOIN ft USING (id), range(1, {dim} + 1) r(i)
  GROUP BY t, node, i HAVING max(e[i]) > min(e[i]))""",
            f"""c{level} AS (SELECT *, row_number() OVER (PARTITION BY t, node ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY t, node) AS varied FROM s{level})""",
            f"""k{level} AS MATERIALIZED (SELECT t, node, i, lo + {number(node, 9, 13)}::DOUBLE / 4503599627370496::DOUBLE * (hi - lo) AS cut
  FROM c{level}, size WHERE place = {number(node, 1, 8)} % varied AND {level} < depth)""",
            f"""n{level + 1} AS MATERIALIZED (SELECT t, id, 2 * node + CASE WHEN e[i] <= cut THEN 0 ELSE 1 END AS node
  FROM n{level} JOIN k{level} USING (t, node) JOIN ft USING (id))""",
        ]
    splits = " UNION ALL ".join(f"SELECT t, node, i, cut FROM k{level}" for level in range(8))
    counts = " UNION ALL ".join(f"SELECT t, node, {level} AS level, count(*) AS n FROM n{level} GROUP BY t, node" for level in range(9))
    steps += [
        f"splits AS MATERIALIZED ({splits})",
        f"leaves AS MATERIALIZED (SELECT t, node, level + {path_length('n')} AS path FROM ({counts}) LEFT JOIN splits USING (t, node) WHERE cut IS NULL)",
        f"fr AS MATERIALIZED (SELECT id, e FROM {rows})",
        f"w0 AS (SELECT id, e, t, 1::BIGINT AS node FROM fr, range({trees}) r(t))",
    ]
    for level in range(8):
        steps.append(
            f"""w{level + 1} AS (SELECT id, e, t, CASE WHEN cut IS NULL THEN node WHEN e[i] <= cut THEN 2 * node ELSE 2 * node + 1 END AS node
  FROM w{level} LEFT JOIN splits USING (t, node))"""
        )
    steps += [
        f"""iso AS MATERIALIZED (SELECT id, round(-pow(2.0, -(sum(path) / {trees}) / any_value(usual)), 9) AS score
  FROM w8 JOIN leaves USING (t, node), (SELECT {path_length('n')} AS usual FROM size) GROUP BY id)""",
        f"""cutoff AS (SELECT quantile_cont(score, {share}) AS offset_ FROM iso WHERE id IN (SELECT id FROM ft))""",
        "decided AS (SELECT id, score - offset_ AS decision FROM iso, cutoff)",
    ]
    return ",\n".join(steps)


VECTOR_FOREST = forest("(SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)",
                       "(SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)", 64)

HYBRID_FOREST = forest("(SELECT seq AS id, e::DOUBLE[] AS e FROM f)", "(SELECT seq AS id, e::DOUBLE[] AS e FROM f WHERE normal)", 66)

FINAL = """least(greatest(least(z / 3, 1), 0) * 0.5 + greatest(least(0.5 - decision, 1), 0) * 0.5, 1)"""


def text_records(texts: str, weight: float, options: str, rows: str) -> str:
    """CTEs ending in ``judged(seq, z, decision, score, flag)`` for ``texts`` (CTEs with ``enc(k, e)``) and ``rows(seq, normal, risk, sev, odd)``."""
    return f"""{texts}, r AS ({rows}),
sc AS (SELECT avg(risk) AS rm, avg(sev) AS sm, stddev_pop(risk) AS rs, stddev_pop(sev) AS ss FROM r WHERE normal),
f AS MATERIALIZED (SELECT seq, normal, odd, list_concat(list_transform(enc.e::DOUBLE[], lambda x: x * {weight}::DOUBLE),
  [(risk - rm) / CASE WHEN rs = 0 THEN 1 ELSE rs END * (1 - {weight}::DOUBLE), (sev - sm) / CASE WHEN ss = 0 THEN 1 ELSE ss END * (1 - {weight}::DOUBLE)])::DOUBLE[66] AS e
  FROM r JOIN enc ON k = seq, sc),
apart AS MATERIALIZED (SELECT e, min(seq) AS seq FROM f GROUP BY e),
kept AS MATERIALIZED (SELECT e, seq, row_number() OVER (PARTITION BY e ORDER BY seq) AS copy FROM f WHERE normal),
near AS (SELECT q.seq, min(array_distance(q.e, c.e), 6) AS ds FROM apart q, kept c WHERE copy <= 6 GROUP BY 1),
means AS (SELECT f.seq, normal, round(list_avg(ds[2:6]), 9) AS m FROM f JOIN apart USING (e) JOIN near ON near.seq = apart.seq),
fit AS (SELECT avg(m) AS mu, stddev_pop(m) AS sd FROM means WHERE normal),
far AS (SELECT seq, (m - mu) / greatest(sd, 0.01) AS z FROM means, fit),
{options},
judged AS (SELECT f.seq, z, decision, {FINAL} AS score, coalesce(decision < 0 OR z > 2 OR odd, FALSE) AS flag
  FROM f JOIN far USING (seq) JOIN decided ON id = f.seq)"""


LOG_RECORDS = text_records(
    f"{PARSED}, {encoded('parsed', 'seq', 'cleaned_text')}", 0.6, HYBRID_FOREST,
    """SELECT seq, severity NOT IN ('high', 'critical') AS normal, risk_score / 100.0 AS risk, severity IN ('high', 'critical') AS odd,
  CASE severity WHEN 'low' THEN 0.2 WHEN 'medium' THEN 0.4 WHEN 'high' THEN 0.6 WHEN 'critical' THEN 0.8 ELSE 0.0 END::DOUBLE AS sev FROM parsed""",
)

DOCUMENT_RECORDS = text_records(
    f"""d AS (SELECT doc_id AS seq, {DETECTED_TEXTS} AS t, toxic FROM documents LEFT JOIN labels USING (doc_id)), {encoded('d', 'seq', 't')}""",
    0.6, HYBRID_FOREST,
    """SELECT seq, coalesce(toxic = 0, FALSE) AS normal, CASE WHEN toxic = 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS risk, FALSE AS odd, 0.0::DOUBLE AS sev FROM d""",
)


def registry() -> dict[str, str]:
    return {
        "isolation_forest": f"""WITH {VECTOR_FOREST} SELECT id, round(decision, 6) AS decision, decision < 0 AS is_outlier FROM decided""",
        "hybrid_detect": f"""WITH {HYBRID}, {HYBRID_FOREST}, {HYBRID_DISTANCES}
SELECT far.seq, round({FINAL}, 6) AS score, decision < 0 OR z > 2 OR label >= 8 AS is_anomaly, round(z, 6) AS distance_score, round(decision, 6) AS iso_score
FROM far JOIN decided ON id = far.seq JOIN r ON r.seq = far.seq""",
        "hybrid_log_detect": f"""WITH {LOG_RECORDS} SELECT seq, log_id, round(score, 6) AS score, flag AS is_anomaly, 0.5::DOUBLE AS confidence, 3::INTEGER AS neighbors,
  CASE WHEN flag THEN {band_name('score')} || ' severity anomaly detected. ' || {band_text('score')} END AS summary FROM judged JOIN parsed USING (seq)""",
        "document_table_scores": f"""WITH {DOCUMENT_RECORDS},
c AS (SELECT count(*) FILTER (toxic = 1 AND flag) AS tp, count(*) FILTER (toxic = 0 AND NOT flag) AS tn, count(*) FILTER (toxic = 0 AND flag) AS fp,
  count(*) FILTER (toxic = 1 AND NOT flag) AS fn, count(toxic) AS n, count(*) - count(toxic) AS unlabelled FROM judged JOIN d USING (seq)), {quality('c', 'unlabelled,')}
SELECT tp, tn, fp, fn, n, unlabelled, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1""",
        "document_scores": f"""WITH {DOCUMENT_RECORDS} SELECT seq, round(score, 6) AS anomaly_score, flag AS is_anomaly_pred FROM judged""",
    }
