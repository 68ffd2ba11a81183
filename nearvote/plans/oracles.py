"""DuckDB SQL for the registered queries, written independently of the Spark code from the same rules."""

from __future__ import annotations

from .. import schema as S
from ..sources.transactions import MCC_CYCLE

DIMS = range(S.DIMS)

TX = f"""
base AS (
  SELECT event_id, user_id, ts AS requested_at, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         20 * CAST(round_even(value * 100, 0) AS BIGINT) AS amount_c, CAST(event_type = 'error' AS INTEGER) AS label FROM events),
seen AS (
  SELECT *, 'MERC-' || lpad(CAST(k % 20 AS VARCHAR), 3, '0') AS merchant_id,
         floor(CAST(sum(amount_c) OVER before AS DOUBLE) / nullif(count(*) OVER before, 0)) AS avg_c,
         lag(requested_at) OVER by_user AS last_ts, lag(k) OVER by_user AS last_k,
         count(*) OVER (PARTITION BY user_id ORDER BY requested_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) - 1 AS tx24,
         list('MERC-' || lpad(CAST(k % 20 AS VARCHAR), 3, '0')) OVER (PARTITION BY user_id ORDER BY requested_at ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS known,
         list_extract({list(MCC_CYCLE)}, CAST(k % {len(MCC_CYCLE)} + 1 AS INTEGER)) AS mcc
  FROM base WINDOW by_user AS (PARTITION BY user_id ORDER BY requested_at),
       before AS (PARTITION BY user_id ORDER BY requested_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tx AS (
  SELECT *, CAST(amount_c / 100 AS FLOAT) AS amount, CAST(coalesce(avg_c, 0) / 100 AS FLOAT) AS avg_amount,
         CAST(abs(k - last_k) * CAST(10.25 AS DOUBLE) AS FLOAT) AS km_last, CAST(k * CAST(11.5 AS DOUBLE) AS FLOAT) AS km_home,
         CAST((k % 20 + 1) * CAST(475.5 AS DOUBLE) AS FLOAT) AS merchant_avg,
         datediff('minute', date_trunc('minute', last_ts), date_trunc('minute', requested_at)) AS minutes
  FROM seen)"""


def _div(a: str, b: str) -> str:
    return f"(CAST({a} AS FLOAT) / CAST({b} AS FLOAT))"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, CAST(0 AS FLOAT)), CAST(1 AS FLOAT))"


_RISK = " ".join(f"WHEN '{code}' THEN {risk}" for code, risk in S.MCC_RISK.items())
FLOATS = (
    _clamp(_div("amount", "10000")),
    _clamp(_div("1 + k % 15", "12")),
    f"CASE WHEN avg_amount > 0 THEN {_clamp(_div(_div('amount', 'avg_amount'), '10'))} ELSE CAST(0 AS FLOAT) END",
    _div("hour(requested_at)", "23"),
    _div("isodow(requested_at) - 1", "6"),
    f"CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp(_div('minutes', '1440'))} END",
    f"CASE WHEN last_ts IS NULL THEN CAST(-1 AS FLOAT) ELSE {_clamp(_div('km_last', '1000'))} END",
    _clamp(_div("km_home", "1000")),
    _clamp(_div("tx24", "20")),
    "CAST(CAST(k % 2 = 0 AS INTEGER) AS FLOAT)",
    "CAST(CAST(k % 3 = 0 AS INTEGER) AS FLOAT)",
    "CAST(CAST(NOT coalesce(list_contains(known, merchant_id), false) AS INTEGER) AS FLOAT)",
    f"CAST(CASE mcc {_RISK} ELSE 0.5 END AS FLOAT)",
    _clamp(_div("merchant_avg", "10000")),
)


def _quantised(x: str) -> str:
    return f"CAST(greatest(-32767, least(32767, round_even(CAST({x} AS FLOAT) * CAST(10000 AS FLOAT), 0))) AS INTEGER)"


FEATURES = f"{TX},\nfeat AS (SELECT event_id, label, {', '.join(f'{_quantised(x)} AS q{d}' for d, x in enumerate(FLOATS))} FROM tx)"
Q = ", ".join(f"q{d}" for d in DIMS)


def _l2(a: str, b: str) -> str:
    return " + ".join(f"CAST({a}{d} - {b}{d} AS BIGINT) * ({a}{d} - {b}{d})" for d in DIMS)


SIDES = f"""{FEATURES},
asked AS (SELECT event_id AS query_id, {', '.join(f'q{d} AS a{d}' for d in DIMS)} FROM feat WHERE event_id % 50 = 0),
known AS (SELECT event_id AS ref_id, label, {', '.join(f'q{d} AS r{d}' for d in DIMS)} FROM feat WHERE event_id % 50 <> 0)"""

DECIDED = "CASE WHEN fraud BETWEEN 0 AND 5 THEN fraud ELSE 0 END < 3 AS approved, CAST(CASE WHEN fraud BETWEEN 0 AND 5 THEN fraud ELSE 0 END AS DOUBLE) / 5 AS fraud_score"

EXACT = f"""{SIDES},
near AS (
  SELECT query_id, ref_id, label, {_l2('a', 'r')} AS dist FROM asked, known
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) <= 5)"""

EMB = f"""
emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: {_quantised('x')}) AS q FROM embeddings)"""


def _list_l2(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] - z[2] AS BIGINT) * (z[1] - z[2]))) AS BIGINT)"


def _index(cells: int) -> str:
    return f"""{SIDES},
cent AS (
  SELECT CAST(row_number() OVER (ORDER BY ref_id) - 1 AS INTEGER) AS cell_id, {', '.join(f'r{d} AS c{d}' for d in DIMS)}
  FROM known QUALIFY row_number() OVER (ORDER BY ref_id) <= {cells}),
placed AS (
  SELECT k.*, cell_id, {_l2('r', 'c')} AS cdist FROM known k, cent
  QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY cdist, cell_id) = 1),
vec AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY cdist, ref_id) - 1 AS INTEGER) AS pos FROM placed),
cells AS (
  SELECT c.cell_id, CAST(count(v.ref_id) AS INTEGER) AS count, CAST(ceil(count(v.ref_id) / 128.0) AS INTEGER) AS block_count,
         {', '.join(f'min(r{d}) AS lo{d}, max(r{d}) AS hi{d}' for d in DIMS)}
  FROM cent c LEFT JOIN vec v USING (cell_id) GROUP BY c.cell_id)"""


def _probed(count: int) -> str:
    return f"""
probe AS (
  SELECT query_id, cell_id, {_l2('a', 'c')} AS cell_dist, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_l2('a', 'c')}, cell_id) AS INTEGER) AS probe_rank
  FROM asked, cent QUALIFY probe_rank <= {count}),
cand AS (
  SELECT p.query_id, p.probe_rank, v.pos, v.ref_id, v.label, {_l2('a', 'r')} AS dist
  FROM probe p JOIN asked a USING (query_id) JOIN vec v USING (cell_id))"""


def _adaptive(options: S.SearchOptions) -> str:
    inner = f"probe_rank <= {options.nprobe}"
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, pos) AS wide,
         CASE WHEN {inner} THEN row_number() OVER (PARTITION BY query_id, {inner} ORDER BY dist, probe_rank, pos) END AS narrow FROM cand),
counted AS (
  SELECT query_id, coalesce(sum(label) FILTER (narrow <= 5), 0) AS few, coalesce(sum(label) FILTER (wide <= 5), 0) AS many FROM ranked GROUP BY query_id),
voted AS (
  SELECT query_id, CAST(CASE WHEN few BETWEEN {options.repair_min} AND {options.repair_max} THEN many ELSE few END AS INTEGER) AS fraud,
         few BETWEEN {options.repair_min} AND {options.repair_max} AS widened
  FROM (SELECT query_id, coalesce(few, 0) AS few, coalesce(many, 0) AS many FROM asked LEFT JOIN counted USING (query_id)))"""


def _box(lo: str = "lo", hi: str = "hi") -> str:
    gap = lambda d: f"greatest({lo}{d} - a{d}, a{d} - {hi}{d}, 0)"
    return " + ".join(f"CAST({gap(d)} AS BIGINT) * {gap(d)}" for d in DIMS)


def _repair(options: S.SearchOptions) -> str:
    return f"""
open_q AS (SELECT query_id, widened FROM voted WHERE fraud BETWEEN {options.repair_min} AND {options.repair_max}),
scanned AS (SELECT p.query_id, p.cell_id, p.probe_rank FROM probe p JOIN open_q o USING (query_id) WHERE p.probe_rank <= {options.nprobe} OR o.widened),
more AS (
  SELECT a.query_id, c.cell_id, 1000 + row_number() OVER (PARTITION BY a.query_id ORDER BY {_box()}, c.cell_id) AS probe_rank
  FROM asked a JOIN open_q USING (query_id), cells c
  WHERE c.count > 0 AND NOT EXISTS (SELECT 1 FROM scanned s WHERE s.query_id = a.query_id AND s.cell_id = c.cell_id)
  QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY {_box()}, c.cell_id) <= {options.repair_candidates}),
again AS (
  SELECT query_id, sum(label) AS fraud FROM (
    SELECT s.query_id, v.label, row_number() OVER (PARTITION BY s.query_id ORDER BY {_l2('a', 'r')}, s.probe_rank, v.pos) AS n
    FROM (SELECT * FROM scanned UNION ALL SELECT * FROM more) s JOIN asked a USING (query_id) JOIN vec v USING (cell_id))
  WHERE n <= 5 GROUP BY query_id),
final AS (SELECT v.query_id, CAST(coalesce(g.fraud, v.fraud) AS INTEGER) AS fraud FROM voted v LEFT JOIN again g USING (query_id))"""


def _kmeans(k: int, rounds: int) -> str:
    steps = [f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cell_id, q AS c FROM emb QUALIFY row_number() OVER (ORDER BY vec_id) <= {k})"]
    for n in range(rounds):
        steps.append(f"a{n} AS (SELECT vec_id, q, cell_id, {_list_l2('q', 'c')} AS dist FROM emb, c{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cell_id) = 1)")
        steps.append(
            f"m{n} AS (SELECT cell_id, dim, CAST(trunc(CAST(sum(value) AS DOUBLE) / count(*)) AS BIGINT) AS value FROM (SELECT cell_id, unnest(q) AS value, generate_subscripts(q, 1) AS dim FROM a{n}) GROUP BY cell_id, dim)"
        )
        steps.append(f"c{n + 1} AS (SELECT cell_id, list(value ORDER BY dim) AS c FROM m{n} GROUP BY cell_id)")
    return ",\n".join(steps)


SAMPLES = "s AS (SELECT event_type AS stage, ts, CAST(round_even(value * 10000, 0) AS BIGINT) AS ns, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events), h AS (SELECT stage, CAST(least(ns // 1000, 2047) AS INTEGER) AS bucket, ts, k FROM s)"


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({columns})"


#: name, parse_ok, amount, installments, ratio, minutes, unknown, risk (quantised).
EDGES = [
    ("sound", True, 41, 1667, 500, -10000, 0, 1500),
    *[(n, False, None, None, None, None, None, None) for n in ("empty", "garbage", "no_transaction", "no_customer", "no_merchant", "no_terminal", "no_last_transaction", "last_is_empty", "negative_whole", "no_average", "short_code", "short_time", "bad_month")],
    ("exponent", True, 1000, 1667, 10000, -10000, 0, 1500), ("broken_whole", True, 41, 1667, 500, -10000, 0, 1500), ("zero_average", True, 41, 1667, 0, -10000, 0, 1500),
    ("seventeenth_merchant", True, 41, 1667, 500, -10000, 10000, 1500), ("no_merchants", True, 41, 1667, 500, -10000, 10000, 1500),
    ("long_code", True, 41, 1667, 500, -10000, 0, 1500), ("other_code", True, 41, 1667, 500, -10000, 0, 5000), ("spaced", True, 41, 1667, 500, -10000, 0, 1500),
    ("last_is_later", True, 41, 1667, 500, 0, 0, 1500), ("last_is_old", True, 41, 1667, 500, 10000, 0, 1500), ("seconds_dropped", True, 41, 1667, 500, 7, 0, 1500),
    ("over_midnight", True, 41, 1667, 500, 14, 0, 1500), ("reversed", True, 41, 1667, 500, -10000, 0, 1500),
]


def build(cells: int, small: S.SearchOptions, repair: S.SearchOptions) -> dict[str, str]:
    index = _index(cells)
    probe4 = f"WITH {index},{_probed(4)}"
    adaptive = f"WITH {index},{_probed(small.repair_probe)},{_adaptive(small)} SELECT query_id, fraud, {DECIDED} FROM voted"
    plain_adaptive = adaptive
    fixed = f"{probe4} SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, ref_id, dist, label FROM cand WINDOW w AS (PARTITION BY query_id ORDER BY dist, probe_rank, pos) QUALIFY row_number() OVER w <= 5"
    nearest = f"""near AS (
      SELECT q.vec_id AS query_id, r.vec_id AS ref_id, r.label, {_list_l2('q.q', 'r.q')} AS dist FROM emb q JOIN emb r ON q.vec_id <> r.vec_id WHERE q.vec_id % 10 = 0
      QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY dist, r.vec_id) <= 5)"""
    warm = f"""asked AS (SELECT i AS query_id, {', '.join(_quantised(f"CASE WHEN i % 4 = 0 AND {str(d in (5, 6)).lower()} THEN CAST(-1 AS FLOAT) ELSE " + _div(f'(i * 131 + {d} * 17) % 1000', '1000') + ' END') + f' AS a{d}' for d in DIMS)} FROM range(2048) t(i))"""
    warm_index = index.replace("asked AS", "unasked AS", 1)
    return {
        "features_float": f"WITH {TX} SELECT event_id, {', '.join(f'CAST(round_even(CAST({x} AS DOUBLE) * 1e6, 0) AS BIGINT) AS {name}' for name, x in zip(S.FEATURES, FLOATS, strict=True))} FROM tx",
        "features_quantized": f"WITH {FEATURES} SELECT event_id, {Q} FROM feat",
        "mcc_risk_join": f"WITH {TX} SELECT mcc, count(*) AS n, CAST(round(max(CASE mcc {_RISK} ELSE 0.5 END) * 100) AS INTEGER) AS risk_pct FROM tx GROUP BY mcc",
        "unknown_merchant": f"WITH {TX} SELECT event_id, CAST(NOT coalesce(list_contains(known, merchant_id), false) AS INTEGER) AS unknown FROM tx",
        "minutes_since_last": f"WITH {TX} SELECT event_id, minutes, CAST(isodow(requested_at) - 1 AS INTEGER) AS weekday, CAST(hour(requested_at) AS INTEGER) AS hour FROM tx",
        "parse_payload_json": f"WITH {FEATURES} SELECT event_id, true AS parse_ok, {Q} FROM feat",
        "parse_edge_cases": _values(EDGES, "name, parse_ok, amount, installments, ratio, minutes, unknown, risk"),
        "embeddings_quantize": f"WITH {EMB} SELECT vec_id, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS dim, unnest(q) AS value FROM emb",
        "dequantized_error": f"SELECT label, count(*) AS n, CAST(max(round_even(abs(CAST({_div(_quantised('x'), '10000')} AS DOUBLE) - CAST(x AS DOUBLE)) * 1e6, 0)) AS BIGINT) AS worst FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY label",
        "pairwise_distance": f"WITH {EMB}, f AS (SELECT label, min(vec_id) AS first_id FROM emb GROUP BY label) SELECT e.vec_id, f.first_id, {_list_l2('e.q', 'p.q')} AS dist FROM emb e JOIN f USING (label) JOIN emb p ON p.vec_id = f.first_id",
        "exact_knn_top5": f"WITH {EMB}, {nearest} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS INTEGER) AS rank, ref_id, dist, label FROM near",
        "knn_classify": f"WITH {EMB}, {nearest}, v AS (SELECT query_id, label, count(*) AS votes FROM near GROUP BY ALL) SELECT query_id, label AS predicted, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1",
        "fraud_score_exact": f"WITH {EXACT}, v AS (SELECT query_id, CAST(sum(label) AS INTEGER) AS fraud, CAST(sum(dist) AS BIGINT) AS sum_dist FROM near GROUP BY query_id) SELECT query_id, fraud, sum_dist, {DECIDED} FROM v",
        "kmeans_assign": f"WITH {EMB}, {_kmeans(8, 1)} SELECT vec_id, cell_id, dist FROM a0",
        "kmeans_iterations": f"WITH {EMB}, {_kmeans(8, 2)} SELECT cell_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS dim, unnest(c) AS value FROM c2",
        "ivf_cells": f"WITH {index} SELECT cell_id, count FROM cells",
        "cell_offsets": f"WITH {index} SELECT cell_id, CAST(coalesce(sum(count) OVER b, 0) AS INTEGER) AS start, count, CAST(coalesce(sum(block_count) OVER b, 0) AS INTEGER) AS block_start, block_count FROM cells WINDOW b AS (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "cell_positions": f"WITH {index} SELECT cell_id, pos, CAST(pos // 128 AS INTEGER) AS block, ref_id, label FROM vec",
        "cell_bounds": f"WITH {index} SELECT cell_id, dim, lo, hi FROM (" + " UNION ALL ".join(f"SELECT cell_id, {d} AS dim, lo{d} AS lo, hi{d} AS hi FROM cells WHERE count > 0" for d in DIMS) + ")",
        "block_bounds": f"WITH {index} " + " UNION ALL ".join(f"SELECT cell_id, CAST(pos // 128 AS INTEGER) AS block, {d} AS dim, min(r{d}) AS lo, max(r{d}) AS hi FROM vec GROUP BY ALL" for d in DIMS),
        "box_lower_bound": f"WITH {index} SELECT query_id, cell_id, {_box()} AS bound FROM asked, cells WHERE count > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_box()}, cell_id) = 1",
        "probe_cells": f"{probe4} SELECT query_id, probe_rank, cell_id, cell_dist FROM probe",
        "ivf_search_fixed": fixed,
        "ivf_search_pruned": fixed,
        "ivf_search_adaptive": adaptive,
        "ivf_search_default": f"WITH {index},{_probed(S.SearchOptions().repair_probe)},{_adaptive(S.SearchOptions())} SELECT query_id, fraud, {DECIDED} FROM voted",
        "ivf_search_repair": f"WITH {index},{_probed(repair.repair_probe)},{_adaptive(repair)},{_repair(repair)} SELECT query_id, fraud, {DECIDED} FROM final",
        "ivf_reranked": f"{probe4}, five AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, pos) <= 5) SELECT query_id, CAST(sum(label) AS INTEGER) AS fraud, CAST(count(*) AS INTEGER) AS found FROM five GROUP BY query_id",
        "ivf_recall": f"{probe4}, five AS (SELECT query_id, ref_id FROM cand QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, probe_rank, pos) <= 5), truth AS (SELECT query_id, ref_id FROM (SELECT query_id, ref_id, row_number() OVER (PARTITION BY query_id ORDER BY {_l2('a', 'r')}, ref_id) AS n FROM asked, known) WHERE n <= 5) SELECT count(f.ref_id) AS hits, count(*) AS wanted FROM truth t LEFT JOIN five f ON f.query_id = t.query_id AND f.ref_id = t.ref_id",
        "ivf_stored": plain_adaptive,
        "decision_table": f"""SELECT fraud, {DECIDED}, '{{"approved":' || CASE WHEN fraud < 3 OR fraud > 5 THEN 'true' ELSE 'false' END || ',"fraud_score":' || CASE fraud WHEN 1 THEN '0.2' WHEN 2 THEN '0.4' WHEN 3 THEN '0.6' WHEN 4 THEN '0.8' WHEN 5 THEN '1.0' ELSE '0.0' END || '}}' AS body FROM (SELECT CAST(range AS INTEGER) AS fraud FROM range(9))""",
        "warmup_vectors": " UNION ALL ".join(f"SELECT i AS id, {d} AS dim, " + _quantised(f"CASE WHEN i % 4 = 0 AND {str(d in (5, 6)).lower()} THEN CAST(-1 AS FLOAT) ELSE " + _div(f"(i * 131 + {d} * 17) % 1000", "1000") + " END") + " AS value FROM range(2048) t(i)" for d in DIMS),
        "warmup_scores": f"WITH {warm_index}, {warm},{_probed(small.repair_probe)},{_adaptive(small)} SELECT query_id, fraud, {DECIDED} FROM voted",
        "latency_histogram": f"WITH {SAMPLES} SELECT stage, bucket, count(*) AS n FROM h GROUP BY ALL",
        "latency_percentiles": f"WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY bucket) AS i, count(*) OVER (PARTITION BY stage) AS n FROM h) SELECT stage, any_value(n) AS n, CAST(sum(bucket) AS DOUBLE) / count(*) AS mean_us, max(bucket) AS max_us, " + ", ".join(f"min(bucket) FILTER (i >= (n * {p} + 99) // 100) AS p{p}" for p in (50, 95, 99)) + " FROM r GROUP BY stage",
        "batch_histogram": f"WITH {SAMPLES} SELECT CAST(least(k * 2, 127) AS INTEGER) AS size, count(*) AS batches FROM h GROUP BY 1",
        "batch_summary": f"WITH {SAMPLES} SELECT count(*) AS batches, CAST(sum(least(k * 2, 127)) AS DOUBLE) / count(*) AS mean_size, CAST(max(least(k * 2, 127)) AS INTEGER) AS max_size FROM h",
        "interval_metrics": f"WITH {SAMPLES} SELECT time_bucket(INTERVAL 5 SECOND, ts, TIMESTAMP '1970-01-01') AS interval_start, stage, count(*) AS n, CAST(sum(bucket) AS BIGINT) AS sum_us, max(bucket) AS max_us FROM h GROUP BY 1, 2",
        "route_requests": _values([(1, "ready", 200, None), (2, "not_found", 404, None), (3, "not_found", 404, None), (4, "score", 200, "hello"), (5, "score", 200, "{}"), (6, "score", 200, ""), (7, "not_found", 404, None)], "id, route, status, body"),
        "socket_list": _values([(1, 2, "a.sock|b.sock"), (2, 0, ""), (3, 16, "|".join(f"s{i}" for i in range(16)))], "id, n, targets"),
        "stream_score": f"WITH {EXACT}, v AS (SELECT query_id, CAST(sum(label) AS INTEGER) AS fraud FROM near GROUP BY query_id) SELECT query_id, fraud, {DECIDED} FROM v",
        "stream_intervals": f"WITH {SAMPLES} SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS interval_start, count(*) AS samples, CAST(sum(bucket) AS BIGINT) AS sum_us, max(bucket) AS max_us FROM h GROUP BY 1",
    }
