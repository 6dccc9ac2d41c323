"""The same results as plain SQL over the same tables, for checking.

Nothing here is used by the library; the statements run in DuckDB.
"""

from __future__ import annotations

PACKETS = """packets AS (
  SELECT 167772160 + user_id AS src_ip, ts, event_id % 4 AS cpu, event_id,
         CAST(CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'signup' THEN 17
                              WHEN 'error' THEN 1 ELSE 47 END AS INTEGER) AS proto,
         event_type = 'click' AS tcp_syn, event_type = 'view' AS tcp_ack,
         least(1500, 40 + CAST(floor(value * 3) AS BIGINT)) AS pkt_len
  FROM events)"""


def _counter_list(iat: str) -> str:
    return f"""count(*) AS pkt_count, CAST(sum(pkt_len) AS BIGINT) AS byte_count,
         count(*) FILTER (WHERE proto = 6 AND tcp_syn) AS syn_count,
         count(*) FILTER (WHERE proto = 6 AND tcp_ack) AS ack_count,
         count(*) FILTER (WHERE proto = 17) AS udp_count,
         count(*) FILTER (WHERE proto = 1) AS icmp_count,
         count(*) FILTER (WHERE proto = 6) AS tcp_count,
         count(*) FILTER (WHERE proto NOT IN (1, 6, 17)) AS other_proto,
         CAST(sum(pkt_len * pkt_len) AS BIGINT) AS pkt_size_sum_sq,
         min(ts) AS first_seen, max(ts) AS last_seen, CAST({iat} AS BIGINT) AS iat_sum_us"""


COUNTS = (
    "pkt_count, byte_count, syn_count, ack_count, udp_count, icmp_count, tcp_count, other_proto, "
    "pkt_size_sum_sq, iat_sum_us"
)
SPAN = "epoch_us(max(ts)) - epoch_us(min(ts))"


def _bucket(width: str) -> str:
    return f"time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01')"


COUNTERS = f"""{PACKETS}, counters AS (
  SELECT src_ip, {_bucket('1 day')} AS window_start, {_bucket('1 day')} + INTERVAL '1 day' AS window_end,
         {_counter_list(SPAN)}
  FROM packets GROUP BY ALL)"""

_TERM = "CASE WHEN {c} > 0 THEN CAST({c} AS DOUBLE) / {t} * log2(CAST({c} AS DOUBLE) / {t}) ELSE 0.0::DOUBLE END"
_TOTAL = "(tcp_count + udp_count + icmp_count + other_proto)"
DERIVED = {
    "syn_ack_ratio": "CASE WHEN ack_count > 0 THEN CAST(syn_count AS DOUBLE) / ack_count ELSE CAST(syn_count AS DOUBLE) END",
    "pkt_size_mean": "CAST(byte_count AS DOUBLE) / pkt_count",
    "pkt_size_var": (
        "CASE WHEN pkt_count > 1 THEN greatest(CAST(pkt_size_sum_sq AS DOUBLE) / pkt_count"
        " - (CAST(byte_count AS DOUBLE) / pkt_count) * (CAST(byte_count AS DOUBLE) / pkt_count), 0.0::DOUBLE)"
        " ELSE 0.0::DOUBLE END"
    ),
    "flow_duration": "CAST(epoch_us(last_seen) - epoch_us(first_seen) AS DOUBLE) / 1e6",
    "proto_entropy": "0.0::DOUBLE - ("
    + " + ".join(_TERM.format(c=c, t=_TOTAL) for c in ("tcp_count", "udp_count", "icmp_count", "other_proto"))
    + ")",
    "iat_mean": "CASE WHEN pkt_count > 1 THEN CAST(iat_sum_us AS DOUBLE) / (pkt_count - 1) ELSE 0.0::DOUBLE END",
}
FEATURE_NAMES = [
    "pkt_count",
    "byte_count",
    "syn_count",
    "ack_count",
    "syn_ack_ratio",
    "pkt_size_mean",
    "pkt_size_var",
    "flow_duration",
    "proto_entropy",
    "iat_mean",
]
_FEATURE_LIST = ", ".join(
    f"{DERIVED[f]} AS {f}" if f in DERIVED else f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURE_NAMES
)
FEATURES = f"""{COUNTERS}, features AS (
  SELECT src_ip, window_start, window_end, {_FEATURE_LIST} FROM counters)"""

DETECTIONS = f"""{FEATURES}, scored AS (
  SELECT *, CAST(CASE WHEN syn_ack_ratio > 1 THEN CASE WHEN pkt_count > 2 THEN 0.95 ELSE 0.6 END
                      WHEN flow_duration > 43200 THEN 0.15 ELSE 0.01 END AS DOUBLE) AS score FROM features),
detections AS (SELECT *, score > 0.5::DOUBLE AS is_attack FROM scored)"""

_IP = "concat_ws('.', {v} >> 24, ({v} >> 16) & 255, ({v} >> 8) & 255, {v} & 255)"
ALERTS = f"""{DETECTIONS}, alerts AS (
  SELECT window_end AS timestamp, {_IP.format(v='src_ip')} AS src_ip, src_ip AS src, score, pkt_count,
         byte_count, syn_count, 'BLOCK' AS action
  FROM detections WHERE is_attack)"""
_ALERT_OUT = "epoch_us(timestamp) AS timestamp, src_ip, score, pkt_count, byte_count, syn_count, action"

POINT_FIELDS = [
    "score",
    "pkt_count",
    "byte_count",
    "syn_count",
    "syn_ack_ratio",
    "pkt_size_mean",
    "flow_duration",
    "iat_mean",
]
POINTS = f"""{DETECTIONS}, points AS (
  SELECT 'detection' AS measurement, window_end AS ts, {_IP.format(v='src_ip')} AS src_ip,
         CAST(is_attack AS VARCHAR) AS is_attack, {', '.join(POINT_FIELDS)} FROM detections)"""


def _rounded(names, digits: int = 6) -> str:
    return ", ".join(f'round("{n}", {digits}) AS "{n}"' for n in names)


BLACKLIST = """blacklist AS (
  SELECT 167772160 + user_id AS src_ip, ts AS blocked_at,
         CASE WHEN value >= 70 THEN 0 ELSE 21600000000 END AS ttl_us
  FROM events WHERE event_type = 'signup')"""
MARKED = f"""{PACKETS}, {BLACKLIST}, marked AS (
  SELECT p.*, EXISTS (SELECT 1 FROM blacklist b WHERE b.src_ip = p.src_ip AND p.ts >= b.blocked_at
                      AND (b.ttl_us = 0 OR epoch_us(p.ts) < epoch_us(b.blocked_at) + b.ttl_us)) AS dropped
  FROM packets p)"""


def _throughput(source: str, width: str, dropped: str) -> str:
    return f"""SELECT {_bucket(width)} AS window_start, {_bucket(width)} + INTERVAL '{width}' AS window_end,
         count(*) FILTER (WHERE NOT {dropped}) AS total_pkts,
         CAST(coalesce(sum(pkt_len) FILTER (WHERE NOT {dropped}), 0) AS BIGINT) AS total_bytes,
         count(*) FILTER (WHERE {dropped}) AS total_dropped
  FROM {source} GROUP BY ALL"""


_CUM = ", ".join(
    f"CAST(sum(total_{c}) OVER (ORDER BY window_start) AS BIGINT) AS cum_{c}" for c in ("pkts", "bytes", "dropped")
)
THROUGHPUT = f"""{MARKED}, per_window AS ({_throughput('marked', '1 hour', 'dropped')}),
throughput AS (SELECT *, {_CUM} FROM per_window)"""


def _rate(value: str) -> str:
    return f"""WITH {THROUGHPUT}, s AS (
      SELECT window_end AS ts, CAST({value} AS DOUBLE) AS v,
             lag(CAST({value} AS DOUBLE)) OVER (ORDER BY window_end) AS pv,
             lag(window_end) OVER (ORDER BY window_end) AS pt FROM throughput)
    SELECT epoch_us(ts) AS ts,
           round(CASE WHEN v >= pv THEN (v - pv) END / (CAST(epoch_us(ts) - epoch_us(pt) AS DOUBLE) / 1e6), 9) AS rate
    FROM s WHERE pt IS NOT NULL"""


FLOW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_DURATION = "CAST(l_suppkey AS DOUBLE) * 1000"
_BROKEN = (
    "CASE WHEN l_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_partkey % 89 = 0 THEN NULL"
    " ELSE CAST(l_suppkey AS DOUBLE) * 1000 END"
)


def _flow_select(duration: str, where: str = "true") -> str:
    return f"""SELECT {FLOW_ID} AS flow_id, CAST(l_quantity AS BIGINT) AS fwd,
         CAST(l_linenumber - 1 AS BIGINT) AS bwd, l_extendedprice AS bytes, CAST(l_linenumber AS BIGINT) AS syn,
         CAST(round(l_discount * 100) AS BIGINT) % 4 AS ack, l_extendedprice / l_quantity AS len_mean,
         l_tax * 10000 + CAST(0.0 AS DOUBLE) AS len_var, {duration} AS duration,
         CAST(l_partkey % 1000 AS DOUBLE) * 10 AS iat,
         CASE WHEN l_returnflag = 'R' THEN 'DDoS' ELSE 'BENIGN' END AS label_text
  FROM lineitem WHERE {where}"""


FLOWS = f"flows AS ({_flow_select(_DURATION)})"
BROKEN = (
    f"broken AS ({_flow_select(_BROKEN)} UNION ALL {_flow_select(_BROKEN, 'l_partkey % 50 = 0')}), "
    "kept AS (SELECT * FROM broken WHERE duration IS NOT NULL AND duration <> CAST('Infinity' AS DOUBLE)), "
    "clean AS (SELECT DISTINCT * FROM kept)"
)
_SYN_ACK = "CAST(syn AS DOUBLE) / CASE WHEN ack = 0 THEN 1 ELSE ack END"
_HALF = "CASE WHEN {c} > 0 THEN CAST({c} AS DOUBLE) / (fwd + bwd) * log2(CAST({c} AS DOUBLE) / (fwd + bwd)) ELSE 0.0::DOUBLE END"
_FLOW_ENTROPY = f"0.0::DOUBLE - ({_HALF.format(c='fwd')} + {_HALF.format(c='bwd')})"
FLOW_FEATURES = {
    "Total Fwd Packets": "CAST(fwd AS DOUBLE)",
    "Total Length of Fwd Packets": "bytes",
    "SYN Flag Count": "CAST(syn AS DOUBLE)",
    "ACK Flag Count": "CAST(ack AS DOUBLE)",
    "SYN_ACK_Ratio": _SYN_ACK,
    "Packet Length Mean": "len_mean",
    "Packet Length Variance": "len_var",
    "Flow Duration": "duration",
    "Proto_Entropy": _FLOW_ENTROPY,
    "Flow IAT Mean": "iat",
}
_FLOW_SELECT = ", ".join(f'{e} AS "{n}"' for n, e in FLOW_FEATURES.items())


def _features_of(source: str) -> str:
    return (
        f"SELECT flow_id, {_FLOW_SELECT}, CAST(label_text <> 'BENIGN' AS INTEGER) AS label, label_text FROM {source}"
    )


FLOW_TABLE = f"{FLOWS}, ft AS ({_features_of('flows')})"
CLEAN_TABLE = f"{BROKEN}, ft AS ({_features_of('clean')})"
_HASH = "CAST('0x' || substr(md5('42:' || flow_id), 1, 13) AS BIGINT)"
_IN_TEST = f"{_HASH} < {int(0.2 * 16**13)}"
_LONG = " UNION ALL ".join(
    f"""SELECT label_text, '{n}' AS feature, "{n}" AS value FROM ft""" for n in FLOW_FEATURES
)


def _scaled(train_filter: str) -> str:
    extremes = ", ".join(
        f"""min("{n}") AS lo{i}, max("{n}") AS hi{i}""" for i, n in enumerate(FLOW_FEATURES)
    )
    cells = ", ".join(
        f"""round(("{n}" - lo{i}) * (1.0::DOUBLE / CASE WHEN hi{i} = lo{i} THEN 1 ELSE hi{i} - lo{i} END), 6) AS "{n}" """
        for i, n in enumerate(FLOW_FEATURES)
    )
    return f"ext AS (SELECT {extremes} FROM ft WHERE {train_filter}), scaled AS (SELECT flow_id, {cells}, label FROM ft, ext)"


PRED = f"""pred AS (SELECT {FLOW_ID} AS id, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / 1000 AS score,
  CAST(CAST((l_partkey * 37 + l_suppkey * 11) % 1000 AS DOUBLE) / 1000 > 0.5::DOUBLE AS INTEGER) AS prediction
  FROM lineitem)"""
CELLS = f"""{PRED}, cells AS (SELECT
  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp
  FROM pred)"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0::DOUBLE END"


_REPORT = {
    "0": (_div("tn", "tn + fn"), _div("tn", "tn + fp"), _div("2 * tn", "2 * tn + fn + fp"), "tn + fp"),
    "1": (_div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("2 * tp", "2 * tp + fp + fn"), "tp + fn"),
}


def _report_rows() -> str:
    lines = []
    for code, name in (("0", "Benign"), ("1", "Attack")):
        p, r, f, s = _REPORT[code]
        lines.append((name, p, r, f, s))
    acc = _div("tn + tp", "tn + fp + fn + tp")
    total = "tn + fp + fn + tp"
    macro = [f"({_REPORT['0'][i]} + {_REPORT['1'][i]}) / 2" for i in range(3)]
    weighted = [
        f"(({_REPORT['0'][i]}) * (tn + fp) + ({_REPORT['1'][i]}) * (tp + fn)) / ({total})" for i in range(3)
    ]
    lines += [("accuracy", acc, acc, acc, total), ("macro avg", *macro, total), ("weighted avg", *weighted, total)]
    return " UNION ALL ".join(
        f"""SELECT '{n}' AS class, round({p}, 4) AS "precision", round({r}, 4) AS recall, round({f}, 4) AS f1,
        {s} AS support FROM cells"""
        for n, p, r, f, s in lines
    )


CURVE = f"""{PRED}, g AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos,
  count(*) FILTER (WHERE label = 0) AS neg FROM pred GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


def _blocks(end: str) -> str:
    """Recursive walk over the windows of each source; ``end`` is where a new block ends."""
    block = f"CASE WHEN w.us >= {{until}} AND w.is_attack THEN {end} ELSE {{until}} END"
    state = "CASE WHEN w.us < {until} THEN 'DROPPED' WHEN w.is_attack THEN 'BLOCK' ELSE 'PASS' END"
    start = "CAST(-1 AS BIGINT)"
    return f"""ordered AS (SELECT *, epoch_us(window_start) AS us, epoch_us(window_end) AS ue,
    row_number() OVER (PARTITION BY src_ip ORDER BY window_start) AS rn FROM detections),
  walk AS (
    SELECT w.src_ip, w.rn, w.us, w.ue, w.is_attack, {state.format(until=start)} AS state,
           {block.format(until=start)} AS until FROM ordered w WHERE rn = 1
    UNION ALL
    SELECT w.src_ip, w.rn, w.us, w.ue, w.is_attack, {state.format(until='k.until')} AS state,
           {block.format(until='k.until')} AS until
    FROM walk k JOIN ordered w ON w.src_ip = k.src_ip AND w.rn = k.rn + 1),
  verdicts AS (SELECT *, CASE WHEN state IN ('BLOCK', 'DROPPED') THEN until ELSE -1 END AS blocked_until FROM walk)"""


_TTL_US = 3 * 86400 * 1000000
VERDICTS = f"{DETECTIONS}, {_blocks(f'w.ue + {_TTL_US}')}"
VERDICTS_FOREVER = f"{DETECTIONS}, {_blocks('253402300799999999')}"
_LAST_ALERT_COLUMNS = "d.score, d.pkt_count, d.byte_count, d.syn_count"
_VERDICT_ALERTS = f"""SELECT v.ue AS timestamp, {_IP.format(v='v.src_ip')} AS src_ip, {_LAST_ALERT_COLUMNS}, 'BLOCK' AS action
  FROM verdicts v JOIN detections d ON d.src_ip = v.src_ip AND epoch_us(d.window_start) = v.us
  WHERE v.state = 'BLOCK'"""

_FRAME_LEN = "greatest(CASE WHEN event_id % 5 = 2 THEN 58 ELSE 54 END, least(1500, 40 + CAST(floor(value * 3) AS INTEGER)))"
FRAMES = f"""frames AS (
  SELECT event_id, 167772160 + user_id AS src_ip, ts, event_type,
         CAST(CASE event_type WHEN 'click' THEN 6 WHEN 'view' THEN 6 WHEN 'signup' THEN 17
                              WHEN 'error' THEN 1 ELSE 47 END AS INTEGER) AS proto,
         event_id % 11 = 3 AS is_v6, CASE WHEN event_id % 5 = 2 THEN 38 ELSE 34 END AS l4,
         CAST(CASE WHEN event_id % 13 = 5 THEN 13 WHEN event_id % 13 = 7 THEN 42 ELSE {_FRAME_LEN} END AS BIGINT) AS size
  FROM events),
good AS (SELECT * FROM frames WHERE NOT is_v6 AND size >= 34
   AND size >= CASE proto WHEN 6 THEN l4 + 20 WHEN 17 THEN l4 + 8 WHEN 1 THEN l4 + 8 ELSE 0 END)"""

_FRAMES_MARKED = f"""{FRAMES}, {BLACKLIST}, headed AS (
    SELECT *, size AS pkt_len, event_type IN ('click', 'view') AS tcp_syn, event_type = 'view' AS tcp_ack,
           size >= CASE proto WHEN 6 THEN l4 + 20 WHEN 17 THEN l4 + 8 WHEN 1 THEN l4 + 8 ELSE 0 END AS l4_ok
    FROM frames WHERE NOT is_v6 AND size >= 34),
  marked AS (SELECT p.*, EXISTS (SELECT 1 FROM blacklist b WHERE b.src_ip = p.src_ip AND p.ts >= b.blocked_at
               AND (b.ttl_us = 0 OR epoch_us(p.ts) < epoch_us(b.blocked_at) + b.ttl_us)) AS dropped FROM headed p),
  counted AS (SELECT * FROM marked WHERE dropped OR l4_ok)"""
_FRAME_PACKETS = f"""{_FRAMES_MARKED}, packets AS (SELECT * FROM marked WHERE l4_ok AND NOT dropped)"""

_GAPS = f"""{PACKETS}, instants AS (
  SELECT src_ip, {_bucket('1 day')} AS window_start, ts, count(*) AS packets FROM packets GROUP BY ALL),
gaps AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip, window_start ORDER BY ts) AS iat_us
  FROM instants)"""

_SKETCH_BUCKET = "CAST('0x' || substr(md5(r || ':' || src_ip), 1, 13) AS BIGINT) % 64"
SKETCH = f"""{PACKETS}, sk AS (
  SELECT CAST(r AS INTEGER) AS row, {_SKETCH_BUCKET} AS bucket, count(*) AS count
  FROM packets, (SELECT unnest([0, 1, 2, 3]) AS r) GROUP BY ALL)"""

_RANK_MODELS = " UNION ALL ".join(
    f"""SELECT 'cut-{c}' AS model, {c}::DOUBLE AS inference_us,
  round({_div('2 * count(*) FILTER (WHERE label = 1 AND score > ' + str(c) + ')', 'count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE score > ' + str(c) + ')')}, 4) AS f1 FROM pred"""
    for c in (0.2, 0.4, 0.6, 0.8)
)
_COLUMNS_OF_CORR = list(FLOW_FEATURES)
_CORR = " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr("{a}", "{b}"), 6) AS r FROM ft"""
    for a in _COLUMNS_OF_CORR
    for b in _COLUMNS_OF_CORR
)
_IMPORTANCE = " UNION ALL ".join(
    f"""SELECT '{a}' AS feature, round(abs(corr("{a}", label)), 6) AS importance FROM ft""" for a in _COLUMNS_OF_CORR
)
_PARTS = "SELECT flow_id, label, CASE WHEN {test} THEN 'test' ELSE 'train' END AS part FROM {source}"
_BRIEF = "flow_id, CAST(fwd AS DOUBLE) AS fwd, CAST(bwd AS DOUBLE) AS bwd, duration, round(len_mean, 9) AS len_mean, label_text AS \"Label\""
_RECURSIVE = "WITH RECURSIVE"
_QUARTILES = (
    "quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75"
)

_IN_RANGE = "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'"

# Models that learn a label which one column decides: what they predict is that column's rule.
_TEST = f"{CLEAN_TABLE}, test AS (SELECT flow_id, CAST(syn > 3 AS INTEGER) AS label, syn FROM clean WHERE {_IN_TEST})"
_LEARNED = f"WITH {_TEST} SELECT flow_id, label, label AS prediction, CAST(label AS DOUBLE) AS score"
_TEST_PRED = f"{_TEST}, pred AS (SELECT label, label AS prediction FROM test)"


def _perfect(model: str, params: str) -> str:
    return f"""SELECT '{model}' AS model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS "precision", 1.0::DOUBLE AS recall,
      1.0::DOUBLE AS f1, 0.0::DOUBLE AS fpr, '{params}' AS best_params"""


# Balanced classes tie, and a tree without a split then says 0.
_COMPARED = f"""WITH {_TEST}, share AS (SELECT avg(label) AS p FROM test)
  SELECT 'Constant' AS model, round(1 - p, 4) AS accuracy, 0.0::DOUBLE AS "precision", 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1,
    0.0::DOUBLE AS fpr, '{{"maxDepth": 0}}' AS best_params FROM share
  UNION ALL {_perfect('DecisionTree', '{"maxDepth": 5, "minInstancesPerNode": 1}')}
  UNION ALL {_perfect('RandomForest', '{"numTrees": 10, "maxDepth": 10, "featureSubsetStrategy": "all"}')}
  UNION ALL {_perfect('Boosted', '{"maxIter": 3, "maxDepth": 4}')}
  UNION ALL {_perfect('BoostedLeafwise', '{"maxIter": 3, "maxDepth": 4, "numLeaves": 31}')}"""


def _salted(salt: str) -> str:
    return f"CAST('0x' || substr(md5('42:{salt}:' || flow_id), 1, 13) AS BIGINT)"


_PERMUTED = f"""{_TEST}, g AS (SELECT *, {_salted('group')} % (SELECT greatest(1, count(*) // 10000) FROM test) AS grp FROM test),
  placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {_salted('take')}, flow_id) AS a,
      row_number() OVER (PARTITION BY grp ORDER BY {_salted('give')}, flow_id) AS f FROM g),
  paired AS (SELECT x.label, CAST(y.syn > 3 AS INTEGER) AS guess FROM placed x JOIN placed y ON x.grp = y.grp AND x.a = y.f),
  moved AS (SELECT 1 - 2.0::DOUBLE * count(*) FILTER (WHERE label = 1 AND guess = 1) / sum(label + guess) AS loss FROM paired)"""
_FEATURE_NAMES = f"(SELECT unnest([{', '.join(repr(n) for n in FLOW_FEATURES)}]) AS feature)"

# Balancing: the class R is the smaller one.
_BALANCED = f"""{FLOW_TABLE}, train AS (SELECT * FROM ft WHERE NOT ({_IN_TEST})),
  sizes AS (SELECT count(*) FILTER (WHERE label = 1) AS small, count(*) FILTER (WHERE label = 0) AS large FROM train),
  quota AS (SELECT *, (large - small) // small AS each, (large - small) % small AS extra,
      row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:quota:' || flow_id), 1, 13) AS BIGINT)) AS place
      FROM train, sizes WHERE label = 1),
  made AS (SELECT *, unnest(range(1, 1 + each + CASE WHEN place <= extra THEN 1 ELSE 0 END)) AS i FROM quota)"""

ORACLES: dict[str, str] = {
    # balancing, models
    "smote": f"""WITH {_BALANCED} SELECT flow_id, label, true AS inside FROM train
        UNION ALL SELECT flow_id || '#' || i AS flow_id, label, true AS inside FROM made""",
    "smote_values": f"""WITH {_BALANCED} SELECT flow_id, "SYN Flag Count", "ACK Flag Count", label FROM train
        UNION ALL SELECT flow_id || '#' || i AS flow_id, "SYN Flag Count", "ACK Flag Count", label FROM made""",
    "prepare_training": f"""WITH {CLEAN_TABLE}, t AS (SELECT CAST(syn > 3 AS INTEGER) AS label, {_IN_TEST} AS held FROM clean),
        n AS (SELECT label, count(*) AS n FROM t WHERE NOT held GROUP BY label)
        SELECT 'test' AS part, label, count(*) AS rows FROM t WHERE held GROUP BY label
        UNION ALL SELECT 'train' AS part, label, (SELECT max(n) FROM n) AS rows FROM n""",
    "train_tree": f"{_LEARNED} FROM test",
    "train_forest": f"{_LEARNED} FROM test",
    "train_boosted": f"WITH {_TEST} SELECT flow_id, label, label AS prediction FROM test",
    "train_leafwise": f"WITH {_TEST} SELECT flow_id, label, label AS prediction FROM test",
    "grid_search": f"{_LEARNED} FROM test",
    "compare_models": _COMPARED,
    "save_and_load_best": f"{_LEARNED}, 'DecisionTree' AS model FROM test",
    "feature_importance": f"""SELECT feature, CASE WHEN feature = 'SYN Flag Count' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance
        FROM {_FEATURE_NAMES}""",
    "permutation_importance": f"""WITH {_PERMUTED} SELECT feature,
        CASE WHEN feature = 'SYN Flag Count' THEN round(loss, 6) ELSE 0.0::DOUBLE END AS importance FROM {_FEATURE_NAMES}, moved""",
    "evaluate_best": f"""WITH {CELLS.replace(PRED, _TEST_PRED)}, report AS ({_report_rows()})
        SELECT *, 'DecisionTree' AS model FROM report""",
    "score_with_model": f"""WITH {DETECTIONS} SELECT src_ip, epoch_us(window_start) AS window_start,
        CAST(is_attack AS DOUBLE) AS score, is_attack FROM detections""",
    "distinct_sources_rollup": f"""WITH {PACKETS} SELECT DISTINCT epoch_us({_bucket('1 day')}) AS window_start, true AS close
        FROM packets""",
    "distinct_sources_sketch": f"""WITH {PACKETS} SELECT DISTINCT epoch_us({_bucket('1 day')}) AS window_start, true AS close
        FROM packets""",
    # sources and sinks
    "read_flows": f"""WITH {BROKEN} SELECT flow_id, 'flow, ' || flow_id AS "Flow ID", fwd, ack, round(len_mean, 9) AS len_mean,
        CASE WHEN duration < CAST('Infinity' AS DOUBLE) THEN duration END AS duration,
        coalesce(duration = CAST('Infinity' AS DOUBLE), false) AS endless, label_text AS "Label" FROM broken""",
    "read_flows_cleaned": f"""WITH {BROKEN}, n AS (SELECT (SELECT count(*) FROM broken) AS a, (SELECT count(*) FROM clean) AS b)
        SELECT a AS initial, a - b AS removed, round(CAST(a - b AS DOUBLE) / a * 100, 1) AS removed_pct,
        b AS remaining FROM n""",
    "parse_errors": f"""WITH {BROKEN}, c AS (SELECT unnest(['Total Fwd Packets', 'Total Backward Packets', 'Total Length of Fwd Packets',
          'SYN Flag Count', 'ACK Flag Count', 'Packet Length Mean', 'Packet Length Variance', 'Flow Duration', 'Flow IAT Mean']) AS "column")
        SELECT "column", CASE WHEN "column" = 'Flow Duration' THEN (SELECT count(*) FROM broken WHERE syn = 3 OR duration IS NOT NULL)
          ELSE (SELECT count(*) FROM broken) END AS present,
          CASE WHEN "column" = 'Flow Duration' THEN (SELECT count(*) FROM broken WHERE syn = 3) ELSE 0 END AS unparsable,
          CASE WHEN "column" = 'Flow Duration' THEN (SELECT 'n/a ' || min(flow_id) FROM broken WHERE syn = 3) END AS example FROM c""",
    "load_report": f"""WITH {BROKEN} SELECT label_text AS "Label", count(*) AS rows, CAST(11 AS INTEGER) AS columns
        FROM broken GROUP BY ALL""",
    "read_packets": f"WITH {PACKETS} SELECT src_ip, epoch_us(ts) AS ts, proto, tcp_syn, tcp_ack, pkt_len FROM packets",
    "decode_frames": f"""WITH {FRAMES} SELECT event_id, src_ip, epoch_us(ts) AS ts, proto,
        event_type IN ('click', 'view') AS tcp_syn, event_type = 'view' AS tcp_ack, size AS pkt_len FROM good""",
    "valid_ipv4": f"WITH {FRAMES} SELECT event_id, CAST(size AS INTEGER) AS size FROM good",
    "write_splits": f"""WITH {CLEAN_TABLE}, {_scaled(f'NOT ({_IN_TEST})')}
        SELECT CASE WHEN {_IN_TEST} THEN 'test' ELSE 'train' END AS part, * FROM scaled""",
    "write_alerts": f"WITH {ALERTS} SELECT {_ALERT_OUT} FROM alerts",
    "telemetry_global": f"""WITH {THROUGHPUT} SELECT 'global_throughput' AS measurement, epoch_us(window_end) AS ts,
        cum_pkts AS total_pkts, cum_bytes AS total_bytes, cum_dropped AS total_dropped FROM throughput
        WHERE window_end >= TIMESTAMP '2024-01-05' AND window_end < TIMESTAMP '2024-01-20'""",
    "telemetry_detection": f"""WITH {POINTS} SELECT measurement, epoch_us(ts) AS ts, src_ip, is_attack,
        {_rounded(POINT_FIELDS)} FROM points""",
    "telemetry_long": f"""WITH {POINTS} SELECT epoch_us(ts) AS ts, src_ip, is_attack, field, round(value, 6) AS value
        FROM (UNPIVOT points ON {', '.join(POINT_FIELDS)} INTO NAME field VALUE value)""",
    "telemetry_pivot": f"""WITH {POINTS} SELECT epoch_us(ts) AS ts, src_ip, is_attack,
        {_rounded(POINT_FIELDS)} FROM points""",
    "write_report": f"WITH {CELLS} {_report_rows()}",
    # packet and window expressions
    "classify_protocol": f"""WITH {PACKETS} SELECT src_ip, epoch_us(ts) AS ts,
        CASE proto WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' ELSE 'other' END AS proto_class,
        proto = 6 AND tcp_syn AS is_syn, proto = 6 AND tcp_ack AS is_ack FROM packets""",
    "feature_vector": f"""WITH {FEATURES} SELECT src_ip, epoch_us(window_start) AS window_start,
        {_rounded(FEATURE_NAMES)} FROM features""",
    **{
        name: f"""WITH {COUNTERS} SELECT src_ip, epoch_us(window_start) AS window_start, round({e}, 6) AS {name}
        FROM counters"""
        for name, e in DERIVED.items()
    },
    "rule_score": f"WITH {DETECTIONS} SELECT src_ip, epoch_us(window_start) AS window_start, score FROM scored",
    "threshold": f"""WITH {DETECTIONS} SELECT src_ip, epoch_us(window_start) AS window_start, score, is_attack
        FROM detections""",
    "decide_action": f"""WITH {DETECTIONS} SELECT src_ip, epoch_us(window_start) AS window_start,
        CASE WHEN is_attack THEN 'BLOCK' ELSE '-' END AS action,
        CASE WHEN is_attack THEN 'ALERT' ELSE '-' END AS without_blocking FROM detections""",
    "alert_rows": f"WITH {ALERTS} SELECT {_ALERT_OUT} FROM alerts",
    "alert_text": f"""WITH {ALERTS} SELECT epoch_us(timestamp) AS timestamp, src_ip,
        '[' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || '] ' || action || ' src=' || src_ip
        || printf(' score=%.4f pkts=%.0f bytes=%.0f syns=%.0f', score, pkt_count, byte_count, syn_count) AS line
        FROM alerts""",
    "webhook_payload": f"""WITH {ALERTS} SELECT epoch_us(timestamp) AS timestamp, src_ip,
        '🚨 DDoS Alert: ' || action || ' from ' || src_ip || printf(' (score: %.2f, pkts: %.0f)', score, pkt_count) AS text,
        action, pkt_count FROM alerts""",
    "int_to_ip_text": f"""WITH {PACKETS}, a AS (
          SELECT ts, CAST((CAST(src_ip AS HUGEINT) * 2654435761) % 4294967296 AS BIGINT) AS address FROM packets)
        SELECT epoch_us(ts) AS ts, address, {_IP.format(v='address')} AS text, address AS back FROM a""",
    "ip_to_int_value": f"""WITH {PACKETS} SELECT epoch_us(ts) AS ts,
        CASE proto WHEN 1 THEN {_IP.format(v='src_ip')} || '.9' WHEN 17 THEN '0' || {_IP.format(v='src_ip')}
          ELSE {_IP.format(v='src_ip')} END AS text,
        CASE WHEN proto IN (1, 17) THEN 0 ELSE src_ip END AS value FROM packets""",
    # flow expressions
    "clean_flows": f"WITH {BROKEN} SELECT {_BRIEF} FROM clean",
    "clean_flows_keep_copies": f"WITH {BROKEN} SELECT {_BRIEF} FROM kept",
    "cleaning_stats": f"""WITH {BROKEN}, n AS (SELECT (SELECT count(*) FROM broken) AS a, (SELECT count(*) FROM clean) AS b)
        SELECT a AS initial, a - b AS removed, round(CAST(a - b AS DOUBLE) / a * 100, 1) AS removed_pct,
        b AS remaining FROM n""",
    "flow_features": f"""WITH {FLOWS} SELECT flow_id, round({_SYN_ACK}, 6) AS "SYN_ACK_Ratio",
        round({_FLOW_ENTROPY}, 6) AS "Proto_Entropy" FROM flows""",
    "select_features": f"WITH {FLOW_TABLE} SELECT flow_id, {_rounded(FLOW_FEATURES, 9)}, label FROM ft",
    "class_of": f"""WITH {FLOWS} SELECT flow_id, label_text AS "Label",
        CASE WHEN label_text = 'BENIGN' THEN 'Benign' ELSE 'Attack' END AS class FROM flows""",
    "concat_flows": f"WITH {FLOWS} SELECT {_BRIEF} FROM flows",
    "fit_minmax": f"""WITH {FLOW_TABLE}, l AS ({_LONG}) SELECT feature, round(min(value), 6) AS min,
        round(max(value), 6) AS max, round(max(value) - min(value), 6) AS data_range,
        round(1.0::DOUBLE / CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END, 9) AS scale
        FROM l GROUP BY feature""",
    "apply_minmax": f"""WITH {FLOW_TABLE}, {_scaled(f'NOT ({_IN_TEST})')}
        SELECT * FROM scaled WHERE {_IN_TEST}""",
    "stratified_split": f"WITH {FLOW_TABLE} {_PARTS.format(test=_IN_TEST, source='ft')}",
    "stratified_split_exact": f"""WITH {FLOW_TABLE}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_HASH})
          - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM ft)
        {_PARTS.format(test='k < round(n * 0.2::DOUBLE)', source='r')}""",
    # joins
    "blacklist_filter": f"WITH {MARKED} SELECT src_ip, epoch_us(ts) AS ts, pkt_len FROM marked WHERE NOT dropped",
    "blacklist_dropped": f"WITH {MARKED} SELECT src_ip, epoch_us(ts) AS ts, pkt_len FROM marked WHERE dropped",
    "compare_predictions": f"""WITH {PRED}, b AS (SELECT DISTINCT id, round(score, 2) AS s2 FROM pred WHERE id NOT LIKE '%7'),
        j AS (SELECT *, CASE WHEN prediction = CAST(s2 > 0.5 AS INTEGER) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS same
              FROM pred FULL JOIN b USING (id))
        SELECT count(*) AS rows, count(*) FILTER (WHERE s2 IS NULL OR score IS NULL) AS missing, round(avg(same), 6) AS match_rate,
          round(max(abs(score - s2)), 6) AS max_abs_diff, avg(same) >= 0.99 AS passed FROM j""",
    "join_truth": f"""WITH {PRED}, t AS (SELECT DISTINCT id, label AS truth FROM pred WHERE id NOT LIKE '%7'),
        m AS (SELECT id, prediction, score FROM pred WHERE id NOT LIKE '%3')
        SELECT id, coalesce(t.truth, -1) AS label, coalesce(prediction, -1) AS prediction, coalesce(score, -1) AS score,
          t.truth IS NOT NULL AND score IS NOT NULL AS matched
        FROM m FULL JOIN t USING (id)""",
    "detection_latency": f"""WITH {ALERTS}, a AS (
          SELECT src_ip, min(ts) AS attack_at FROM packets WHERE tcp_syn GROUP BY src_ip),
        j AS (SELECT a.src_ip, attack_at, min(timestamp) AS alert_at FROM a
              LEFT JOIN alerts ON alerts.src = a.src_ip AND timestamp >= attack_at GROUP BY ALL),
        l AS (SELECT *, epoch_us(alert_at) - epoch_us(attack_at) AS latency_us FROM j)
        SELECT src_ip, epoch_us(attack_at) AS attack_at, epoch_us(alert_at) AS alert_at, latency_us,
          CASE WHEN latency_us IS NULL OR latency_us > 864000000000 THEN 'TIMEOUT'
               WHEN latency_us < 432000000000 THEN 'PASS' ELSE 'FAIL' END AS status FROM l""",
    "detection_latency_overall": f"""WITH {ALERTS}, a AS (SELECT min(ts) AS attack_at FROM packets WHERE tcp_syn),
        j AS (SELECT attack_at, min(timestamp) AS alert_at FROM a LEFT JOIN alerts ON timestamp >= attack_at GROUP BY ALL),
        l AS (SELECT *, epoch_us(alert_at) - epoch_us(attack_at) AS latency_us FROM j)
        SELECT epoch_us(attack_at) AS attack_at, epoch_us(alert_at) AS alert_at, latency_us,
          CASE WHEN latency_us IS NULL THEN 'TIMEOUT' WHEN latency_us < 2000000 THEN 'PASS' ELSE 'FAIL' END AS status FROM l""",
    # aggregations
    "source_counters": f"""WITH {PACKETS}, c AS (SELECT src_ip, {_counter_list(SPAN)} FROM packets GROUP BY src_ip),
        g AS (SELECT src_ip, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip ORDER BY ts) AS gap FROM packets),
        q AS (SELECT src_ip, coalesce(sum(CAST(gap AS DOUBLE) * gap), 0.0) AS s FROM g GROUP BY src_ip)
        SELECT src_ip, {COUNTS}, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen,
          round(s / 1e18, 6) AS iat_sq FROM c JOIN q USING (src_ip)""",
    "windowed_counters": f"""WITH {COUNTERS} SELECT src_ip, epoch_us(window_start) AS window_start,
        epoch_us(window_end) AS window_end, {COUNTS}, epoch_us(first_seen) AS first_seen,
        epoch_us(last_seen) AS last_seen FROM counters""",
    "windowed_counters_iat_squares": f"""WITH {_GAPS} SELECT src_ip, epoch_us(window_start) AS window_start,
        CAST(coalesce(sum(iat_us), 0) AS BIGINT) AS iat_sum_us,
        round(coalesce(sum(CAST(iat_us AS DOUBLE) * iat_us), 0.0::DOUBLE) / 1e18, 6) AS iat_sq
        FROM gaps GROUP BY src_ip, window_start""",
    "stream_gap_squares": f"""WITH {_GAPS} SELECT src_ip, epoch_us(window_start) AS window_start,
        CAST(coalesce(sum(iat_us), 0) AS BIGINT) AS iat_sum_us,
        round(coalesce(sum(CAST(iat_us AS DOUBLE) * iat_us), 0.0::DOUBLE) / 1e18, 6) AS iat_sq
        FROM gaps GROUP BY src_ip, window_start""",
    "windowed_counters_by_cpu": f"""WITH {PACKETS}, c AS (
          SELECT src_ip, cpu, {_bucket('1 day')} AS window_start, {_counter_list(SPAN)} FROM packets GROUP BY ALL)
        SELECT src_ip, epoch_us(window_start) AS window_start,
          {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS.split(', '))},
          epoch_us(min(first_seen)) AS first_seen, epoch_us(max(last_seen)) AS last_seen
        FROM c GROUP BY src_ip, c.window_start""",
    "merge_counters": f"""WITH {PACKETS}, h AS (
          SELECT src_ip, {_bucket('1 hour')} AS hour, {_counter_list(SPAN)} FROM packets GROUP BY ALL),
        d AS (SELECT *, time_bucket(INTERVAL '5 days', hour, TIMESTAMP '1970-01-01') AS start FROM h)
        SELECT src_ip, epoch_us(start) AS window_start,
          {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTS.split(', '))},
          epoch_us(min(first_seen)) AS first_seen, epoch_us(max(last_seen)) AS last_seen
        FROM d GROUP BY src_ip, d.start""",
    "global_throughput": f"""WITH {THROUGHPUT} SELECT epoch_us(window_start) AS window_start,
        epoch_us(window_end) AS window_end, total_pkts, total_bytes, total_dropped, cum_pkts, cum_bytes, cum_dropped
        FROM throughput""",
    "class_distribution": f"""WITH {BROKEN} SELECT label_text AS "Label", count(*) AS count FROM broken GROUP BY ALL""",
    "describe_features": f"""WITH {FLOW_TABLE}, l AS ({_LONG}), s AS (SELECT feature, count(*) AS count, avg(value) AS mean,
          stddev_samp(value) AS std, min(value) AS min, {_QUARTILES}, max(value) AS max FROM l GROUP BY feature)
        SELECT feature, count, {_rounded(['mean', 'std', 'min', 'q25', 'q50', 'q75', 'max'], 2)} FROM s""",
    "correlation_matrix": f"WITH {FLOW_TABLE} {_CORR}",
    "box_stats": f"""WITH {FLOW_TABLE}, l AS (
          SELECT CASE WHEN label_text = 'BENIGN' THEN 'Benign' ELSE 'Attack' END AS class, feature, value FROM ({_LONG})),
        q AS (SELECT class, feature, {_QUARTILES} FROM l GROUP BY class, feature),
        f AS (SELECT l.*, q.q25, q.q50, q.q75, q.q25 - 1.5 * (q.q75 - q.q25) AS lo, q.q75 + 1.5 * (q.q75 - q.q25) AS hi
              FROM l JOIN q USING (class, feature)),
        s AS (SELECT class, feature, q25, q50, q75, count(*) AS count,
                least(min(value) FILTER (WHERE value >= lo), q25) AS whisker_low,
                greatest(max(value) FILTER (WHERE value <= hi), q75) AS whisker_high,
                count(*) FILTER (WHERE value < lo OR value > hi) AS outliers FROM f GROUP BY class, feature, q25, q50, q75)
        SELECT class, feature, count, {_rounded(['q25', 'q50', 'q75', 'whisker_low', 'whisker_high'], 8)}, outliers FROM s""",
    "confusion_matrix": f"""WITH {CELLS} SELECT 0 AS label, 0 AS prediction, tn AS count FROM cells
        UNION ALL SELECT 0, 1, fp FROM cells UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells""",
    "binary_metrics": f"""WITH {CELLS} SELECT round({_div('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy,
        round({_REPORT['1'][0]}, 4) AS "precision", round({_REPORT['1'][1]}, 4) AS recall, round({_REPORT['1'][2]}, 4) AS f1,
        round({_div('fp', 'fp + tn')}, 6) AS fpr FROM cells""",
    "classification_report": f"WITH {CELLS} {_report_rows()}",
    "latency_summary": """SELECT count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
        round(stddev_pop(l_quantity), 6) AS std, round(quantile_cont(l_quantity, 0.5), 6) AS median,
        round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(quantile_cont(l_quantity, 0.99), 6) AS p99,
        round(max(l_quantity), 6) AS max,
        round(avg(CASE WHEN l_quantity < 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 6) AS pct_under_target
        FROM lineitem""",
    "histogram": """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
        b AS (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin),
        c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) AS INTEGER) AS bin, count(*) AS count
              FROM events, e GROUP BY ALL)
        SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50.0::DOUBLE), 6) AS low,
          round(lo + (b.bin + 1) * ((hi - lo) / 50.0::DOUBLE), 6) AS high, coalesce(c.count, 0) AS count
        FROM b LEFT JOIN c USING (bin), e""",
    # ordered analyses
    "inter_arrival": f"""WITH {_GAPS} SELECT src_ip, epoch_us(window_start) AS window_start, epoch_us(ts) AS ts,
        packets, iat_us FROM gaps""",
    "rate_packets": _rate("cum_pkts"),
    "rate_bytes": _rate("cum_bytes"),
    "rate_with_resets": f"""WITH {PACKETS}, t AS ({_throughput('packets', '1 hour', 'false')}),
        s AS (SELECT window_end AS ts, CAST(total_pkts AS DOUBLE) AS v,
          lag(CAST(total_pkts AS DOUBLE)) OVER (ORDER BY window_end) AS pv,
          lag(window_end) OVER (ORDER BY window_end) AS pt FROM t),
        h AS (SELECT *, CAST(epoch_us(ts) - epoch_us(pt) AS DOUBLE) / 3600000000 AS hours FROM s WHERE pt IS NOT NULL)
        SELECT epoch_us(ts) AS ts, round(CASE WHEN v >= pv THEN v - pv END / hours, 6) AS rate,
          round(CASE WHEN v >= pv THEN v - pv ELSE v END / hours, 6) AS from_zero FROM h""",
    "last_value": f"""WITH {THROUGHPUT}, l AS (SELECT max(window_end) AS ts, arg_max(cum_dropped, window_end) AS d FROM throughput)
        SELECT epoch_us(ts) AS ts, d AS total_dropped,
          CASE WHEN d >= 1000 THEN 'red' WHEN d >= 100 THEN 'yellow' ELSE 'green' END AS band FROM l""",
    "roc_curve": f"""WITH {CURVE} SELECT round(score, 6) AS threshold, round(CAST(fp AS DOUBLE) / n, 6) AS fpr,
        round(CAST(tp AS DOUBLE) / p, 6) AS tpr FROM c
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE""",
    "roc_auc": f"""WITH {CURVE} SELECT round(sum(CAST(neg AS DOUBLE) * (2 * tp - pos)) / (max(CAST(p AS DOUBLE)) * max(n) * 2), 6)
        AS roc_auc FROM c""",
    "pr_curve": f"""WITH {CURVE} SELECT round(score, 6) AS threshold, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS "precision",
        round(CAST(tp AS DOUBLE) / p, 6) AS recall FROM c
        UNION ALL SELECT CAST('Infinity' AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""",
    "average_precision": f"""WITH {CURVE} SELECT round(sum(CAST(pos AS DOUBLE) * tp / (tp + fp)) / max(CAST(p AS DOUBLE)), 6)
        AS average_precision FROM c""",
    "score_timeline": f"""WITH {POINTS} SELECT src_ip, epoch_us(ts) AS ts, score,
        CASE WHEN score >= 0.85 THEN 'red' WHEN score >= 0.5 THEN 'yellow' ELSE 'green' END AS band FROM points""",
    "attack_log": f"""WITH {POINTS} SELECT epoch_us(ts) AS ts, src_ip, {_rounded(POINT_FIELDS)} FROM points
        WHERE is_attack = 'true' QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC) <= 3""",
    "dashboard_scores": f"""WITH {POINTS} SELECT src_ip, epoch_us(ts) AS ts, score,
        CASE WHEN score >= 0.85 THEN 'red' WHEN score >= 0.5 THEN 'yellow' ELSE 'green' END AS band FROM points WHERE {_IN_RANGE}""",
    "dashboard_attacks": f"""WITH {POINTS} SELECT epoch_us(ts) AS ts, src_ip, {_rounded(POINT_FIELDS)} FROM points
        WHERE is_attack = 'true' AND {_IN_RANGE} QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC) <= 3""",
    "dashboard_rate": _rate("cum_pkts").replace("FROM throughput)", f"FROM throughput WHERE {_IN_RANGE.replace('ts', 'window_end')})"),
    "attack_log_all": f"""WITH {POINTS}, newest AS (
          SELECT * FROM points WHERE is_attack = 'true' ORDER BY ts DESC, src_ip LIMIT 50)
        SELECT epoch_us(ts) AS ts, src_ip, {_rounded(POINT_FIELDS)} FROM newest""",
    "rank_models": f"""WITH {PRED}, r AS ({_RANK_MODELS})
        SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, inference_us, model) AS INTEGER) AS place FROM r""",
    "rank_importance": f"WITH {FLOW_TABLE} {_IMPORTANCE}",
    # block loop and replay
    "block_sources": f"""{_RECURSIVE} {VERDICTS} SELECT src_ip, us AS window_start, is_attack, state, blocked_until
        FROM verdicts""",
    "block_sources_for_good": f"""{_RECURSIVE} {VERDICTS_FOREVER} SELECT src_ip, us AS window_start, state FROM verdicts""",
    "replay_alerts": f"{_RECURSIVE} {VERDICTS} {_VERDICT_ALERTS}",
    "replay_throughput": f"""{_RECURSIVE} {VERDICTS}, m AS (
          SELECT p.*, EXISTS (SELECT 1 FROM verdicts v WHERE v.state = 'BLOCK' AND v.src_ip = p.src_ip
            AND epoch_us(p.ts) >= v.ue AND epoch_us(p.ts) < v.until) AS dropped FROM packets p),
        t AS ({_throughput('m', '1 day', 'dropped')})
        SELECT epoch_us(window_start) AS window_start, total_pkts, total_bytes, total_dropped FROM t""",
    # streaming
    "stream_features": f"""WITH {FEATURES} SELECT src_ip, epoch_us(window_start) AS window_start,
        {_rounded(FEATURE_NAMES)} FROM features""",
    "stream_throughput": f"""WITH {PACKETS}, t AS ({_throughput('packets', '1 hour', 'false')})
        SELECT epoch_us(window_start) AS window_start, total_pkts, total_bytes, total_dropped FROM t""",
    "stream_late_rows": f"""WITH {PACKETS}, w AS (
          SELECT event_id % 10 AS turn, epoch_us(ts) AS us, {_bucket('1 hour')} AS ws,
            (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_id % 10 > 1) AS first,
            (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_id % 10 > 0) AS second
          FROM packets),
        j AS (SELECT *, CASE turn WHEN 1 THEN first WHEN 0 THEN second END AS passed FROM w),
        k AS (SELECT *, coalesce(epoch_us(ws) + 3600000000 <= passed, false) AS late FROM j)
        SELECT epoch_us(ws) AS window_start, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late,
          coalesce(max(passed - us) FILTER (late), 0) AS latest_us FROM k GROUP BY ws""",
    "stream_late": f"""WITH {PACKETS}, seen AS (SELECT * FROM packets WHERE event_id % 10 <> 0 OR
          epoch_us({_bucket('1 hour')}) + 3600000000 > (SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_id % 10 > 1)),
        t AS ({_throughput('seen', '1 hour', 'false')})
        SELECT epoch_us(window_start) AS window_start, total_pkts, total_bytes, total_dropped FROM t""",
    "stream_block": f"{_RECURSIVE} {VERDICTS} SELECT src_ip, us AS window_start, state, blocked_until FROM verdicts",
    "stream_dropped": f"""{_RECURSIVE} {VERDICTS}
        SELECT p.src_ip, epoch_us({_bucket('1 day')}) AS window_start, count(*) AS packets, CAST(sum(p.pkt_len) AS BIGINT) AS bytes
        FROM packets p WHERE EXISTS (SELECT 1 FROM verdicts v WHERE v.state = 'BLOCK' AND v.src_ip = p.src_ip
            AND epoch_us(p.ts) >= v.ue AND epoch_us(p.ts) < v.until)
        GROUP BY ALL""",
    "stream_alerts": f"{_RECURSIVE} {VERDICTS} {_VERDICT_ALERTS}",
    "stream_global_throughput": f"""{_RECURSIVE} {VERDICTS}, m AS (
          SELECT p.*, EXISTS (SELECT 1 FROM verdicts v WHERE v.state = 'BLOCK' AND v.src_ip = p.src_ip
            AND epoch_us(p.ts) >= v.ue AND epoch_us(p.ts) < v.until) AS dropped FROM packets p),
        per_window AS ({_throughput('m', '1 day', 'dropped')})
        SELECT epoch_us(window_start) AS window_start, total_pkts, total_bytes, total_dropped, {_CUM} FROM per_window""",
    # frames
    "frames_throughput": f"""WITH {_FRAMES_MARKED}, per_window AS ({_throughput('counted', '1 hour', 'dropped')})
        SELECT epoch_us(window_start) AS window_start, total_pkts, total_bytes, total_dropped, {_CUM} FROM per_window""",
    "frames_to_verdicts": f"""{_RECURSIVE} {VERDICTS.replace(PACKETS, _FRAME_PACKETS)}
        SELECT src_ip, us AS window_start, is_attack, state, blocked_until FROM verdicts""",
    # sketches and key statistics
    "count_min_sketch": f"WITH {SKETCH} SELECT * FROM sk",
    "cms_estimate": f"""WITH {SKETCH}, k AS (SELECT src_ip, count(*) AS exact FROM packets GROUP BY src_ip),
        e AS (SELECT src_ip, exact, min(count) AS estimate FROM (
                SELECT k.src_ip, k.exact, sk.count FROM k, (SELECT unnest([0, 1, 2, 3]) AS r) rr
                JOIN sk ON sk.row = rr.r AND sk.bucket = {_SKETCH_BUCKET.replace('src_ip', 'k.src_ip').replace("md5(r ", "md5(rr.r ")}) GROUP BY ALL)
        SELECT src_ip, exact, estimate, estimate - exact AS overcount FROM e""",
    "heavy_hitters": f"""WITH {PACKETS} SELECT src_ip, CAST(sum(pkt_len) AS BIGINT) AS total FROM packets GROUP BY src_ip
        ORDER BY total DESC, src_ip LIMIT 20""",
    "distinct_sources": f"""WITH {PACKETS} SELECT epoch_us({_bucket('1 day')}) AS window_start,
        count(DISTINCT src_ip) AS sources FROM packets GROUP BY ALL""",
    "key_entropy": f"""WITH {PACKETS}, c AS (SELECT {_bucket('1 day')} AS w, src_ip, CAST(count(*) AS DOUBLE) AS c FROM packets GROUP BY ALL),
        t AS (SELECT *, sum(c) OVER (PARTITION BY w) AS n FROM c)
        SELECT epoch_us(w) AS window_start, count(*) AS keys, round(0.0 - sum(c / n * log2(c / n)), 6) AS entropy
        FROM t GROUP BY w""",
    "rate_threshold": f"""WITH {COUNTERS} SELECT src_ip, epoch_us(window_start) AS window_start,
        round(CAST(syn_count AS DOUBLE) / 86400, 9) AS syn_rate, CAST(syn_count AS DOUBLE) / 86400 > {2 / 86400!r}::DOUBLE AS is_attack
        FROM counters""",
}
