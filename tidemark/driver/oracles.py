"""Plain SQL for the same results, written without the tricks of the operators.

Windows run over whole entities, every boundary is compared with every row, and
moments are computed in two passes.
"""

from __future__ import annotations

from ..presets import icu
from . import settings as cfg


def r6(x: str) -> str:
    return f"round(round({x}, 9) + 4e-10, 6)"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _flag(name: str) -> str:
    return f"max(CASE WHEN event_type IN {_in(cfg.FLAG_CODES[name])} THEN 1 ELSE 0 END) AS {name}"


FLAGS = f"""flags AS (
  SELECT user_id, ts, {', '.join(_flag(f) for f in cfg.FLAG_CODES)}
  FROM events GROUP BY user_id, ts)"""

# What came before a row is looked up, an episode's number counts the openings so far.
MARKS = f"""active AS (SELECT user_id, ts, end_flag FROM flags WHERE on_flag + end_flag > 0),
running AS (SELECT user_id, ts FROM flags WHERE on_flag = 1),
seen AS (
  SELECT f.*, f.on_flag + f.end_flag > 0 AS is_active, a.end_flag AS ended_before, r.ts AS on_before
  FROM flags f ASOF LEFT JOIN active a ON a.user_id = f.user_id AND a.ts < f.ts
  ASOF LEFT JOIN running r ON r.user_id = f.user_id AND r.ts < f.ts),
openings AS (
  SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM seen
  WHERE (is_active AND ended_before = 1) OR (alt_flag = 1 AND on_flag = 0)
    OR (on_flag = 1 AND on_before < ts - INTERVAL {int(cfg.GAP_HOURS)} HOUR)),
marks AS (
  SELECT s.user_id, s.ts, s.on_flag, CASE WHEN o.ts = s.ts THEN 1 ELSE 0 END AS opens,
    CASE WHEN is_active THEN coalesce(o.nth, 0) END AS episode_no
  FROM seen s ASOF LEFT JOIN openings o ON o.user_id = s.user_id AND o.ts <= s.ts)"""

EPISODES = f"""{FLAGS}, {MARKS},
stretches AS (
  SELECT user_id, min(ts) AS starttime, max(ts) AS endtime FROM marks
  WHERE episode_no IS NOT NULL GROUP BY user_id, episode_no
  HAVING count(*) > 1 AND bool_or(on_flag = 1)),
eps AS (
  SELECT user_id, (SELECT count(*) FROM stretches o
      WHERE o.user_id = s.user_id AND o.starttime <= s.starttime) AS ventnum,
    starttime, endtime, date_sub('second', starttime, endtime) / 3600.0::DOUBLE AS duration_hours
  FROM stretches s)"""

PAIRS = f"""{EPISODES},
ends AS (SELECT user_id, ts AS event_ts FROM flags WHERE special_flag = 1),
apart AS (
  SELECT user_id, starttime, endtime, event_ts, duration_hours,
    abs(date_sub('hour', endtime, event_ts)) AS se_diff
  FROM eps JOIN ends USING (user_id)),
pairs AS (
  SELECT user_id, starttime, endtime, event_ts, duration_hours, se_diff
  FROM apart JOIN (SELECT user_id, min(se_diff) AS se_diff FROM apart GROUP BY user_id)
    USING (user_id, se_diff))"""

BODY = """scales(event_type, what, factor) AS (
  VALUES ('click', 'height', 2.54::DOUBLE), ('signup', 'height', 1), ('view', 'weight', 1),
    ('error', 'weight', 0.45359237)),
body AS (
  SELECT *, weight / (height / 100 * height / 100) AS bmi FROM (
    SELECT user_id, first(value * factor ORDER BY ts, value * factor)
        FILTER (WHERE what = 'height') AS height,
      first(value * factor ORDER BY ts, value * factor) FILTER (WHERE what = 'weight') AS weight
    FROM events JOIN scales USING (event_type) WHERE value <> 0 GROUP BY user_id))"""

COHORT = f"""{PAIRS}, {BODY},
named AS (
  SELECT p.*, round(b.weight, 2) AS weight, round(b.height, 2) AS height, b.bmi, c.c_name, c.c_nationkey
  FROM pairs p LEFT JOIN body b ON p.user_id = b.user_id
  LEFT JOIN customer c ON p.user_id = c.c_custkey),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration_hours DESC,
    CASE WHEN event_ts >= endtime THEN event_ts - endtime END NULLS LAST, event_ts, endtime) AS rn
  FROM named),
cohort AS (SELECT * FROM ranked WHERE rn = 1)"""

IMPUTED = """spots AS (
  SELECT user_id, event_type, ts, avg(value) AS value FROM events
  WHERE event_type IS NOT NULL GROUP BY ALL),
mesh AS (
  SELECT t.user_id, c.event_type, t.ts, s.value,
    row_number() OVER (PARTITION BY t.user_id, c.event_type ORDER BY t.ts) AS pos
  FROM (SELECT DISTINCT user_id, ts FROM spots) t
  JOIN (SELECT DISTINCT user_id, event_type FROM spots) c ON t.user_id = c.user_id
  LEFT JOIN spots s ON s.user_id = t.user_id AND s.event_type = c.event_type AND s.ts = t.ts),
around AS (
  SELECT user_id, event_type, ts, value, pos,
    last_value(value IGNORE NULLS) OVER back AS pv,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS pp,
    first_value(value IGNORE NULLS) OVER ahead AS nv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS np
  FROM mesh
  WINDOW back AS (PARTITION BY user_id, event_type ORDER BY ts
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    ahead AS (PARTITION BY user_id, event_type ORDER BY ts
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
imputed AS (
  SELECT user_id, event_type, ts, CASE WHEN value IS NOT NULL THEN value
    WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
    ELSE (nv - pv) / (np - pp) * (pos - pp) + pv END AS value,
    coalesce(pv, nv) AS filled
  FROM around)"""

_at = {c: f"max(CASE WHEN event_type = '{c}' THEN value END) AS {c}" for c in cfg.CHANNELS}
DERIVED = f"""{IMPUTED},
wide_at AS (SELECT user_id, ts, {', '.join(_at.values())} FROM imputed GROUP BY user_id, ts),
long AS (
  SELECT user_id, event_type, ts, value FROM imputed WHERE value IS NOT NULL
  UNION ALL SELECT user_id, 'click', ts, error + signup FROM wide_at
    WHERE error + signup IS NOT NULL
  UNION ALL SELECT user_id, 'ratio', ts, purchase / nullif("view" / 1000.0, 0) FROM wide_at
    WHERE purchase / nullif("view" / 1000.0, 0) IS NOT NULL
  UNION ALL SELECT user_id, 'product', ts, purchase * ("view" / 1000.0) FROM wide_at
    WHERE purchase * ("view" / 1000.0) IS NOT NULL)"""

RAW_LONG = """long AS (SELECT user_id, event_type, ts, value FROM events)"""

LINES_LONG = """long AS (
  SELECT l_orderkey AS user_id, l_returnflag AS event_type, CAST(l_shipdate AS TIMESTAMP) AS ts,
    CAST(l_quantity AS DOUBLE) AS value FROM lineitem)"""


def _segs(hours: int) -> str:
    return f"""spans AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM long GROUP BY user_id),
segs AS (
  SELECT user_id, CAST(j AS INTEGER) AS label,
    t1 - to_hours(CAST(j * {hours} AS INTEGER)) AS seg_start_time,
    t1 - to_hours(CAST((j - 1) * {hours} AS INTEGER)) AS seg_end_time
  FROM (SELECT *, unnest(generate_series(1,
      (date_sub('microsecond', t0, t1) + {hours * 3600000000 - 1})
        // {hours * 3600000000})) AS j
    FROM spans))"""


SEGS = _segs(cfg.SEG_HOURS)

_SNAPS = """
limits AS (
  SELECT DISTINCT s.user_id, c.event_type, s.label, s.seg_start_time, s.seg_end_time
  FROM segs s JOIN (SELECT DISTINCT user_id, event_type FROM long) c ON s.user_id = c.user_id),
times AS (SELECT DISTINCT user_id, event_type, ts FROM long),
low AS (
  SELECT l.user_id, l.event_type, l.label, t.ts AS start_ts, row_number() OVER (
      PARTITION BY l.user_id, l.event_type, l.label
      ORDER BY abs(date_sub('microsecond', l.seg_start_time, t.ts)), t.ts) AS rn
  FROM limits l JOIN times t ON l.user_id = t.user_id AND l.event_type = t.event_type),
high AS (
  SELECT l.user_id, l.event_type, l.label, t.ts AS end_ts, row_number() OVER (
      PARTITION BY l.user_id, l.event_type, l.label
      ORDER BY abs(date_sub('microsecond', l.seg_end_time, t.ts)), t.ts) AS rn
  FROM limits l JOIN times t ON l.user_id = t.user_id AND l.event_type = t.event_type),
snapped AS (
  SELECT l.*, a.start_ts, b.end_ts FROM limits l
  JOIN low a ON a.user_id = l.user_id AND a.event_type = l.event_type AND a.label = l.label
    AND a.rn = 1
  JOIN high b ON b.user_id = l.user_id AND b.event_type = l.event_type AND b.label = l.label
    AND b.rn = 1)"""

SNAPS = f"{SEGS},{_SNAPS}"


def _stats(segs: str, mode: str = "v") -> str:
    """Statistics of every segment; ``mode`` is the value whose mode is taken."""
    return f"""{segs},{_SNAPS},
members AS (
  SELECT s.user_id, s.event_type, s.label, s.seg_start_time, s.seg_end_time, d.value AS v,
    avg(d.value) OVER (PARTITION BY s.user_id, s.event_type, s.label) AS m
  FROM snapped s JOIN long d ON d.user_id = s.user_id AND d.event_type = s.event_type
    AND d.ts BETWEEN s.start_ts AND s.end_ts),
counted AS (
  SELECT user_id, event_type, label, {mode} AS v, count(*) AS c FROM members GROUP BY ALL),
modes AS (
  SELECT user_id, event_type, label, v AS mode_v FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type, label
      ORDER BY c DESC, v) AS rn FROM counted) WHERE rn = 1),
sums AS (
  SELECT user_id, event_type, label, seg_start_time, seg_end_time, avg(v) AS mean_v,
    median(v) AS median_v, min(v) = max(v) AS flat, CAST(count(v) AS DOUBLE) AS n,
    sum((v - m) * (v - m)) AS m2, sum((v - m) * (v - m) * (v - m)) AS m3,
    sum((v - m) * (v - m) * (v - m) * (v - m)) AS m4
  FROM members GROUP BY ALL),
stats AS (
  SELECT s.user_id, s.event_type, s.label, s.seg_start_time, s.seg_end_time,
    mean_v AS mean, median_v AS median, mode_v AS mode,
    CASE WHEN n < 4 THEN NULL WHEN flat THEN 0.0 ELSE
      (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6) END AS kurtosis,
    CASE WHEN n < 3 THEN NULL WHEN flat THEN 0.0 ELSE
      (m3 / n) / pow(m2 / n, 1.5) * sqrt(n * (n - 1)) / (n - 2) END AS skew,
    CASE WHEN n < 2 THEN NULL ELSE sqrt(m2 / (n - 1)) END AS std
  FROM sums s JOIN modes USING (user_id, event_type, label))"""


STATS = _stats(SEGS)
FILLED_STATS = _stats(SEGS, f"round(v, {cfg.MODE_DECIMALS})")


def _wide(channels, stats, rounded=True) -> str:
    cols = []
    for c in channels:
        for s in stats:
            v = f"max(CASE WHEN event_type = '{c}' THEN {s} END)"
            cols.append(f"{r6(v) if rounded else v} AS {c}_{s}")
    return ",\n    ".join(cols)


KEYS = "user_id, label, seg_start_time, seg_end_time"
MEAN_NAMES = [f"{c}_{s}" for c in cfg.CHANNELS for s in ("mean", "std")]
ALL_NAMES = [f"{c}_{s}" for c in cfg.FEATURE_CHANNELS for s in cfg.STATS]
MEANS = f"""{RAW_LONG}, {STATS},
features AS (SELECT {KEYS},
    {_wide(cfg.CHANNELS, ("mean", "std"), False)}
  FROM stats GROUP BY {KEYS})"""
FULL = f"""{DERIVED}, {FILLED_STATS},
features AS (SELECT {KEYS},
    {_wide(cfg.FEATURE_CHANNELS, cfg.STATS, False)}
  FROM stats GROUP BY {KEYS})"""
NEAR = int(cfg.TOTAL_HOURS // cfg.SEG_HOURS)


def _long_features(names, alias="features", extra="") -> str:
    return " UNION ALL ".join(
        f"SELECT {KEYS}, '{n}' AS feature, {n} AS value FROM {alias}{extra}" for n in names)


def _kept(names) -> str:
    return f"""counts AS (
  SELECT label, feature, count(*) AS n_rows, count(value) AS n_known
  FROM near_long GROUP BY label, feature),
kept AS (
  SELECT feature, max(CASE WHEN n_known >= n_rows * (2.0::DOUBLE / 3) THEN 1 ELSE 0 END) AS kept
  FROM counts GROUP BY feature)"""


_TRAIN = f"""{FULL},
all_long AS ({_long_features(ALL_NAMES)}),
near_long AS (SELECT * FROM all_long WHERE label <= {NEAR}),
{_kept(ALL_NAMES)},
means AS (SELECT feature, avg(value) AS mean FROM all_long GROUP BY feature)"""

_CONVERTED = """CASE WHEN event_type = 'error' THEN (value - 32) / 1.8
    WHEN event_type = 'purchase' THEN value * 1000 ELSE value END"""
_SIGNAL = f"""opened AS (
  SELECT vec_id AS record, CASE label % 5 WHEN 0 THEN 'ABPSys' WHEN 1 THEN 'NBP SYS'
      WHEN 2 THEN 'RESP' WHEN 3 THEN '%SpO2' ELSE 'HR' END AS channel,
    unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings),
samples AS (
  SELECT record, channel, value, TIMESTAMP '{cfg.SIGNAL_START}'
    + to_seconds(CAST(i * round_even(1 / {cfg.SIGNAL_FS}::DOUBLE, 0) AS BIGINT)) AS time
  FROM opened)"""
# The test part of the training table: the lowest fifth of each label by a mixed key.
_TEST = f"""{RAW_LONG}, {SEGS},
numbered AS (
  SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label
      ORDER BY (user_id * 1000 + label) * {cfg.SPLIT_MULTIPLIER} % {cfg.SPLIT_PRIME}, user_id) AS nth
  FROM segs WHERE label <= {NEAR}),
test AS (SELECT * FROM numbered WHERE nth <= floor(n * 0.2::DOUBLE + 0.5))"""

_REPORT = """sides AS (
  SELECT quality AS class, 1 AS support, 0 AS named,
    CASE WHEN quality = toxic THEN 1 ELSE 0 END AS hits FROM labels
  UNION ALL SELECT toxic, 0, 1, 0 FROM labels),
totals AS (
  SELECT class, CAST(sum(support) AS BIGINT) AS support, sum(named)::DOUBLE AS named,
    sum(hits)::DOUBLE AS hits FROM sides GROUP BY class),
report AS (
  SELECT class, support, coalesce(hits / nullif(named, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall FROM totals)"""

def _coded(codes) -> str:
    texts = ", ".join(f"'{t}'" for t in cfg.CHART_TEXTS)
    return f"""coded AS (
  SELECT user_id AS subject_id, user_id AS icustay_id, ts AS charttime,
    list_extract([{', '.join(map(str, codes))}], event_id % {len(codes)} + 1) AS itemid,
    list_extract([{texts}], (event_id // 7) % {len(cfg.CHART_TEXTS)} + 1) AS value,
    value AS valuenum, CASE WHEN value > 200 THEN 1 WHEN value >= 5 THEN 0 END AS error
  FROM events)"""


def _codes(codes) -> str:
    return f"itemid IN ({', '.join(map(str, codes))})"


def _within(b) -> str:
    sides = []
    if b.low is not None:
        sides.append(f"valuenum {'>=' if b.low_closed else '>'} {b.low}")
    if b.high is not None:
        sides.append(f"valuenum {'<=' if b.high_closed else '<'} {b.high}")
    return " AND ".join(sides) or "TRUE"


def _label_case(rules) -> str:
    return "CASE " + " ".join(f"WHEN {_codes(r.codes)} AND {_within(r.bounds)} THEN '{r.label}'"
                              for r in rules) + " END"


def _value_case(conversions, repairs=()) -> str:
    out = "CASE"
    for c in conversions:
        out += (f" WHEN {_codes(c.codes)} THEN (valuenum - {c.offset}) * {c.factor}::DOUBLE"
                f" / {c.divisor}::DOUBLE")
    for r in repairs:
        inner = " ".join(
            f"WHEN {_within(b)} THEN {'NULL' if f is None else f'valuenum * {f}::DOUBLE'}"
            for b, f in r.pieces)
        out += (f" WHEN {_codes(r.codes)} THEN CASE {inner} ELSE "
                f"{'valuenum' if r.keep_rest else 'NULL'} END")
    return out + " ELSE valuenum END"


def _unit_case(units) -> str:
    return "CASE " + " ".join(f"WHEN {_codes(u.codes)} THEN '{u.unit}'" for u in units) + " END"


def _flag_case(matches) -> str:
    tests = []
    for m in matches:
        test = _codes(m.codes)
        if m.texts is not None:
            test += f" AND value IN {_in(m.texts)}"
        if m.not_texts:
            test += f" AND value NOT IN {_in(m.not_texts)}"
        tests.append(f"({test})")
    return f"max(CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END)"


_STATUS = ", ".join(f"{_flag_case(m)} AS {name}" for name, m in icu.STATUS_FLAGS.items())

# The candidates of the published searches, in order.
_GRIDS = {
    "rf_train": """SELECT d::INTEGER AS max_depth, n::INTEGER AS num_trees
  FROM range(2, 11, 2) a(d), range(20, 301, 20) b(n) ORDER BY d, n""",
    "gbt_train": "SELECT n::INTEGER AS max_iter FROM range(20, 201, 10) a(n) ORDER BY n",
    "boost_shape": """SELECT d::INTEGER AS max_depth, s::INTEGER AS min_split, l::INTEGER AS min_leaf
  FROM range(2, 5, 2) a(d), range(5, 31, 5) b(s), range(2, 7, 2) c(l) ORDER BY d, s, l""",
    "boost_sample": """SELECT unnest([0.6, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS subsample""",
    "boost_rate": """SELECT pow(10::DOUBLE, -3 + i / 3) AS rate, n::INTEGER AS max_iter
  FROM range(0, 10) a(i), range(20, 201, 20) b(n) ORDER BY i, n""",
}

ORACLES: dict[str, str] = {
    "icu_chart": f"""WITH {EPISODES}, {_coded(cfg.CHART_CODES)},
longest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration_hours DESC, starttime) AS rn
  FROM eps)
SELECT subject_id, icustay_id, charttime, {_label_case(icu.CHANNEL_RULES)} AS vital_sign,
  {r6(_value_case(icu.CHANNEL_CONVERSIONS, icu.CHANNEL_REPAIRS))} AS valuenum,
  {_unit_case(icu.CHANNEL_UNITS)} AS unit
FROM coded JOIN longest ON icustay_id = user_id AND rn = 1
  AND charttime BETWEEN starttime AND endtime
WHERE error IS DISTINCT FROM 1
UNION ALL
SELECT e.user_id, e.user_id, e.ts, CASE WHEN e.value >= 1 AND e.value <= 800 THEN 'PaO2' END,
  {r6('e.value')}, 'mmHg'
FROM events e JOIN longest l ON e.user_id = l.user_id AND l.rn = 1
  AND e.ts BETWEEN l.starttime AND l.endtime
WHERE e.event_type = 'signup'""",
    "icu_status": f"""WITH {_coded(cfg.STATUS_CODES)}
SELECT icustay_id, charttime, {_STATUS}
FROM coded WHERE value <> '' AND error IS DISTINCT FROM 1 AND {_codes(icu.STATUS_CODES)}
GROUP BY icustay_id, charttime
UNION
SELECT o_custkey, o_orderdate, 0, 0, 1, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END
FROM orders WHERE o_orderstatus IN ('F', 'P')""",
    "icu_body": f"""WITH {_coded(cfg.BODY_CODES)},
shaped AS (
  SELECT icustay_id, subject_id, charttime, {_label_case(icu.BODY_RULES)} AS p,
    {_value_case(icu.BODY_CONVERSIONS)} AS v
  FROM coded WHERE error IS DISTINCT FROM 1 AND valuenum <> 0
    AND {_codes([c for r in icu.BODY_RULES for c in r.codes])}),
wide AS (
  SELECT icustay_id, subject_id, first(v ORDER BY charttime, v) FILTER (WHERE p = 'height') AS height,
    first(v ORDER BY charttime, v) FILTER (WHERE p = 'weight') AS weight
  FROM shaped GROUP BY icustay_id, subject_id)
SELECT icustay_id, subject_id, round(height, 2) AS height, round(weight, 2) AS weight,
  {r6('weight / (height / 100 * height / 100)')} AS bmi
FROM wide""",
    "rule_label": f"""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND value > 0 AND value < 100 THEN 'rate'
    WHEN event_type = 'error' AND value >= 10 AND value < 50 THEN 'temp'
    WHEN event_type = 'purchase' AND value > 25 AND value <= 100 THEN 'flow' END AS label,
  {r6(_CONVERTED)} AS converted,
  CASE WHEN event_type IN ('click', 'view') THEN 'bpm' WHEN event_type = 'purchase' THEN 'ml' END
    AS unit
FROM events WHERE event_type IN ('click', 'view', 'error', 'purchase')""",
    "repair_nested": f"""WITH pieces(kind, low, high, closed, factor) AS (
  VALUES ('click', 0, 1, '(]', 100::DOUBLE), ('click', 21, 100, '[]', 1), ('view', 0.2, 1, '()', 100))
SELECT event_id, event_type,
  {r6("coalesce(value * factor, CASE WHEN event_type <> 'click' THEN value END)")} AS converted
FROM events LEFT JOIN pieces ON event_type = kind
  AND (value > low OR value = low AND closed LIKE '[%')
  AND (value < high OR value = high AND closed LIKE '%]')""",
    "null_safe_exclude": """
SELECT event_id, event_type, value, error FROM (
  SELECT *, CASE WHEN value > 200 THEN 1 WHEN value >= 5 THEN 0 END AS error FROM events)
WHERE error IS DISTINCT FROM 1 AND props <> '' AND value IS NOT NULL AND value <> 0
  AND event_type IN ('click', 'view', 'purchase')""",
    "status_flags": f"WITH {FLAGS} SELECT * FROM flags",
    "flag_union": """
SELECT user_id, ts,
  max(CASE WHEN event_type = 'click' OR (event_type = 'view' AND props <> '{"k": 9}')
    THEN 1 ELSE 0 END) AS on_flag,
  max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS alt_flag,
  max(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) AS end_flag,
  max(CASE WHEN event_type = 'error' AND props IN ('{"k": 1}', '{"k": 2}', '{"k": 3}')
    THEN 1 ELSE 0 END) AS special_flag
FROM events WHERE props <> '' GROUP BY user_id, ts
UNION
SELECT o_custkey, o_orderdate, 0, 0, 1, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END
FROM orders WHERE o_orderstatus IN ('F', 'P')""",
    "episodes": f"""WITH {EPISODES}
SELECT user_id, ventnum, starttime, endtime, {r6('duration_hours')} AS duration_hours FROM eps""",
    "episode_marks": f"WITH {FLAGS}, {MARKS} SELECT user_id, ts, opens, episode_no FROM marks",
    "first_value_pivot": f"""WITH {BODY}
SELECT user_id, round(height, 2) AS height, round(weight, 2) AS weight, {r6('bmi')} AS bmi
FROM body""",
    "nearest_end": f"""WITH {PAIRS}
SELECT user_id, starttime, endtime, event_ts, {r6('duration_hours')} AS duration_hours, se_diff
FROM pairs""",
    **{name: f"""
SELECT p.event_id, p.user_id, p.ts, n.ts AS found_ts, n.event_id AS near_id, n.value AS near_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT l.event_id AS own, r.*, row_number() OVER (PARTITION BY l.event_id
    ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), r.ts, r.event_id) AS rn
  FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'purchase'
    AND r.event_type IN ('click', 'view') AND abs(epoch_us(r.ts) - epoch_us(l.ts)) <= 21600000000 {also}) n
ON n.own = p.event_id AND n.rn = 1""" for name, also in (
        ("asof_nearest", ""), ("asof_backward", "AND r.ts <= l.ts"))},
    "best_per_key": """
SELECT o_custkey, l_quantity, l_shipdate, o_orderdate FROM (
  SELECT o_custkey, l_quantity, l_shipdate, o_orderdate, row_number() OVER (
    PARTITION BY o_custkey ORDER BY l_quantity DESC,
      CASE WHEN l_shipdate >= o_orderdate THEN l_shipdate - o_orderdate END NULLS LAST,
      l_shipdate, o_orderdate) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""",
    "repeated_keys": """
SELECT l_orderkey, l_shipdate, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_shipdate HAVING count(*) > 1""",
    "cohort": f"""WITH {COHORT}
SELECT user_id, starttime, endtime, event_ts, {r6('duration_hours')} AS duration_hours, weight,
  height, {r6('bmi')} AS bmi, c_name, c_nationkey
FROM cohort WHERE duration_hours >= {cfg.MIN_HOURS}""",
    "summary": f"""WITH {COHORT}
SELECT user_id, c_name, weight, height, round(bmi, 2) AS bmi, starttime, endtime,
  round(round(duration_hours, 9), 2) AS duration_hours
FROM cohort""",
    "ids": "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer ORDER BY 1",
    "interval_extract": f"""WITH {EPISODES},
longest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY duration_hours DESC, starttime) AS rn
  FROM eps)
SELECT e.event_id, e.user_id, e.event_type, e.ts, e.value
FROM events e JOIN longest l ON e.user_id = l.user_id AND l.rn = 1
  AND e.ts BETWEEN l.starttime AND l.endtime""",
    "interval_union": f"""
SELECT o.o_orderkey AS stay, l.l_shipdate AS at, 'quantity' AS channel, l.l_quantity AS value
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL {cfg.WINDOW_DAYS} DAY
UNION ALL
SELECT o.o_orderkey, p.o_orderdate, 'price', p.o_totalprice
FROM orders o JOIN orders p ON p.o_custkey = o.o_custkey
  AND p.o_orderdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL {cfg.WINDOW_DAYS} DAY""",
    "collapse_dupes": f"""
SELECT l_orderkey, l_shipdate, {r6('avg(l_quantity)')} AS l_quantity,
  max(l_returnflag) AS l_returnflag, max(l_linenumber) AS l_linenumber
FROM lineitem GROUP BY l_orderkey, l_shipdate""",
    "densify": f"WITH {IMPUTED} SELECT user_id, event_type, ts, value FROM mesh",
    "interpolate": f"""WITH {IMPUTED}
SELECT user_id, event_type, ts, {r6('value')} AS value FROM imputed""",
    "fill": f"WITH {IMPUTED} SELECT user_id, event_type, ts, filled AS value FROM imputed",
    "channel_sum": f"""WITH {IMPUTED}
SELECT user_id, event_type, ts, {r6('value')} AS value FROM imputed
UNION ALL SELECT a.user_id, 'total' AS event_type, a.ts, {r6('a.value + b.value + c.value')} AS value
FROM imputed a JOIN imputed b ON a.user_id = b.user_id AND a.ts = b.ts
JOIN imputed c ON a.user_id = c.user_id AND a.ts = c.ts
WHERE a.event_type = 'click' AND b.event_type = 'error' AND c.event_type = 'view'""",
    "channel_ratio": f"""WITH {IMPUTED},
both_ AS (
  SELECT a.user_id, a.ts, a.value AS b, o.value / 1000.0 AS v
  FROM imputed a LEFT JOIN imputed o ON a.user_id = o.user_id AND a.ts = o.ts
    AND o.event_type = 'view'
  WHERE a.event_type = 'click'
    AND a.user_id IN (SELECT user_id FROM events WHERE event_type = 'view'))
SELECT user_id, event_type, ts, {r6('value')} AS value FROM imputed
UNION ALL SELECT user_id, 'ratio' AS event_type, ts, {r6('b / nullif(v, 0)')} AS value FROM both_
UNION ALL SELECT user_id, 'product', ts, {r6('b * v')} FROM both_""",
    "channel_series": """
SELECT user_id, ts, avg(value) AS value FROM events WHERE event_type = 'click'
GROUP BY user_id, ts""",
    "series_order": """
SELECT user_id, ts, avg(value) AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS position
FROM events WHERE event_type = 'click' AND user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts""",
    "table_schema": "SELECT user_id, event_type, ts, value FROM events LIMIT 0",
    "read_inputs": """
SELECT user_id AS subject_id, ts AS charttime, length(event_type) AS itemid, value AS valuenum, 'chart' AS source FROM events
UNION ALL
SELECT user_id, ts, length(event_type), value, 'lab' FROM events WHERE value > 10""",
    "stored_features": f"""WITH {MEANS}
SELECT {KEYS}, {', '.join(f'{r6(n)} AS {n}' for n in MEAN_NAMES)} FROM features""",
    "stored_means": f"""WITH {MEANS}
SELECT {KEYS}, {', '.join(
        f'{r6(f"coalesce({n}, (SELECT avg({n}) FROM features))")} AS {n}' for n in MEAN_NAMES)}
FROM features WHERE label <= {NEAR // 2}""",
    "renamed_channels": """
SELECT user_id, max(value) FILTER (event_type = 'error') AS error, max(value) FILTER (event_type = 'purchase') AS purchase,
  coalesce(max(value) FILTER (event_type = 'click'), max(value) FILTER (event_type = 'view')) AS pulse,
  max(value) FILTER (event_type = 'signup') AS "left"
FROM events GROUP BY user_id""",
    "markers": "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id",
    "channels": """
SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS channels
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""",
    "segments": f"WITH {RAW_LONG}, {SEGS} SELECT * FROM segs",
    "zoh": f"""WITH {RAW_LONG}, {SEGS}
SELECT user_id, label, seg_start_time + INTERVAL 1 SECOND AS time FROM segs
UNION ALL SELECT user_id, label, seg_end_time FROM segs""",
    "nearest_snap": f"WITH {RAW_LONG}, {SNAPS} SELECT * FROM snapped",
    "segment_features": f"""WITH {RAW_LONG}, {STATS}
SELECT {KEYS},
    {_wide(cfg.CHANNELS, cfg.STATS)}
FROM stats GROUP BY {KEYS}""",
    "segment_repeats": f"""WITH {LINES_LONG}, {_stats(_segs(cfg.LINE_SEG_HOURS))}
SELECT user_id AS l_orderkey, label, seg_start_time, seg_end_time,
    {_wide(cfg.RETURN_FLAGS, ("mean", "median", "mode"))}
FROM stats GROUP BY {KEYS}""",
    "filled_features": f"""WITH {DERIVED}, {FILLED_STATS}
SELECT {KEYS},
    {_wide(cfg.FEATURE_CHANNELS, cfg.STATS)}
FROM stats GROUP BY {KEYS}""",
    "spread_stats": f"""
SELECT m.event_type, {r6('m.v')} AS median, {r6('o.v')} AS mode
FROM (SELECT event_type, median(value) AS v FROM events GROUP BY event_type) m
JOIN (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY c DESC, v) AS rn
  FROM (SELECT event_type, value AS v, count(*) AS c FROM events GROUP BY ALL)) o
ON m.event_type = o.event_type AND o.rn = 1""",
    "label_means": f"""WITH {MEANS}
SELECT label, {', '.join(f'{r6(f"avg({n})")} AS {n}' for n in MEAN_NAMES)}
FROM features GROUP BY label""",
    "label_counts": f"""WITH {MEANS}
SELECT label, count(*) AS rows, {', '.join(f'count({n}) AS {n}' for n in MEAN_NAMES)}
FROM features GROUP BY label""",
    "population_mean": f"""WITH {MEANS}
SELECT feature, {r6('avg(value)')} AS mean
FROM ({_long_features(MEAN_NAMES)}) GROUP BY feature""",
    "sparse_select": f"""WITH {MEANS},
near_long AS ({_long_features(MEAN_NAMES, extra=f' WHERE label <= {NEAR}')}),
{_kept(MEAN_NAMES)}
SELECT feature, kept FROM kept""",
    "mean_fill": f"""WITH {MEANS}
SELECT {KEYS}, {', '.join(
        f'{r6(f"coalesce({n}, (SELECT avg({n}) FROM features))")} AS {n}' for n in MEAN_NAMES)}
FROM features WHERE label <= {NEAR}""",
    "label_fill": f"""WITH {MEANS}
SELECT {KEYS}, {', '.join(
        f'{r6(f"coalesce({n}, avg({n}) OVER (PARTITION BY label))")} AS {n}' for n in MEAN_NAMES)}
FROM features""",
    "training_table": f"""WITH {_TRAIN}
SELECT {KEYS}, feature, {r6('coalesce(value, mean)')} AS value
FROM near_long JOIN kept USING (feature) JOIN means USING (feature) WHERE kept = 1""",
    "scoring_table": f"""WITH {_TRAIN}
SELECT {KEYS}, feature, {r6('coalesce(value, mean)')} AS value
FROM near_long JOIN kept USING (feature) JOIN means USING (feature)
WHERE kept = 1 AND label <= {NEAR // 2}""",
    "stratified_split": f"""
SELECT doc_id, quality, toxic, CASE WHEN rn <= floor(n * 0.2::DOUBLE + 0.5) THEN 1 ELSE 0 END
    AS is_test
FROM (SELECT *, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (
    PARTITION BY quality ORDER BY (doc_id * {cfg.SPLIT_MULTIPLIER}) % {cfg.SPLIT_PRIME}) AS rn
  FROM labels)""",
    **{name: f"""SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS candidate, *, 3::BIGINT AS folds,
  TRUE AS in_range, TRUE AS has_spread, 1::BIGINT AS n_best, TRUE AS best_is_top
FROM ({grid})""" for name, grid in _GRIDS.items()},
    "score": f"""WITH {_TEST}
SELECT user_id, seg_start_time, seg_end_time, label AS y_true, TRUE AS known_label,
  TRUE AS own_risk FROM test""",
    "score_report": f"""WITH {_TEST}
SELECT label AS class, count(*) AS support, CAST((SELECT count(*) FROM test) AS BIGINT) AS predicted,
  TRUE AS precision_fits, TRUE AS recall_fits, TRUE AS support_fits FROM test GROUP BY label""",
    "top_features": f"""WITH {_TRAIN}
SELECT CAST(unnest(generate_series(1, (SELECT CAST(least(20, sum(kept)) AS BIGINT) FROM kept))) AS INTEGER) AS rank,
  TRUE AS known, TRUE AS in_range""",
    "eval_report": f"""WITH {_REPORT}
SELECT class, support, {r6('precision')} AS precision, {r6('recall')} AS recall,
  {r6('coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)')} AS f1
FROM report""",
    "eval_summary": f"""WITH {_REPORT}
SELECT CAST(sum(support) AS BIGINT) AS rows, {r6('sum(recall * support) / sum(support)')}
    AS accuracy, {r6('avg(precision)')} AS macro_precision, {r6('avg(recall)')} AS macro_recall,
  {r6('sum(precision * support) / sum(support)')} AS weighted_precision
FROM report""",
    "risk": f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS y_pred,
  {r6('''CASE WHEN top <> low THEN (-ln(l_linenumber) + ln(top)) / (-ln(low) + ln(top)) END''')}
    AS ser_risk
FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS top,
    min(l_linenumber) OVER (PARTITION BY l_orderkey) AS low FROM lineitem)""",
    "signal_rows": f"""WITH {_SIGNAL}
SELECT record, channel, time, {r6('value')} AS value FROM samples""",
    "signal_wide": f"""WITH {_SIGNAL}
SELECT record, time, {r6("max(CASE WHEN channel = 'HR' THEN value END)")} AS HR,
  {r6('''coalesce(max(CASE WHEN channel = 'ABPSys' THEN value END),
    max(CASE WHEN channel = 'NBP SYS' THEN value END))''')} AS SBP,
  {r6("max(CASE WHEN channel = 'RESP' THEN value END)")} AS RR,
  {r6("max(CASE WHEN channel = '%SpO2' THEN value END)")} AS SpO2
FROM samples GROUP BY record, time""",
    "record_lookup": f"""
SELECT page_id, host, 'p' || CASE WHEN length(number) < 6 THEN lpad(number, 6, '0')
  ELSE number END AS record
FROM (SELECT page_id, regexp_extract(url, '{cfg.URL_PATTERN}', 1) AS host,
  CAST(TRY_CAST(nullif(regexp_extract(url, '{cfg.URL_PATTERN}', 2), '') AS BIGINT) AS VARCHAR)
    AS number FROM pages) WHERE number IS NOT NULL""",
    "param_sql": """
SELECT user_id, count(*) AS n, min(ts) AS first_ts FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
GROUP BY user_id""",
    "ensure_table": f"WITH {FLAGS} SELECT * FROM flags",
    "cached": "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id",
    "one_user": f"SELECT user_id, event_type, ts, value FROM events WHERE user_id = {cfg.ONE_USER}",
    "clustered_store": """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position
FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL""",
    "bucket_store": "SELECT user_id, event_type, ts, value FROM events",
    "item_dimension": """
SELECT p_partkey AS itemid, p_name || ', ' || p_type AS label, p_brand AS LEVEL1,
  p_type AS LEVEL2, p_retailprice AS mean, CAST(p_size AS DOUBLE) AS stdev,
  CAST(NULL AS DOUBLE) AS missing_percent FROM part""",
    "hours_between": """
SELECT event_id, date_sub('hour', min(ts) OVER (PARTITION BY user_id), ts) AS hours
FROM events""",
}
