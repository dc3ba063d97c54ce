"""DuckDB SQL for the catalogue's queries, over the same tables."""

from __future__ import annotations

TAGS = ["click", "error", "purchase", "signup", "view"]
INPUTS = ["click", "error", "signup", "view"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero made zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def cols(names, form: str, sep: str = ", ") -> str:
    return sep.join(form.format(c=c, i=i) for i, c in enumerate(names))


EVENTS = """ev AS (SELECT ts, event_id, user_id, event_type, value,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
  row_number() OVER (ORDER BY ts, event_id) - 1 AS ord FROM events)"""
HOURS = "hw AS (SELECT date_trunc('hour', ts) AS ts, " + cols(
    TAGS, "avg(value) FILTER (event_type = '{c}') AS {c}") + " FROM events GROUP BY 1)"
HOURLY = HOURS + ", h AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS ord, count(*) OVER () AS n FROM hw)"
DAYS = """days AS (SELECT o_orderdate AS ts, avg(o_totalprice) AS price, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1)"""
RESIDUALS = EVENTS + ", res AS (SELECT ts, ord, value - (30.0 + 0.1 * user_id + 0.2 * k) AS residual, count(*) OVER () AS n FROM ev)"
HOURLY_LONG = "lt AS (SELECT ts, ord, n, tag, value FROM (" + " UNION ALL ".join(
    f"SELECT ts, ord, n, '{c}' AS tag, {c} AS value FROM h" for c in TAGS) + "))"
BOARD = """rows_ AS (SELECT (CASE WHEN l_linestatus = 'F' THEN 'Ensemble_' ELSE '' END) || l_returnflag || l_linestatus AS model,
  l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem),
board AS (SELECT model, CASE WHEN model LIKE 'Ensemble_%' THEN 'blend' ELSE 'linear' END AS family, 'ok' AS status,
  1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(sum((y - p) ** 2) / count(*)) AS rmse,
  avg(abs(y - p)) AS mae, avg(abs(y - p) / abs(y)) FILTER (abs(y) > 1e-9) AS mape FROM rows_ GROUP BY 1)"""
VOTES = """v AS (SELECT lang, quality AS y, n_chars / (n_chars + 1000.0) AS p,
  CASE WHEN n_chars / (n_chars + 1000.0) > 0.5 THEN 1 ELSE 0 END AS hat FROM documents JOIN labels USING (doc_id))"""
CELLS = EVENTS + """, mean_ AS (SELECT avg(user_id) AS mu, avg(k) AS mk FROM ev),
cells AS (SELECT ord, ts, 'user_id' AS feature, user_id::DOUBLE AS feature_value, 0.1 * (user_id - mu) AS shap_value FROM ev, mean_
  UNION ALL SELECT ord, ts, 'k', k, 0.2 * (k - mk) FROM ev, mean_)"""
MOVED = EVENTS + """, mv AS (SELECT ts, ord, 30.0 + 0.1 * user_id + 0.2 * k AS baseline,
  30.0 + 0.1 * (user_id * (1 + 10.0 / 100)) + 0.2 * (k + (user_id * (1 + 10.0 / 100) - user_id) * 0.5 + 5.0) AS scenario FROM ev)"""


def _bins(col: str, cuts: str) -> str:
    return f"list_sum(list_transform({cuts}, lambda c: CASE WHEN {col} > c THEN 1 ELSE 0 END))"


def _mi(features: list[str], source: str = "lineitem") -> str:
    probs = "[" + ", ".join(str(i / 16) for i in range(1, 16)) + "]"
    cuts = ", ".join(f"list_distinct(quantile_cont({c}, {probs})) AS q_{c}" for c in [*features, "l_extendedprice"])
    binned = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {_bins(c, 'q_' + c)} AS bx, {_bins('l_extendedprice', 'q_l_extendedprice')} AS by_ "
        f"FROM {source}, cuts" for c in features)
    return f"""cuts AS (SELECT {cuts} FROM {source}), binned AS ({binned}),
cell AS (SELECT feature, bx, by_, count(*) AS n FROM binned GROUP BY ALL),
mi AS (SELECT feature, greatest(sum(n / total * ln(n * total / (nx * ny))), 0.0) AS mutual_info FROM (
  SELECT *, (sum(n) OVER (PARTITION BY feature, bx))::DOUBLE AS nx, (sum(n) OVER (PARTITION BY feature, by_))::DOUBLE AS ny,
    (sum(n) OVER (PARTITION BY feature))::DOUBLE AS total FROM cell) GROUP BY feature)"""


def _rolling(w: int, stat: str, fn: str) -> str:
    frame = f"OVER (ORDER BY ord ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    value = f"CASE WHEN count(value) {frame} >= {max(2, w // 2)} THEN {fn}(value) {frame} END"
    return f"{r(value)} AS value__roll{w}_{stat}"


def _range_case(parts: dict[str, tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN ord >= {lo} AND ord < {hi} THEN '{name}'" for name, (lo, hi) in parts.items()) + " END"


# round() in the split arithmetic is to the nearest even number on a tie.
UNSEEN, VALID = "greatest(round_even(n * 0.15, 0)::BIGINT, 1)", "greatest(round_even(n * 0.2, 0)::BIGINT, 1)"


def _parts(gap: int) -> dict[str, tuple[str, str]]:
    return {"train": ("0", f"n - {UNSEEN} - {gap} - {VALID} - {gap}"),
            "valid": (f"n - {UNSEEN} - {gap} - {VALID}", f"n - {UNSEEN} - {gap}"),
            "unseen": (f"n - {UNSEEN}", "n")}


def _describe(parts: dict[str, tuple[str, str]], source: str) -> str:
    return f"""SELECT part, count(*) AS rows, min(ts) AS start, max(ts) AS "end", round_even(count(*) / any_value(n), 4) AS share
FROM (SELECT {_range_case(parts)} AS part, ts, n FROM {source}) WHERE part IS NOT NULL GROUP BY part"""


def _audit(folds: str) -> str:
    """``folds`` gives fold, train_lo, train_hi, test_lo, test_hi."""
    return f"""WITH {EVENTS}, sized AS (SELECT count(*) AS n FROM ev), folds AS ({folds})
SELECT fold, min(ts) FILTER (ord >= train_lo AND ord < train_hi) AS train_start,
  max(ts) FILTER (ord >= train_lo AND ord < train_hi) AS train_end,
  count(*) FILTER (ord >= train_lo AND ord < train_hi) AS n_train,
  min(ts) FILTER (ord >= test_lo AND ord < test_hi) AS test_start,
  max(ts) FILTER (ord >= test_lo AND ord < test_hi) AS test_end,
  count(*) FILTER (ord >= test_lo AND ord < test_hi) AS n_test
FROM ev, folds GROUP BY fold"""


def _prepared(fill: str, after: str = "{x}", extra: str = "") -> str:
    """Columns filled by ``fill`` ({c} the column), then ``after`` ({x} the filled value)."""
    train = "ord < floor(n * 0.6)::BIGINT"
    stats = ", ".join(f"median({c}) FILTER ({train}) AS med_{c}, avg({c}) FILTER ({train}) AS avg_{c}" for c in TAGS)
    filled = ", ".join(f"{fill.format(c=c)} AS {c}" for c in TAGS)
    fitted = ", ".join(e for c in TAGS for e in (
        f"avg({c}) FILTER ({train}) AS m_{c}", f"stddev_pop({c}) FILTER ({train}) AS s_{c}",
        f"quantile_cont({c}, [0.05, 0.25, 0.5, 0.75, 0.95]) FILTER ({train}) AS q_{c}"))
    out = ", ".join(f"{r(after.format(x='f.' + c, c=c))} AS {c}" for c in TAGS)
    return f"""WITH {HOURLY}, st AS (SELECT {stats} FROM h), f AS (SELECT ord, n, {filled} FROM h, st),
ft AS (SELECT {fitted} FROM f) SELECT ord, {out} FROM f, ft"""


def _auc(by: str = "") -> str:
    """Average-rank AUC; ``by`` is a partition column with its comma, or nothing."""
    part = f"PARTITION BY {by.rstrip(', ')}" if by else ""
    return f"""ranked AS (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {by}p) - 1) / 2.0 AS rk FROM v),
auc AS (SELECT {by}CASE WHEN sum(y) > 0 AND sum(1 - y) > 0 THEN (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) END AS auc
  FROM ranked {'GROUP BY ' + by.rstrip(', ') if by else ''})"""


def _labels(by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    f1 = f"""f1 AS (SELECT {by}avg(2.0 * both_ / (t + p_)) AS f1 FROM (SELECT {by}c, count(*) FILTER (y = c) AS t,
  count(*) FILTER (hat = c) AS p_, count(*) FILTER (y = c AND hat = c) AS both_ FROM v, (SELECT unnest([0, 1]) AS c) GROUP BY ALL)
  WHERE t + p_ > 0 {group})"""
    acc = f"acc AS (SELECT {by}count(*) AS n, avg((y = hat)::INT) AS acc FROM v {group})"
    joins = f"JOIN f1 USING ({by.rstrip(', ')}) JOIN auc USING ({by.rstrip(', ')})" if by else ", f1, auc"
    sep = " " if by else ""
    return f"""WITH {VOTES}, {_auc(by)}, {f1}, {acc}
SELECT {by}n, {r('acc')} AS "Accuracy", {r('f1')} AS "F1", {r('auc')} AS "ROC_AUC" FROM acc{sep}{joins}"""


def _ledger() -> str:
    """Every feature of the default settings with what it comes from and its known rows."""
    made: list[tuple[str, str, str, int, str]] = []
    for c in INPUTS:
        made.append((c, c, "raw", 0, c))
        made += [(f"{c}__lag{k}", c, f"lag({k})", k, f"lag({c}, {k}) OVER o") for k in (1, 2, 3, 6, 12)]
        made += [(f"{c}__roll{w}_{stat}", c, f"rolling({w},{stat})", w,
                  f"CASE WHEN count({c}) OVER (ORDER BY ord ROWS {w - 1} PRECEDING) >= {w // 2} THEN 1 END")
                 for w in (6, 12, 24) for stat in ("mean", "std")]
        made.append((f"{c}__diff1", c, "diff(1)", 1, f"{c} - lag({c}, 1) OVER o"))
        made.append((f"{c}__ewm12", c, "ewm(12)", 12, f"last_value({c} IGNORE NULLS) OVER o"))
    calendar = ("hour", "dayofweek", "month", "is_weekend", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
    made += [(f"tf__{c}", "__time__", c, 0, "ord") for c in calendar]
    wide = ", ".join(f"{e} AS v{i}" for i, (*_, e) in enumerate(made))
    counts = " UNION ALL ".join(f"""SELECT '{f}' AS feature, ['{c}'] AS origins, '{t}' AS transform, {k}::INT AS lookback, count(v{i}) AS known_rows FROM w"""
                                for i, (f, c, t, k, _) in enumerate(made))
    return f"WITH {HOURLY}, w AS MATERIALIZED (SELECT {wide} FROM h WINDOW o AS (ORDER BY ord)) {counts}"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources, layout, time axis
    q["csv_roundtrip"] = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders"
    q["sql_scan"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
    q["layout_stats"] = """SELECT count(ts) AS n_times, count(DISTINCT date_trunc('hour', ts)) AS distinct_times,
  count(DISTINCT event_type) AS distinct_event_type FROM events"""
    q["layout_decision"] = """SELECT CASE WHEN s >= 0.6 THEN 'long' ELSE 'wide' END AS layout, round(s, 2)::DOUBLE AS confidence, 'ts' AS time_col,
  'event_type' AS tag_col, 'value' AS value_col, tags AS n_tags FROM (
  SELECT (CASE WHEN 1 - count(DISTINCT date_trunc('hour', ts)) / count(*) > 0.3 THEN 0.5 ELSE 0 END) + 0.3 + 0.1 AS s,
    count(DISTINCT event_type) AS tags FROM events)"""
    q["long_to_wide"] = f"WITH {HOURS} SELECT ts, {cols(TAGS, '(round({c}, 6) + 0.0) AS {c}')} FROM hw"
    q["long_to_wide_last"] = "SELECT date_trunc('hour', ts) AS ts, " + cols(
        TAGS, "arg_max(value, event_id) FILTER (event_type = '{c}') AS {c}") + " FROM events GROUP BY 1"
    q["long_stats"] = """WITH c AS (SELECT date_trunc('hour', ts) AS t, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT count(DISTINCT event_type) AS tags, count(DISTINCT t) AS instants, 0 AS dropped_non_numeric,
  sum(n - 1)::BIGINT AS repeated FROM c"""
    q["wide_to_long"] = f"WITH {HOURLY}, {HOURLY_LONG} SELECT ts, tag, {r('value')} AS value FROM lt WHERE value IS NOT NULL"
    q["tag_inventory"] = f"""SELECT event_type AS tag, count(*) AS rows, 1.0::DOUBLE AS numeric_ratio, {r('avg(value)')} AS mean,
  min(value) AS min, max(value) AS max FROM events GROUP BY 1"""
    q["timeseries_dedupe"] = """SELECT o_orderdate AS ts, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice,
  arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, row_number() OVER (ORDER BY o_orderdate) - 1 AS ord
FROM orders GROUP BY o_orderdate"""
    q["timeseries_zone"] = """SELECT o_orderdate - INTERVAL 9 HOUR AS ts, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice,
  row_number() OVER (ORDER BY o_orderdate) - 1 AS ord FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_orderdate"""
    q["dataset_span"] = "SELECT count(*) AS rows, 6::INT AS columns, min(ts) AS start, max(ts) AS \"end\" FROM events"
    q["resample_mean_last"] = f"""WITH b AS (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts FROM events),
g AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1)
SELECT ts, {r('value')} AS value, event_type FROM b LEFT JOIN g USING (ts)"""
    q["resample_median"] = f"""WITH b AS (SELECT unnest(generate_series(time_bucket(INTERVAL 6 HOUR, min(ts)), max(ts), INTERVAL 6 HOUR)) AS ts FROM events),
g AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS ts, median(value) AS value FROM events GROUP BY 1)
SELECT ts, {r('value')} AS value FROM b LEFT JOIN g USING (ts)"""
    q["step_table"] = f"""WITH {DAYS}, d AS (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts))::DOUBLE AS step_seconds FROM days)
SELECT step_seconds, count(*) AS times FROM d WHERE step_seconds IS NOT NULL GROUP BY 1"""
    q["gap_report"] = f"""WITH {EVENTS}, d AS (SELECT lag(ts) OVER (ORDER BY ord) AS start, ts AS "end" FROM ev)
SELECT start, "end", {r('epoch_us("end" - start) / 1e6')} AS duration_seconds FROM d WHERE epoch_us("end" - start) / 1e6 > 1200"""
    q["period_filter"] = "SELECT ts, event_id, value FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-12'"
    q["last_days"] = """SELECT ts, event_id, value FROM events, (SELECT date_trunc('day', max(ts)) AS d FROM events)
WHERE ts >= d - INTERVAL 7 DAY AND ts < d + INTERVAL 1 DAY"""
    q["known_target"] = f"""WITH {HOURS} SELECT ts, {cols(TAGS, '(round({c}, 6) + 0.0) AS {c}')}, row_number() OVER (ORDER BY ts) - 1 AS ord
FROM hw WHERE purchase IS NOT NULL"""
    q["stride_sample"] = f"""WITH {EVENTS}, z AS (SELECT count(*) AS n FROM ev) SELECT ord, event_id, value FROM ev, z
WHERE ord % greatest(n // 500, 1) = 0 OR n <= 500"""

    # profile
    def profile_row(i: int, c: str, numeric: bool) -> str:
        x = f"{c}::DOUBLE"
        dtype = {"user_id": "bigint", "event_type": "string"}.get(c, "double")
        if not numeric:
            extra = ("NULL::DOUBLE AS outlier_ratio, NULL::DOUBLE AS flatline_ratio, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, "
                     "NULL::DOUBLE AS min, NULL::DOUBLE AS max")
        else:
            extra = f"""(SELECT CASE WHEN q3 > q1 THEN round_even(avg(({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))::INT), 4) ELSE 0.0 END
  FROM ev, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM ev) GROUP BY q1, q3) AS outlier_ratio,
  (SELECT round_even(count(*) FILTER ({c} = p) / count({c}), 4) FROM (SELECT {c}, lag({c}) OVER (ORDER BY ord) AS p FROM ev)) AS flatline_ratio,
  {r(f'avg({x})')} AS mean, {r(f'stddev_samp({x})')} AS std, min({x}) AS min, max({x}) AS max"""
        return f"""SELECT {i} AS position, '{c}' AS "column", '{'numeric' if numeric else 'categorical'}' AS kind, '{dtype}' AS dtype,
  0.0::DOUBLE AS missing_ratio, count(DISTINCT {c}) AS n_unique,
  (SELECT round_even(max(m) / sum(m), 4) FROM (SELECT count(*) AS m FROM ev GROUP BY {c})) AS dominant_ratio, {extra} FROM ev"""

    q["column_profile"] = f"WITH {EVENTS} " + " UNION ALL ".join(
        profile_row(i, c, c != "event_type") for i, c in enumerate(["user_id", "event_type", "value", "k"]))
    q["outlier_ratios"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT)')} AS outlier_ratio
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in LINE_NUMBERS)
    q["correlated_pairs"] = "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round_even(abs(corr({a}, {b})), 4) AS corr, '{a}' AS suggest_drop FROM lineitem"
        for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]) + ") WHERE corr >= 0.0"
    q["correlations"] = f"WITH {HOURS} " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})')} AS r FROM hw"
        for a in TAGS for b in TAGS)
    pair_rows = " UNION ALL ".join(
        f"""SELECT CASE WHEN avg(({a} IS NULL)::INT) >= avg(({b} IS NULL)::INT) THEN '{a}' ELSE '{b}' END AS d,
  CASE WHEN avg(({a} IS NULL)::INT) >= avg(({b} IS NULL)::INT) THEN '{b}' ELSE '{a}' END AS o, abs(corr({a}, {b})) AS c FROM hw"""
        for i, a in enumerate(TAGS) for b in TAGS[i + 1:])
    miss_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS d, 0 AS rank, 'missing' AS reason FROM hw HAVING round_even(avg(({c} IS NULL)::INT), 4) > 0.055" for c in TAGS)
    q["drop_suggestions"] = f"""WITH {HOURS}, pairs AS ({pair_rows}), found AS ({miss_rows}
  UNION ALL SELECT d, 1, printf('correlates %.2f with %s', round_even(c, 4), o) FROM pairs WHERE c >= 0.09)
SELECT d AS "column", string_agg(DISTINCT reason, ' / ' ORDER BY rank, reason) AS reason,
  CASE WHEN min(rank) = 0 THEN 'quality' ELSE 'duplicate' END AS source
FROM (SELECT DISTINCT * FROM found) WHERE d <> 'purchase' GROUP BY d""".replace(
        "string_agg(DISTINCT reason, ' / ' ORDER BY rank, reason)", "string_agg(reason, ' / ' ORDER BY rank, reason)")
    q["missing_grid"] = f"""WITH {HOURLY}, b AS (SELECT *, (ntile(200) OVER (ORDER BY ord) - 1)::INT AS bin FROM h)
SELECT bin, min(ts) AS start, {cols(TAGS, '(round(avg(({c} IS NULL)::INT), 6) + 0.0) AS {c}')} FROM b GROUP BY bin"""
    q["target_summary"] = f"""WITH {HOURS} SELECT {r('avg(purchase)')} AS mean, {r('stddev_samp(purchase)')} AS std,
  {r('avg((purchase IS NULL)::INT)')} AS missing_ratio, count(DISTINCT purchase) AS n_unique FROM hw"""

    # advice
    q["missing_runs"] = f"""WITH {HOURLY}, {HOURLY_LONG}, m AS (SELECT tag, ord, ord - row_number() OVER (PARTITION BY tag ORDER BY ord) AS g FROM lt WHERE value IS NULL),
runs AS (SELECT tag, g, count(*) AS len FROM m GROUP BY 1, 2), a AS (SELECT tag, avg((value IS NULL)::INT) AS miss FROM lt GROUP BY 1)
SELECT tag AS "column", {r('any_value(miss)')} AS missing_ratio, count(len) AS runs, coalesce(max(len), 0) AS longest,
  coalesce({r('avg(len)')}, 0.0) AS mean_run FROM a LEFT JOIN runs USING (tag) GROUP BY tag"""
    q["scale_profile"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'max({c}) - min({c})')} AS range,
  {r(f'max(abs({c} - md) / (1.4826 * d))')} AS max_robust_z, count(*) FILTER (abs({c} - md) / (1.4826 * d) > 5) AS n_over_5
FROM lineitem, (SELECT median({c}) AS md, mad({c}) AS d FROM lineitem)""" for c in LINE_NUMBERS)
    q["categorical_profile"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_unique, list(v ORDER BY v)[1:6] AS examples
FROM (SELECT DISTINCT {c} AS v FROM part)""" for c in ("p_brand", "p_type", "p_name"))
    lags24 = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24]
    lagged = " UNION ALL ".join(
        f"""SELECT '{c}' AS tag, {k} AS lag, count(*) FILTER (x.{c} IS NOT NULL AND y.purchase IS NOT NULL) AS n, corr(x.{c}, y.purchase) AS r
FROM h x JOIN h y ON y.ord = x.ord + {k}""" for c in INPUTS for k in lags24)
    q["lag_correlations"] = f"WITH {HOURLY}, l AS ({lagged}) SELECT tag, lag, n, {r('r')} AS r FROM l"
    q["lag_scan"] = f"""WITH {HOURLY}, l AS ({lagged}), b AS (SELECT tag, max(abs(r)) AS best, max(abs(r)) FILTER (lag = 0) AS r0,
  arg_max(lag, (abs(r), -lag)) AS best_lag FROM l GROUP BY tag)
SELECT tag, best_lag, round_even(best, 4) AS corr, round_even(r0, 4) AS corr_lag0,
  round_even(greatest(0.0, ((1 - r0 * r0) - (1 - best * best)) / (1 - r0 * r0)), 4) AS error_reduction FROM b"""
    q["autocorrelation_profile"] = f"""WITH {HOURS}, d AS (SELECT purchase AS v, row_number() OVER (ORDER BY ts) - 1 AS ord FROM hw WHERE purchase IS NOT NULL)
SELECT b.lag, round_even(corr(x.v, y.v), 4) AS autocorrelation FROM (SELECT unnest([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48]) AS lag) b, d x, d y
WHERE x.ord + b.lag = y.ord GROUP BY b.lag"""

    # advice
    q["preprocessing_advice"] = f"""WITH {HOURLY}, {HOURLY_LONG},
m AS (SELECT tag, ord, ord - row_number() OVER (PARTITION BY tag ORDER BY ord) AS g FROM lt WHERE value IS NULL),
runs AS (SELECT tag, avg(len) AS run FROM (SELECT tag, g, count(*) AS len FROM m GROUP BY 1, 2) GROUP BY 1),
gaps AS (SELECT count(*) FILTER (miss > 0) AS gappy, count(*) FILTER (miss > 0 AND run >= 6) AS outages,
  median(run) FILTER (miss > 0) AS typical, count(*) FILTER (miss > 0.4) AS sparse
  FROM (SELECT tag, avg((value IS NULL)::INT) AS miss FROM lt GROUP BY 1) LEFT JOIN runs USING (tag)),
spread AS (SELECT tag, avg(value) AS mu, stddev_samp(value) AS sd, max(abs(value - md) / (1.4826 * d)) AS z,
  count(*) FILTER (abs(value - md) / (1.4826 * d) > 5) AS n5
  FROM lt JOIN (SELECT tag, median(value) AS md, mad(value) AS d FROM lt GROUP BY 1) USING (tag) GROUP BY tag),
scale AS (SELECT count(*) AS cols, count(*) FILTER (z > 10) AS wild, max(sd) FILTER (sd / abs(mu) > 1e-4) / min(sd) FILTER (sd / abs(mu) > 1e-4) AS apart,
  count(*) FILTER (n5 > 0) AS hit, sum(n5) AS points FROM spread),
levels AS (SELECT c, count(*) AS n, bool_and(regexp_matches(v, '^\\.*[0-9][0-9.]*$')) OR (count(*) <= 8 AND bool_and(regexp_matches(v, '^\\p{{L}}$')))
  OR bool_and(v IN ('LOW', 'MID', 'MIDDLE', 'HIGH')) AS ordered FROM (SELECT DISTINCT 'o_orderstatus' AS c, upper(trim(o_orderstatus)) AS v FROM orders
  UNION SELECT 'o_orderpriority', upper(trim(o_orderpriority)) FROM orders) GROUP BY c),
kinds AS (SELECT min(c) FILTER (n <= 20 AND NOT ordered) AS states, count(*) FILTER (n <= 20 AND ordered) AS ordered FROM levels)
SELECT 'impute' AS item, CASE WHEN typical >= 6 AND 2 * outages >= gappy THEN 'median' ELSE 'ffill' END AS value,
  CASE WHEN gappy > 0 AND NOT (typical >= 6 AND 2 * outages >= gappy) AND sparse > 0 THEN 'normal' ELSE 'high' END AS confidence,
  CASE WHEN gappy = 0 THEN 'no column has a gap' WHEN typical >= 6 AND 2 * outages >= gappy
    THEN format('a typical gap lasts {{:.0f}} rows, too long to carry a value over', typical)
    ELSE format('a typical gap lasts {{:.1f}} rows', typical) END AS reason FROM gaps
UNION ALL SELECT 'scaler', CASE WHEN wild >= greatest(1, cols // 5) THEN 'robust' ELSE 'standard' END,
  CASE WHEN wild >= greatest(1, cols // 5) OR apart >= 50 THEN 'high' ELSE 'normal' END,
  CASE WHEN wild >= greatest(1, cols // 5) THEN format('columns that reach beyond robust z 10: {{}}', wild)
    ELSE format('the widest column varies {{:.1f}} times as much as the narrowest', apart) END FROM scale
UNION ALL SELECT 'encoding', CASE WHEN states IS NULL AND ordered > 0 THEN 'ordinal' ELSE 'onehot' END,
  CASE WHEN states IS NOT NULL THEN 'high' WHEN ordered > 0 THEN 'normal' ELSE 'low' END,
  CASE WHEN states IS NOT NULL THEN states || ' has values without an order' WHEN ordered > 0 THEN 'ordered columns: ' || ordered
    ELSE 'no column has few values' END FROM kinds
UNION ALL SELECT 'clip', CASE WHEN hit > 0 THEN 'True' ELSE 'False' END, 'high',
  CASE WHEN hit > 0 THEN format('{{}} extreme values in {{}} columns', points::BIGINT, hit) ELSE 'no value lies beyond robust z 5' END FROM scale"""
    usual = "'[1, 2, 3, 6, 12]'"
    q["window_advice"] = f"""WITH scan AS ({q["lag_scan"]}), tagged AS (SELECT *, corr >= 0.2 AS related, corr >= 0.2 AND best_lag > 0 AND error_reduction >= 0.1 AS late FROM scan),
f AS (SELECT count(*) FILTER (related) AS related, list_sort(list(DISTINCT best_lag) FILTER (late)) AS delays,
  arg_max(tagged, corr) FILTER (late) AS lead FROM tagged),
acf AS ({q["autocorrelation_profile"]}), stretch AS (SELECT min(lag) FILTER (autocorrelation < 0.5) AS fades, max(lag) AS last FROM acf),
memory AS (SELECT fades, greatest(2, least(coalesce(fades, last), 48)) AS m FROM stretch)
SELECT 'lags' AS item, CASE WHEN delays IS NULL THEN {usual} ELSE CAST(list_sort(list_distinct(list_prepend(1::BIGINT, delays[1:5])))[1:6] AS VARCHAR) END AS value,
  CASE WHEN delays IS NOT NULL THEN CASE WHEN lead.error_reduction >= 0.3 THEN 'high' ELSE 'normal' END WHEN related > 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN delays IS NOT NULL THEN format('{{}} correlates {{:.3f}} at {{}} rows, {{:.3f}} at none', lead.tag, lead.corr, lead.best_lag, lead.corr_lag0)
    WHEN related > 0 THEN 'the related tags act at once' ELSE 'every correlation is under 0.2' END AS reason FROM f
UNION ALL SELECT 'windows', CAST(list_sort(list_distinct(list_filter([greatest(2, m // 4), greatest(3, m // 2), m], lambda w: w <= 48))) AS VARCHAR),
  CASE WHEN fades IS NULL THEN 'low' ELSE 'normal' END, 'values ' || m || ' rows apart still resemble each other by half' FROM memory"""

    q["random_sample"] = f"""WITH {EVENTS} SELECT ts, event_id, user_id, event_type, {r('value')} AS value, {r('k')} AS k, ord
FROM ev ORDER BY md5('42:' || ord), ord LIMIT 200"""
    q["feature_ledger"] = _ledger()
    q["saved_run"] = f"""WITH {HOURS}, h AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS ord, count(*) OVER () AS n FROM hw WHERE purchase IS NOT NULL)
SELECT ord, 0.0::DOUBLE AS apart FROM h WHERE ord >= {_parts(2)["valid"][0]} AND ord < {_parts(2)["valid"][1]}"""

    # features
    def lag(k: int) -> str:
        return f"lag(value, {k}) OVER (ORDER BY ord)"

    q["feature_lags"] = f"WITH {EVENTS} SELECT ts, ord, value, " + ", ".join(
        [f"{lag(k)} AS value__lag{k}" for k in (1, 2, 3, 6, 12)] +
        [f"{r('value - ' + lag(k))} AS value__diff{k}" for k in (1, 3)] +
        [f"{r('value / nullif(' + lag(1) + ', 0) - 1')} AS value__pct1"]) + " FROM ev"
    fns = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    q["feature_rolling"] = f"WITH {EVENTS} SELECT ts, ord, value, " + ", ".join(
        _rolling(w, s, f) for w in (6, 24) for s, f in fns.items()) + " FROM ev"
    q["feature_rolling_median"] = f"WITH {EVENTS} SELECT ts, ord, value, {_rolling(7, 'median', 'median')} FROM ev"
    # The weight of a value 300 rows back is below 1e-21.
    q["feature_ewm"] = f"""WITH {EVENTS}, y AS (SELECT a.ord, sum((CASE WHEN b.ord = 0 THEN 1.0 ELSE 2.0 / 13 END) * pow(11.0 / 13, a.ord - b.ord) * b.value) AS y
  FROM ev a JOIN ev b ON b.ord BETWEEN a.ord - 300 AND a.ord GROUP BY a.ord)
SELECT ts, ord, value, {r('y')} AS value__ewm12 FROM ev JOIN y USING (ord)"""

    def ewm_steps(c: str) -> str:
        return f"""e_{c} AS (SELECT ord, {c} AS y, CASE WHEN {c} IS NULL THEN NULL ELSE ord END AS seen FROM h WHERE ord = 0
  UNION ALL SELECT h.ord, CASE WHEN h.{c} IS NULL THEN p.y WHEN p.y IS NULL THEN h.{c}
    ELSE (pow(5.0 / 7, h.ord - p.seen) * p.y + (2.0 / 7) * h.{c}) / (pow(5.0 / 7, h.ord - p.seen) + 2.0 / 7) END,
    CASE WHEN h.{c} IS NULL THEN p.seen ELSE h.ord END FROM e_{c} p JOIN h ON h.ord = p.ord + 1)"""

    q["feature_ewm_gaps"] = f"""WITH RECURSIVE {HOURLY}, {ewm_steps('click')}, {ewm_steps('view')}
SELECT h.ts, h.ord, {r('h.click')} AS click, {r('h.view')} AS "view", {r('a.y')} AS click__ewm6, {r('b.y')} AS view__ewm6
FROM h JOIN e_click a ON a.ord = h.ord JOIN e_view b ON b.ord = h.ord"""

    def windowed(c: str) -> str:
        f = "OVER (ORDER BY ord ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
        return (f"{r(f'lag({c}) OVER (ORDER BY ord)')} AS {c}__lag1, "
                + ", ".join(f"{r(f'CASE WHEN count({c}) {f} >= 3 THEN {fn}({c}) {f} END')} AS {c}__roll6_{s}"
                            for s, fn in (("mean", "avg"), ("std", "stddev_samp"))))

    q["feature_interactions"] = f"""WITH {HOURLY} SELECT ts, ord, {cols(['click', 'view', 'purchase'], '(round({c}, 6) + 0.0) AS {c}')},
  {windowed('click')}, {windowed('view')}, {r('click / nullif("view", 0)')} AS click__over__view, {r('click - "view"')} AS click__minus__view,
  {r('"view" / nullif(error, 0)')} AS view__over__error, {r('"view" - error')} AS view__minus__error FROM h"""
    dow = "(isodow(ts) - 1)"
    q["feature_calendar"] = f"""WITH {EVENTS} SELECT ts, ord, value, hour(ts)::DOUBLE AS tf__hour, {dow}::DOUBLE AS tf__dayofweek,
  month(ts)::DOUBLE AS tf__month, ({dow} >= 5)::INT::DOUBLE AS tf__is_weekend, """ + ", ".join(
        f"{r(f'{f}(2 * pi() * {v} / {p})')} AS tf__{n}_{f}" for n, v, p in
        (("hour", "hour(ts)", 24), ("dow", dow, 7), ("month", "month(ts)", 12)) for f in ("sin", "cos")) + " FROM ev"
    q["warmup_trim"] = f"WITH {EVENTS} SELECT ord - 24 AS ord, event_id FROM ev WHERE ord >= 24"
    q["minute_specs"] = f"""WITH {HOURLY}, d AS (SELECT epoch(ts - lag(ts) OVER (ORDER BY ts)) / 60 AS m FROM h), s AS (SELECT mode(m) AS step FROM d)
SELECT kind, minutes, CASE WHEN k >= 1 THEN k END AS rows, CASE WHEN k >= 1 THEN k * step END AS actual_minutes FROM (
  SELECT *, round_even(minutes / step, 0)::INT AS k FROM s, (VALUES ('lag', 60.0::DOUBLE), ('lag', 180.0), ('lag', 20.0), ('rolling', 360.0)) t(kind, minutes))"""

    # splits
    sized = EVENTS + ", z AS (SELECT *, count(*) OVER () AS n FROM ev)"
    q["split_three_way"] = f"WITH {sized} " + _describe(_parts(24), "z")
    q["split_by_date"] = f"""WITH {sized}, c AS (SELECT count(*) FILTER (ts < '2024-01-20') AS v, count(*) FILTER (ts < '2024-01-26') AS u FROM ev),
zz AS (SELECT * FROM z, c) """ + _describe({"train": ("0", "v - 24"), "valid": ("v", "u - 24"), "unseen": ("u", "n")}, "zz")
    q["time_holdout"] = f"WITH {sized} " + _describe(
        {"train": ("0", "n - round_even(n * 0.2, 0)::BIGINT - 24"), "valid": ("n - round_even(n * 0.2, 0)::BIGINT", "n")}, "z")
    q["date_holdout"] = f"""WITH {sized}, c AS (SELECT count(*) FILTER (ts < '2024-01-20') AS v FROM ev),
zz AS (SELECT * FROM z, c) """ + _describe({"train": ("0", "v - 24"), "valid": ("v", "n")}, "zz")
    q["split_random"] = """WITH c AS (SELECT count(*) AS n, round_even(count(*) * 0.2, 0)::BIGINT AS t FROM events)
SELECT true AS is_test, t AS rows FROM c UNION ALL SELECT false, n - t FROM c"""
    q["fold_audit"] = _audit("""SELECT i AS fold, 0 AS train_lo, n - (6 - i) * (n // 6) - 24 AS train_hi, n - (6 - i) * (n // 6) AS test_lo,
  n - (5 - i) * (n // 6) AS test_hi FROM sized, (SELECT unnest([1, 2, 3, 4, 5]) AS i)""")
    q["backtest_windows"] = _audit("""SELECT i AS fold, greatest(n - (5 - i) * (n // 5) - 12 - 3 * (n // 5), 0) AS train_lo, n - (5 - i) * (n // 5) - 12 AS train_hi,
  n - (5 - i) * (n // 5) AS test_lo, n - (4 - i) * (n // 5) AS test_hi FROM sized, (SELECT unnest([1, 2, 3, 4]) AS i)""")
    q["leakage_checks"] = f"""WITH {sized}, s AS (SELECT max(ts) FILTER (ord < {_parts(24)['train'][1]}) < min(ts) FILTER (ord >= {_parts(24)['valid'][0]}) AS ordered,
  count(*) = count(DISTINCT ts) AS single FROM z)
SELECT 'time order' AS "check", ordered AS passed FROM s UNION ALL SELECT 'sorted', true UNION ALL SELECT 'distinct instants', single FROM s
UNION ALL SELECT 'no target-derived feature', false UNION ALL SELECT 'gap covers lookback', false
UNION ALL SELECT 'selection saw no evaluation row', false UNION ALL SELECT 'unseen part apart and last', true"""

    # selection
    q["variance_and_missing"] = f"WITH {HOURS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'var_pop({c})')} AS variance, {r(f'avg(({c} IS NULL)::INT)')} AS missing_ratio FROM hw" for c in TAGS)
    q["mutual_information"] = f"WITH {_mi(['l_quantity', 'l_discount', 'l_tax'])} SELECT feature, {r('mutual_info')} AS mutual_info FROM mi"
    three = _mi(["l_quantity", "l_discount", "l_tax"])
    selection = f"""{three}, ranked AS (SELECT feature, mutual_info, row_number() OVER (ORDER BY mutual_info DESC) AS k FROM mi),
vars AS (SELECT var_pop(l_quantity) AS a, var_pop(l_quantity * 2) AS b, var_pop(l_discount) AS c, var_pop(l_tax) AS d FROM lineitem),
listed AS (SELECT * FROM (VALUES (0, 'l_quantity'), (1, 'twice'), (2, 'l_discount'), (3, 'l_tax'), (4, 'fixed')) t(position, feature)),
sel AS (SELECT position, feature, CASE feature WHEN 'l_quantity' THEN a WHEN 'twice' THEN b WHEN 'l_discount' THEN c WHEN 'l_tax' THEN d ELSE 0.0 END AS variance,
  0.0::DOUBLE AS missing_ratio, mutual_info, coalesce(k <= 2, false) AS kept, CASE WHEN k <= 2 THEN 'selected' ELSE 'removed' END AS status,
  CASE WHEN feature = 'fixed' THEN 'variance 0 <= 1e-12' WHEN feature = 'twice' THEN '|corr| >= 0.98 with l_quantity'
    WHEN k > 2 THEN 'mutual information rank ' || k || ', over 2' ELSE 'mutual information rank ' || k END AS reason
  FROM listed LEFT JOIN ranked USING (feature), vars)"""
    q["feature_selection"] = f"""WITH {selection} SELECT position, feature, {r('variance')} AS variance, missing_ratio,
  {r('mutual_info')} AS mutual_info, kept, status, reason FROM sel"""
    ledger = """led AS (SELECT * FROM (VALUES ('l_quantity', ['l_quantity'], 'raw'), ('l_discount', ['l_discount'], 'raw'), ('l_tax', ['l_tax'], 'raw'),
  ('twice', ['l_quantity'], 'double')) t(feature, origins, transform))"""
    means = """tr AS (SELECT 'l_quantity' AS feature, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem
  UNION ALL SELECT 'twice', avg(l_quantity * 2), stddev_samp(l_quantity * 2) FROM lineitem
  UNION ALL SELECT 'l_discount', avg(l_discount), stddev_samp(l_discount) FROM lineitem
  UNION ALL SELECT 'l_tax', avg(l_tax), stddev_samp(l_tax) FROM lineitem UNION ALL SELECT 'fixed', 7.0, 0.0)"""
    q["feature_review"] = f"""WITH {selection}, {ledger}, {means} SELECT feature, {r('variance')} AS variance, missing_ratio, {r('mutual_info')} AS mutual_info,
  kept, status, origins, coalesce(transform, 'raw') AS transform, 0 AS lookback,
  CASE WHEN mutual_info IS NOT NULL THEN rank() OVER (ORDER BY mutual_info DESC NULLS LAST) END AS mi_rank,
  {r('m')} AS train_mean, {r('s')} AS train_std, 0.0::DOUBLE AS train_missing FROM sel LEFT JOIN led USING (feature) JOIN tr USING (feature)"""
    q["origin_rollup"] = f"""WITH {selection} SELECT CASE WHEN feature = 'twice' THEN 'l_quantity' ELSE feature END AS origin, count(*) AS made,
  count(*) FILTER (kept) AS selected, {r('max(mutual_info)')} AS best_mi, round_even(count(*) FILTER (kept) / count(*), 3) AS rate FROM sel GROUP BY 1"""
    q["manual_selection"] = f"""WITH {selection}, p AS (SELECT *, feature IN ('l_quantity', 'l_tax', 'fixed') AS pick FROM sel)
SELECT feature, pick AS kept, CASE WHEN pick AND NOT kept THEN 'selected(manual)' WHEN kept AND NOT pick THEN 'removed(manual)' ELSE status END AS status FROM p"""
    q["selection_risks"] = "SELECT 'fixed' AS feature, 'no variance' AS risk, 0.0::DOUBLE AS value UNION ALL SELECT 'l_quantity + twice', 'duplicate', round_even(corr(l_quantity, 2 * l_quantity), 4) FROM lineitem"
    q["fold_jaccard"] = """WITH p AS (SELECT DISTINCT year(o_orderdate) AS f, o_custkey AS c FROM orders), s AS (SELECT f, count(*) AS n FROM p GROUP BY f),
b AS (SELECT x.f AS fa, y.f AS fb, count(*) AS m FROM p x JOIN p y ON x.c = y.c AND x.f < y.f GROUP BY ALL)
SELECT x.f AS fold_a, y.f AS fold_b, round_even(coalesce(m, 0) / (x.n + y.n - coalesce(m, 0)), 4) AS jaccard, x.n AS n_a, y.n AS n_b, coalesce(m, 0) AS common
FROM s x JOIN s y ON x.f < y.f LEFT JOIN b ON b.fa = x.f AND b.fb = y.f"""

    # preprocessing
    q["impute_ffill"] = _prepared("coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING), med_{c})")
    q["impute_median"] = _prepared("coalesce({c}, med_{c})")
    q["impute_mean_scaled"] = _prepared("coalesce({c}, avg_{c})", "({x} - m_{c}) / s_{c}")
    q["impute_zero_robust"] = _prepared("coalesce({c}, 0.0)", "({x} - q_{c}[3]) / (q_{c}[4] - q_{c}[2])")
    q["clip_quantiles"] = _prepared("coalesce({c}, med_{c})", "least(greatest({x}, q_{c}[1]), q_{c}[5])")
    level = "CASE WHEN count(*) OVER (PARTITION BY {c}) >= 0.01 * count(*) OVER () THEN {c} ELSE 'infrequent' END"
    q["encode_onehot"] = " UNION ALL ".join(
        f"SELECT p_partkey, '{c}_' || {level.format(c=c)} AS feature FROM part" for c in ("p_type", "p_name"))
    q["encode_filled"] = """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS t FROM part),
m AS (SELECT t AS m FROM p WHERE t IS NOT NULL GROUP BY t ORDER BY count(*) DESC, t LIMIT 1),
f AS (SELECT p_partkey, coalesce(t, m) AS t FROM p, m)
SELECT p_partkey, 'p_type_' || CASE WHEN count(*) OVER (PARTITION BY t) >= 0.01 * count(*) OVER () THEN t ELSE 'infrequent' END AS feature FROM f"""
    q["encode_ordinal"] = """SELECT o_orderkey, coalesce(k, -1)::DOUBLE AS o_orderpriority FROM orders LEFT JOIN (
  SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS k FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '3-MEDIUM'))
USING (o_orderpriority)"""

    # scores, leaderboards, blends
    scored = f"model, family, status, {r('r2')} AS \"holdout_R2\", {r('rmse')} AS \"holdout_RMSE\", {r('mae')} AS \"holdout_MAE\", {r('mape')} AS \"holdout_MAPE\""
    q["score_regression"] = f"WITH {BOARD} SELECT {scored} FROM board"
    fit = "(30.0 + 0.1 * user_id + 0.2 * k)"
    q["score_by_part"] = f"""WITH {sized}, s AS (SELECT {_range_case(_parts(24))} AS part, value AS y, {fit} AS p FROM z)
SELECT part, count(*) AS n, {r('1 - sum((y - p) ** 2) / (var_pop(y) * count(*))')} AS "R2", {r('sqrt(avg((y - p) ** 2))')} AS "RMSE",
  {r('avg(abs(y - p))')} AS "MAE", {r('avg(abs(y - p) / abs(y)) FILTER (abs(y) > 1e-9)')} AS "MAPE" FROM s WHERE part IS NOT NULL GROUP BY part"""
    q["score_classification"] = _labels()
    q["score_classification_by_language"] = _labels("lang, ")
    q["task_detection"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS target, CASE WHEN {f'count({c}) > 0' if text else f"count(DISTINCT {c}) <= 2 OR (count(DISTINCT {c}) <= 15 AND bool_and({c} % 1 = 0))"}
  THEN 'classification' ELSE 'regression' END AS task FROM lineitem"""
        for c, text in (("l_quantity", False), ("l_linenumber", False), ("l_returnflag", True), ("l_discount", False)))
    q["leaderboard_rank"] = f"WITH {BOARD} SELECT (row_number() OVER (ORDER BY rmse, model))::INT AS rank, model, {r('rmse')} AS \"holdout_RMSE\" FROM board"
    q["ensemble_adoption"] = f"""WITH {BOARD}, base AS (SELECT arg_min(model, rmse) AS m, min(rmse) AS v FROM board WHERE family <> 'blend')
SELECT model, round_even(rmse, 6) AS score, round_even(CASE WHEN family = 'blend' THEN (v - rmse) / abs(v) ELSE 0.0 END, 4) AS gain,
  CASE WHEN family <> 'blend' THEN 'best single' WHEN (v - rmse) / abs(v) >= 0.03 THEN 'adopted' ELSE 'rejected' END AS verdict
FROM board, base WHERE family = 'blend' OR model = m"""
    q["ridge_fit"] = f"""WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) / (var_pop(l_quantity) * count(*) + 100.0) AS b,
  avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT {r('b', 4)} AS slope, {r('my - b * mx', 4)} AS intercept FROM s"""
    q["parameter_stability"] = """SELECT event_type AS parameter, count(DISTINCT floor(value / 100)) AS n_values,
  CASE WHEN count(DISTINCT floor(value / 100)) = 1 THEN 'consistent' WHEN count(DISTINCT floor(value / 100)) <= 2 THEN 'fair' ELSE 'unstable' END AS stability
FROM events GROUP BY 1"""
    q["manifest_comparison"] = """WITH a AS (SELECT 'customer.' || o_custkey AS key, max(o_orderstatus) AS v FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 1),
b AS (SELECT 'customer.' || o_custkey AS key, max(o_orderstatus) AS v FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1)
SELECT key, a.v AS a, b.v AS b, a.v IS NOT DISTINCT FROM b.v AS equal FROM a FULL JOIN b USING (key)"""
    q["champion_challenger"] = f"""WITH o AS (SELECT year(o_orderdate) AS year, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS c,
  avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS n FROM orders GROUP BY 1)
SELECT year, {r('c')} AS champion_score, {r('n')} AS challenger_score, round_even((n - c) / abs(c), 4) AS gain,
  CASE WHEN (n - c) / abs(c) IS NULL THEN 'undecided' WHEN (n - c) / abs(c) >= 0.02 THEN 'replace' ELSE 'keep' END AS decision FROM o"""

    # residuals
    q["residual_join"] = f"""WITH {EVENTS} SELECT ts, value AS actual, {r(fit)} AS predicted, {r('value - ' + fit)} AS residual FROM ev WHERE ord % 2 = 0"""
    frame = "OVER (ORDER BY ord ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)"
    q["residual_rolling"] = f"WITH {RESIDUALS} SELECT ts, ord, {r('residual', 8)} AS residual, " + ", ".join(
        f"{r(f'CASE WHEN count(residual) {frame} >= 24 THEN {fn}({x}) {frame} END', 8)} AS {name}" for name, fn, x in
        (("roll_mean", "avg", "residual"), ("roll_std", "stddev_samp", "residual"), ("roll_mae", "avg", "abs(residual)"))) + " FROM res"
    drift = f"""{RESIDUALS}, seg AS (SELECT *, (((ord + 1) * 6 - 1) // n)::INT + 1 AS segment FROM res),
d AS (SELECT segment, min(ts) AS start, max(ts) AS "end", count(*) AS rows, avg(residual) AS mean, stddev_samp(residual) AS std,
  avg(abs(residual)) AS mae, quantile_cont(abs(residual), 0.95) AS p95 FROM seg GROUP BY 1),
dr AS (SELECT d.*, round_even(d.mae / f.mae, 3) AS mae_ratio, round_even(d.std / f.std, 3) AS std_ratio FROM d, d f WHERE f.segment = 1)"""
    q["residual_drift"] = f"""WITH {drift} SELECT segment, start, "end", rows, {r('mean')} AS mean, {r('std')} AS std, {r('mae')} AS "MAE",
  {r('p95')} AS p95_abs, mae_ratio AS "MAE_ratio", std_ratio FROM dr"""
    q["residual_drift_verdict"] = f"""WITH {drift} SELECT max(mae_ratio) >= 1.01 AS drift, max(mae_ratio) AS worst_ratio,
  arg_max(segment, (mae_ratio, -segment)) AS worst_segment, arg_max(mae_ratio, segment) AS last_ratio FROM dr"""
    zed = f"{RESIDUALS}, c AS (SELECT median(residual) AS md, mad(residual) * 1.4826 AS sc FROM res), zs AS (SELECT *, (residual - md) / sc AS z FROM res, c)"
    q["residual_outliers"] = f"""WITH {zed} SELECT ts, round_even(residual, 4) AS residual, round_even(z, 3) AS robust_z,
  CASE WHEN z > 0 THEN 'under-predicted' ELSE 'over-predicted' END AS direction FROM zs WHERE abs(z) >= 3"""
    acf = f"""{RESIDUALS}, c AS (SELECT avg(residual) AS m, var_pop(residual) * count(*) AS sq FROM res),
acf AS (SELECT lag, sum((x.residual - m) * (y.residual - m)) / any_value(sq) AS acf FROM (SELECT unnest(range(1, 25)) AS lag), c, res x, res y WHERE y.ord = x.ord + lag GROUP BY lag)"""
    q["residual_autocorrelation"] = f"WITH {acf} SELECT lag::INT AS lag, round_even(acf, 4) AS acf FROM acf"
    q["residual_summary"] = f"""WITH {acf}, o AS (SELECT count(*) AS far FROM res, (SELECT median(residual) AS md, mad(residual) * 1.4826 AS sc FROM res) WHERE abs((residual - md) / sc) >= 3)
SELECT count(*) AS n, {r('avg(residual)')} AS mean, {r('stddev_samp(residual)')} AS std, {r('avg(abs(residual))')} AS "MAE",
  {r('avg(residual) / avg(abs(residual))')} AS bias_ratio, (SELECT round_even(acf, 4) FROM acf WHERE lag = 1) AS lag1_acf, (SELECT far FROM o) AS outliers FROM res"""

    def shift(c: str) -> str:
        return f"abs(avg({c}) FILTER (ord >= n - n // 3) - avg({c}) FILTER (ord < n // 3)) / stddev_samp({c})"

    q["distribution_drift"] = f"""WITH {sized}, s AS (SELECT {shift('value')} AS y, {shift('user_id')} AS a, {shift('k')} AS b FROM z)
SELECT round_even(y, 4) AS y_shift_sd, round_even((a + b) / 2, 4) AS x_shift_sd, round_even(greatest(a, b), 4) AS x_shift_max FROM s"""
    q["split_gap_causes"] = f"""WITH {sized}, c AS (SELECT avg(value) AS m, var_pop(value) * count(*) AS sq FROM ev),
a AS (SELECT sum((x.value - m) * (y.value - m)) / any_value(sq) AS acf FROM c, ev x, ev y WHERE y.ord = x.ord + 1),
s AS (SELECT {shift('value')} AS y, {shift('user_id')} AS a, {shift('k')} AS b FROM z),
f AS (SELECT 'autocorrelation' AS cause, acf AS value, 0.5::DOUBLE AS "limit" FROM a UNION ALL SELECT 'target drift', round_even(y, 4), 0.5 FROM s
  UNION ALL SELECT 'input drift', round_even(greatest(a, b), 4), 1.0 FROM s), hit AS (SELECT * FROM f WHERE value >= "limit")
SELECT cause, {r('value')} AS value, "limit" FROM hit UNION ALL SELECT 'lag mismatch', 0.2, 0.15 WHERE NOT EXISTS (SELECT * FROM hit)"""
    bt = f"""{sized}, b AS (SELECT ((ord - (n - 5 * (n // 6))) // (n // 6))::INT + 1 AS fold, ts, value AS y, {fit} AS p FROM z WHERE ord >= n - 5 * (n // 6)),
t AS (SELECT fold, count(*) AS n, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae,
  avg(abs(y - p) / abs(y)) FILTER (abs(y) > 1e-9) AS mape, min(ts) AS test_start FROM b GROUP BY fold)"""
    q["backtest_scores"] = f"""WITH {bt} SELECT fold, n, {r('r2')} AS "R2", {r('rmse')} AS "RMSE", {r('mae')} AS "MAE", {r('mape')} AS "MAPE", test_start, 'ok' AS status FROM t"""
    q["backtest_summary"] = f"""WITH {bt} SELECT count(*) AS windows, round_even(avg(rmse), 4) AS mean, round_even(stddev_samp(rmse), 4) AS std,
  round_even(min(rmse), 4) AS min, round_even(max(rmse), 4) AS max, arg_max(fold, rmse) AS worst_fold, arg_max(test_start, rmse) AS worst_start FROM t"""

    # explanation
    q["linear_contributions"] = f"WITH {CELLS} SELECT ord, feature, feature_value, {r('shap_value')} AS shap_value FROM cells"
    def tree(user: str, k: str) -> str:
        return f"CASE WHEN {k} <= 50 THEN CASE WHEN {user} <= 40 THEN 10.0 WHEN {k} <= 20 THEN 35.0 ELSE 22.0 END WHEN {user} <= 90 THEN -4.0 ELSE 51.0 END"

    # Shapley values over the four subsets of two features, against each background row.
    q["tree_contributions"] = f"""WITH {EVENTS}, b AS (SELECT user_id AS bu, k AS bk FROM ev WHERE ord < 200),
v AS (SELECT ord, user_id, k, avg(none) AS base, avg((u - none + whole - kk) / 2) AS pu, avg((kk - none + whole - u) / 2) AS pk FROM (
  SELECT ord, user_id, k, {tree('bu', 'bk')} AS none, {tree('user_id', 'bk')} AS u, {tree('bu', 'k')} AS kk, {tree('user_id', 'k')} AS whole FROM ev, b)
  GROUP BY ALL)
SELECT ord, 'user_id' AS feature, user_id::DOUBLE AS feature_value, {r('pu')} AS shap_value, {r('base')} AS base_value FROM v
UNION ALL SELECT ord, 'k', k, {r('pk')}, {r('base')} FROM v"""
    q["class_contributions"] = """SELECT row_number() OVER (PARTITION BY l.lang ORDER BY doc_id) - 1 AS ord, l.lang AS class, 0.0::DOUBLE AS left_over
FROM documents, (SELECT DISTINCT lang FROM (SELECT lang FROM documents ORDER BY doc_id LIMIT (SELECT count(*) // 2 FROM documents))) l"""
    q["blend_contributions"] = f"""WITH {CELLS} SELECT ord, feature, {r("0.75 * shap_value + 0.25 * (CASE feature WHEN 'user_id' THEN 3.0 ELSE -0.5 END) * shap_value")} AS shap_value,
  {r('1.0 + 0.75 * (30.0 + 0.1 * mu + 0.2 * mk) + 0.25 * (10.0 + 0.3 * mu - 0.1 * mk)')} AS base_value FROM cells, mean_"""
    imp = """SELECT feature, avg(abs(shap_value)) AS a, avg(shap_value) AS m, stddev_samp(shap_value) AS s FROM {src} GROUP BY 1"""
    imp_out = f"feature, {r('a')} AS mean_abs_shap, {r('m')} AS mean_shap, {r('s')} AS std_shap, {r('100 * a / sum(a) OVER ()')} AS contribution_pct"
    q["contribution_importance"] = f"WITH {CELLS}, i AS ({imp.format(src='cells')}) SELECT {imp_out} FROM i"
    q["contribution_period"] = f"""WITH {CELLS}, part AS (SELECT * FROM cells WHERE ts BETWEEN '2024-01-05' AND '2024-01-06'), i AS ({imp.format(src='part')}),
e AS (SELECT min(ts) AS start, max(ts) AS "end" FROM part) SELECT start, "end", {imp_out} FROM e, i"""
    q["contribution_dependence"] = f"""WITH {CELLS} SELECT a.ts, a.feature_value, {r('a.shap_value')} AS shap_value, b.feature_value AS interaction_value
FROM cells a JOIN cells b USING (ord) WHERE a.feature = 'user_id' AND b.feature = 'k'"""
    halves = f"""{CELLS}, hv AS (SELECT 'early' AS period, * FROM cells WHERE ts <= '2024-01-15' UNION ALL SELECT 'late', * FROM cells WHERE ts >= '2024-01-15')"""
    q["contribution_dependence_by_period"] = f"WITH {halves} SELECT period, ts, feature_value, {r('shap_value')} AS shap_value FROM hv WHERE feature = 'k'"
    q["contribution_shift"] = f"""WITH {halves}, m AS (SELECT period, feature, avg(abs(shap_value)) AS a FROM hv GROUP BY ALL),
s AS (SELECT period, feature, 100 * a / sum(a) OVER (PARTITION BY period) AS p FROM m),
w AS (SELECT feature, max(p) FILTER (period = 'early') AS early, max(p) FILTER (period = 'late') AS late FROM s GROUP BY 1)
SELECT feature, {r('early')} AS early, {r('late')} AS late, {r('late - early')} AS change FROM w"""
    q["contribution_interaction"] = f"WITH {EVENTS} SELECT 'k' AS feature, {r('abs(corr(k, user_id))')} AS r FROM ev"
    q["contribution_local"] = f"""WITH {CELLS}, a AS (SELECT arg_min(ord, (abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-17 12:00:00')), ord)) AS o FROM ev)
SELECT ts, feature, {r('shap_value')} AS shap_value, feature_value FROM cells, a WHERE ord = o"""
    q["contribution_trend"] = f"""WITH {CELLS}, c AS (SELECT list_distinct(quantile_cont(feature_value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q FROM cells WHERE feature = 'k'),
b AS (SELECT {_bins('feature_value', 'q')}::INT AS bin, feature_value AS x, shap_value AS y FROM cells, c WHERE feature = 'k')
SELECT bin, {r('median(x)')} AS x, {r('avg(y)')} AS y FROM b GROUP BY bin"""
    q["contribution_stream"] = f"WITH {CELLS} SELECT date_trunc('day', ts)::TIMESTAMP AS ts, feature, {r('avg(shap_value)')} AS shap_value FROM cells GROUP BY ALL"

    # what if
    q["scenario_rows"] = f"WITH {MOVED} SELECT ord, ts, {r('baseline')} AS baseline, {r('scenario')} AS scenario, {r('scenario - baseline')} AS delta FROM mv"
    q["predicted_period"] = f"""WITH {EVENTS} SELECT ord, ts, {r('30.0 + 0.1 * user_id + 0.2 * k')} AS prediction FROM ev
WHERE ts BETWEEN '2024-01-10 06:00:00' AND '2024-01-12 18:30:00'"""
    q["scenario_summary"] = f"""WITH {MOVED} SELECT {r('avg(baseline)')} AS baseline_mean, {r('avg(scenario)')} AS scenario_mean, {r('avg(scenario - baseline)')} AS mean_change,
  {r('100 * avg(scenario - baseline) / avg(baseline)')} AS change_pct, {r('max(scenario - baseline)')} AS max_up, {r('min(scenario - baseline)')} AS max_down FROM mv"""
    nu, nk = "user_id * (1 + 10.0 / 100)", "k + (user_id * (1 + 10.0 / 100) - user_id) * 0.5 + 5.0"
    q["scenario_extrapolation"] = f"WITH {EVENTS}, o AS (SELECT min(user_id) AS ul, max(user_id) AS uh, min(k) AS kl, max(k) AS kh FROM ev), x AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, any_value({lo})::DOUBLE AS seen_min, any_value({hi})::DOUBLE AS seen_max, {r(f'min({e})')} AS scenario_min, {r(f'max({e})')} AS scenario_max, "
        f"round_even(avg(({e} < {lo} OR {e} > {hi})::INT), 4) AS outside_ratio, avg(({e} < {lo} OR {e} > {hi})::INT) AS raw FROM ev, o"
        for f, e, lo, hi in (("user_id", nu, "ul", "uh"), ("k", nk, "kl", "kh"))) + """)
SELECT feature, seen_min, seen_max, scenario_min, scenario_max, outside_ratio,
  CASE WHEN raw = 0 THEN 'inside' WHEN raw < 0.2 THEN 'partly outside' ELSE 'mostly outside' END AS verdict FROM x"""
    q["sweep_curve"] = f"""WITH {EVENTS}, g AS (SELECT unnest([0.0, 25.0, 50.0, 75.0, 100.0])::DOUBLE AS grid)
SELECT grid, {r('avg(30.0 + 0.1 * user_id + 0.2 * grid)')} AS prediction, {r('quantile_cont(30.0 + 0.1 * user_id + 0.2 * grid, 0.1)')} AS p10,
  {r('quantile_cont(30.0 + 0.1 * user_id + 0.2 * grid, 0.9)')} AS p90 FROM ev, g GROUP BY grid"""
    rng = "rg AS (SELECT quantile_cont({c}, 0.01) - 0.1 * (quantile_cont({c}, 0.99) - quantile_cont({c}, 0.01)) AS a, quantile_cont({c}, 0.99) + 0.1 * (quantile_cont({c}, 0.99) - quantile_cont({c}, 0.01)) AS b FROM ev)"
    q["sweep_range"] = f"WITH {EVENTS}, {rng.format(c='value')} SELECT i::INT AS position, {r('a + (b - a) * i / 4.0')} AS value FROM rg, (SELECT unnest(range(5)) AS i)"
    q["sweep_best"] = f"""WITH {EVENTS}, {rng.format(c='k')}, g AS (SELECT a + (b - a) * i / 10.0 AS grid FROM rg, (SELECT unnest(range(11)) AS i)),
c AS (SELECT grid, avg(30.0 + 0.1 * user_id + 0.2 * grid) AS p FROM ev, g GROUP BY grid)
SELECT {r('arg_min(grid, abs(p - 45.0))')} AS best_value, {r('arg_min(p, abs(p - 45.0))')} AS expected FROM c"""

    q["ice_curves"] = f"""WITH {EVENTS}, drawn AS (SELECT ord, ts, user_id FROM ev ORDER BY md5('42:' || ord), ord LIMIT 40)
SELECT ord, ts, grid, {r('30.0 + 0.1 * user_id + 0.2 * grid')} AS prediction FROM drawn, (SELECT unnest([0.0, 50.0, 100.0])::DOUBLE AS grid)"""

    # unsupervised
    q["cluster_profile"] = "WITH t AS (" + " UNION ALL ".join(
        f"SELECT 'd{i}' AS feature, label, embedding[{i + 1}]::DOUBLE AS v FROM embeddings" for i in range(64)) + f""")
SELECT feature, label AS cluster, {r('avg(v)')} AS cluster_mean, count(*) AS rows, {r('any_value(o)')} AS overall_mean
FROM t JOIN (SELECT feature, avg(v) AS o FROM t GROUP BY 1) USING (feature) GROUP BY feature, label"""
    q["cluster_quality"] = f"""WITH t AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS d FROM embeddings),
c AS (SELECT label, d, avg(v) AS m FROM t GROUP BY ALL), o AS (SELECT d, avg(v) AS m FROM t GROUP BY d),
reach AS (SELECT t.label, vec_id, sum((v - m) ** 2) AS sq FROM t JOIN c ON c.label = t.label AND c.d = t.d GROUP BY ALL),
s AS (SELECT label, avg(sqrt(sq)) AS s, sum(sq) AS w, count(*) AS n FROM reach GROUP BY 1),
apart AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.m - b.m) ** 2)) AS dist FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY ALL),
db AS (SELECT la, max((x.s + y.s) / dist) AS worst FROM apart JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY la),
bt AS (SELECT c.label, sum((c.m - o.m) ** 2) AS b FROM c JOIN o USING (d) GROUP BY 1),
far AS (SELECT vec_id, t.label, c.label AS other, sum((v - c.m) ** 2) + any_value(s.w / s.n) AS dist, any_value(s.n) AS n
  FROM t JOIN c USING (d) JOIN s ON s.label = c.label GROUP BY vec_id, t.label, c.label),
ab AS (SELECT vec_id, max(dist * n / (n - 1)) FILTER (label = other AND n > 1) AS a, min(dist) FILTER (label <> other) AS b FROM far GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS x FROM ab)
SELECT count(*)::INT AS n_clusters, 0.0::DOUBLE AS noise_ratio, (SELECT round(x, 4) FROM sil) AS silhouette, (SELECT {r('avg(worst)', 4)} FROM db) AS davies_bouldin,
  {r('sum(n * b) * (sum(n) - count(*)) / (sum(w) * (count(*) - 1))', 4)} AS calinski_harabasz FROM s JOIN bt USING (label)"""

    q["nearest_neighbours"] = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e)) AS k
  FROM v a, v b WHERE a.vec_id % 2 = 1 AND b.vec_id % 2 = 0)
SELECT vec_id, {r('avg(label)')} AS prediction FROM d WHERE k <= 15 GROUP BY 1"""
    q["anomaly_local"] = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.e, b.e) AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e)) AS k
  FROM v a, v b WHERE a.vec_id <> b.vec_id), nn AS (SELECT * FROM d WHERE k <= 35), kd AS (SELECT p AS o, max(dist) AS kdist FROM nn GROUP BY 1),
lrd AS (SELECT p, 1 / (avg(greatest(dist, kdist)) + 1e-10) AS lrd FROM nn JOIN kd USING (o) GROUP BY 1),
s AS (SELECT nn.p AS ord, -avg(b.lrd) / any_value(a.lrd) AS score FROM nn JOIN lrd b ON b.p = nn.o JOIN lrd a ON a.p = nn.p GROUP BY 1)
SELECT ord, {r('score')} AS anomaly_score, score < (SELECT quantile_cont(score, 0.01) FROM s) AS is_anomaly FROM s"""

    q["density_clusters"] = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE list_distance(a.e, b.e) <= 1.2),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 5),
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
reach AS (SELECT id, id AS c FROM core UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.id),
label AS (SELECT id, min(c) AS label FROM reach GROUP BY 1),
every AS (SELECT * FROM label UNION ALL SELECT a, min(label) FROM near JOIN label ON id = b WHERE a NOT IN (FROM core) GROUP BY 1),
placed AS (SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS cluster FROM every GROUP BY 1)
SELECT coalesce(cluster, -1)::INT AS cluster, count(*) AS rows FROM v LEFT JOIN every USING (id) LEFT JOIN placed USING (label) GROUP BY 1"""

    q["linkage_clusters"] = """WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a, v b WHERE list_distance(a.e, b.e) <= 1.13),
reach AS (SELECT id, id AS c FROM v UNION SELECT n.b, r.c FROM reach r JOIN near n ON n.a = r.id),
label AS (SELECT id, min(c) AS label FROM reach GROUP BY 1)
SELECT (row_number() OVER (ORDER BY label) - 1)::INT AS cluster, count(*) AS rows FROM label GROUP BY label"""

    # flagship
    out = [f"{r('h.' + c)} AS {c}" for c in [*INPUTS, "purchase"]]
    f6 = "OVER (ORDER BY ord ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
    for c in INPUTS:
        out += [f"{r(f'lag({c}, {k}) OVER (ORDER BY ord)')} AS {c}__lag{k}" for k in (1, 3)]
        out += [f"{r(f'CASE WHEN count({c}) {f6} >= 3 THEN {fn}({c}) {f6} END')} AS {c}__roll6_{s}" for s, fn in (("mean", "avg"), ("std", "stddev_samp"))]
        out += [f"{r(f'{c} - lag({c}) OVER (ORDER BY ord)')} AS {c}__diff1"]
    q["hourly_features_split"] = f"WITH {HOURLY} SELECT ts, ord, {', '.join(out)}, {_range_case(_parts(6))} AS part FROM h"
    return q
