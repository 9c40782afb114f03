"""DuckDB text for the registered queries (the correctness oracle).

Built from the same fixed values as the Spark side; margins come from
:func:`sql_margin`, which writes the sum in the same order as the Column
expression, and every double literal is an exact ``CAST('…' AS DOUBLE)``.
"""

from __future__ import annotations

from tabscore.functions.hashing import sql_hash32
from tabscore.functions.linear import LinearModel, logit, sql_double, sql_margin
from tabscore.plans import catalogue as c

ONE = "CAST(1 AS DOUBLE)"


def pred(model: LinearModel, threshold: float = 0.5, typ: str = "DOUBLE") -> str:
    cut = 0.0 if threshold == 0.5 else logit(threshold)
    return f"CAST({sql_margin(model)} > {sql_double(cut)} AS {typ})"


def prob(model: LinearModel, digits: int | None = 6) -> str:
    p = f"({ONE} / ({ONE} + exp(-{sql_margin(model)})))"
    return f"round({p}, {digits})" if digits is not None else p


def invalid_events() -> str:
    return f"SELECT event_id, ts, user_id, event_type, {c.INVALID_VALUE} AS value, props FROM events"


LABELLED = "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
HOLED = f"SELECT doc_id, {c.HOLED_CHARS} AS n_chars, {c.HOLED_LABEL} AS quality FROM ({LABELLED})"
LABELLED_AND_VALID = f"SELECT * FROM ({HOLED}) WHERE quality IS NOT NULL AND NOT isnan(quality) AND n_chars IS NOT NULL"


def _metrics(model: LinearModel, label: str, source: str = LABELLED) -> str:
    return f"""
WITH d AS (SELECT doc_id, n_chars, {label} AS y FROM ({source}) t),
s AS (SELECT y, {pred(model)} AS p FROM d),
k AS (SELECT count(*) FILTER (WHERE y IS NOT NULL AND p IS NOT NULL) AS n,
             count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn,
             count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn FROM s)
SELECT n, tp, fp, fn, tn,
  round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
             ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1
FROM k"""


def _evaluate_many() -> str:
    parts = []
    for m in (c.DOC_MODEL, c.DOC_NEVER, c.DOC_MODEL_B):
        parts.append(f"SELECT '{m.name}' AS model_name, '{m.version}' AS model_version, * "
                     f"FROM ({_metrics(m, 'quality')}) t")
    return "\nUNION ALL ".join(parts)


def _evaluate_many_invalid() -> str:
    labelled = f"FROM ({HOLED}) h WHERE quality IS NOT NULL AND NOT isnan(quality)"
    return "\nUNION ALL ".join(
        f"SELECT '{m.name}' AS model_name, '{m.version}' AS model_version, *, "
        f"(SELECT count(*) {labelled} AND n_chars IS NULL) AS invalid FROM ({_metrics(m, 'quality', LABELLED_AND_VALID)}) t"
        for m in (c.DOC_MODEL, c.DOC_MODEL_B))


def _whole_row_invalid() -> str:
    p = pred(c.EVENTS_MODEL)
    source = f"(SELECT event_id, user_id, value, {c.BIG_ID} AS big_id FROM ({invalid_events()}))"
    return (f"SELECT event_id, user_id, value, big_id, CASE WHEN {VALID} THEN {p} END AS prediction, 'null' AS policy FROM {source} "
            f"UNION ALL SELECT event_id, user_id, value, big_id, {p} AS prediction, 'skip' AS policy FROM {source} WHERE {VALID}")


def _score_models_job_invalid() -> str:
    a, u = c.EVENTS_MODEL, c.USER_MODEL
    k = (f"(SELECT count(*) AS n, count(*) FILTER (WHERE NOT ({VALID})) AS bad, "
         f"count(*) FILTER (WHERE {VALID} AND {sql_margin(a)} > 0) AS pa, count(*) FILTER (WHERE {sql_margin(u)} > 0) AS pu "
         f"FROM ({invalid_events()}) e) k")
    none = "CAST(NULL AS BIGINT)"
    rows = []
    for policy in ("error", "skip", "null"):
        stopped = policy == "error"
        left = {"error": none, "skip": "n - bad", "null": "n"}[policy]
        rows += [f"SELECT '{policy}' AS policy, 'events_a' AS model_name, "
                 + ("'error: ' || bad || ' invalid rows'" if stopped else "'ok'")
                 + f" AS status, {left} AS \"rows\", {none if stopped else 'pa'} AS positives, bad AS invalid, "
                 + f"{'0' if stopped else left} AS written FROM {k}",
                 f"SELECT '{policy}', 'events_user', 'ok', n, pu, 0, n FROM {k}",
                 f"SELECT '{policy}', 'ghost', 'error: unknown model', {none}, {none}, {none}, 0"]
    return "\nUNION ALL ".join(rows)


def _training_extract_nan_label() -> str:
    return (f"SELECT l_quantity, l_extendedprice, l_discount, l_tax, risk AS target "
            f"FROM (SELECT *, {c.HOLED_RISK} AS risk FROM lineitem) WHERE CAST(l_shipdate AS DATE) BETWEEN "
            f"DATE '{c.TRAIN_WINDOW[0]}' AND DATE '{c.TRAIN_WINDOW[1]}' AND risk IS NOT NULL AND NOT isnan(risk)")


def _describe() -> str:
    aggs, parts = [], []
    for i, col in enumerate(c.LINEITEM_FEATURES):
        aggs.append(f"CAST(count({col}) AS DOUBLE) AS n{i}, avg({col}) AS m{i}, stddev_samp({col}) AS s{i}, "
                    f"min({col}) AS lo{i}, quantile_cont({col}, 0.25) AS a{i}, "
                    f"quantile_cont({col}, 0.5) AS b{i}, quantile_cont({col}, 0.75) AS c{i}, max({col}) AS hi{i}")
        for stat, expr in (("count", f"n{i}"), ("mean", f"m{i}"), ("std", f"s{i}"), ("min", f"lo{i}"),
                           ("25%", f"a{i}"), ("50%", f"b{i}"), ("75%", f"c{i}"), ("max", f"hi{i}")):
            parts.append(f"SELECT '{col}' AS column_name, '{stat}' AS statistic, "
                         f"round(CAST({expr} AS DOUBLE), 6) AS value FROM st")
    return "WITH st AS (SELECT " + ", ".join(aggs) + " FROM lineitem)\n" + "\nUNION ALL ".join(parts)


def _scaler_fit() -> str:
    parts = []
    for col in c.LINEITEM_FEATURES:
        parts.append(
            f"SELECT '{col}' AS feature, count({col}) AS n, round(avg({col}), 6) AS mean, "
            f"round(stddev_pop({col}), 6) AS std, "
            f"round(CASE WHEN stddev_pop({col}) = 0 THEN 1.0 ELSE stddev_pop({col}) END, 6) AS scale "
            f"FROM lineitem")
    return "\nUNION ALL ".join(parts)


def _scaler_transform() -> str:
    stats = ", ".join(f"avg({col}) AS m{i}, stddev_pop({col}) AS s{i}" for i, col in enumerate(c.LINEITEM_FEATURES))
    cols = ", ".join(f"round(({col} - m{i}) / (CASE WHEN s{i} = 0 THEN 1.0 ELSE s{i} END), 6) AS {col}"
                     for i, col in enumerate(c.LINEITEM_FEATURES))
    return f"WITH s AS (SELECT {stats} FROM lineitem) SELECT l_orderkey, l_linenumber, {cols} FROM lineitem, s"


def _validate_report() -> str:
    counts = {
        "event_id": "count(*) FILTER (WHERE event_id IS NULL)",
        "value": "count(*) FILTER (WHERE value IS NULL OR isnan(value))",
        "user_id": "count(*) FILTER (WHERE user_id IS NULL)",
        "ts": "count(*) FILTER (WHERE ts IS NULL)",
        "props": "count(*) FILTER (WHERE props IS NULL)",
        "event_type": "count(*) FILTER (WHERE event_type IS NULL)",
    }
    k = "WITH e AS (" + invalid_events() + "), k AS (SELECT " + \
        ", ".join(f"{v} AS c_{n}" for n, v in counts.items()) + " FROM e)\n"
    rows = [("event_id", "'int64'", "'bigint'", "ok", "c_event_id"),
            ("value", "'float64'", "'double'", "ok", "c_value"),
            ("user_id", "'int32'", "'bigint'", "dtype", "c_user_id"),
            ("score", "'float64'", "CAST(NULL AS VARCHAR)", "missing", "CAST(NULL AS BIGINT)"),
            ("ts", "'datetime64[ns]'", "'timestamp_ntz'", "ok", "c_ts"),
            ("props", "'object'", "'string'", "ok", "c_props"),
            ("label", "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)", "absent_optional", "CAST(NULL AS BIGINT)"),
            ("event_type", "CAST(NULL AS VARCHAR)", "'string'", "undeclared", "c_event_type")]
    return k + "\nUNION ALL ".join(
        f"SELECT '{n}' AS column_name, {e} AS expected_dtype, {a} AS actual_dtype, '{s}' AS status, "
        f"CAST({cnt} AS BIGINT) AS invalid_rows FROM k" for n, e, a, s, cnt in rows)


def _score_many() -> str:
    models = (c.EVENTS_MODEL, c.EVENTS_MODEL_B, c.EVENTS_MODEL_C)
    return "\nUNION ALL ".join(
        f"SELECT event_id, '{m.name}' AS model_name, '{m.version}' AS model_version, "
        f"{pred(m)} AS prediction, {prob(m)} AS probability FROM events" for m in models)


def _score_ensemble(source: str = "events") -> str:
    a, b, d = (prob(m, None) for m in (c.EVENTS_MODEL, c.EVENTS_MODEL_B, c.EVENTS_MODEL_C))
    mean = f"((({a} + {b}) + {d}) / CAST(3 AS DOUBLE))"
    return (f"SELECT event_id, round({mean}, 6) AS probability, "
            f"CAST({mean} > {sql_double(0.5)} AS DOUBLE) AS prediction FROM {source}")


def _model_status() -> str:
    known = {m.name: m for m in (c.EVENTS_MODEL, c.EVENTS_MODEL_B, c.EVENTS_MODEL_C)}
    parts = []
    for name in c.STATUS_REQUEST:
        if name in known:
            parts.append(f"SELECT '{name}' AS model_name, 'ok' AS status, count(*) AS \"rows\", "
                         f"count(*) FILTER (WHERE {sql_margin(known[name])} > {sql_double(0.0)}) AS positives "
                         f"FROM events")
        else:
            parts.append(f"SELECT '{name}' AS model_name, 'error: unknown model' AS status, "
                         f"CAST(NULL AS BIGINT) AS \"rows\", CAST(NULL AS BIGINT) AS positives")
    return "\nUNION ALL ".join(parts)


def _score_events(where: str = "", source: str = "events", null_invalid: bool = False) -> str:
    p = pred(c.EVENTS_MODEL)
    if null_invalid:
        p = f"CASE WHEN value IS NULL OR isnan(value) THEN NULL ELSE {p} END"
    return f"SELECT event_id, user_id, value, {p} AS prediction FROM {source} {where}"


def _quarantine_reason() -> str:
    return ("CASE WHEN value IS NULL THEN 'null:value' WHEN isnan(value) THEN 'nan:value' "
            "WHEN user_id IS NULL THEN 'null:user_id' ELSE 'ok' END")


NEWTON_ROUNDS = 30


def _newton(points: str) -> str:
    """Recursive CTE ``it(k, w, b)``: Newton steps for C*sum(logloss) + w^2/2 on ``points(x, y)``."""
    return f"""it(k, w, b) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT k + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb),
         b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb)
  FROM (SELECT q.k AS k, q.w AS w, q.b AS b,
               sum((p - y) * x) + q.w AS gw, sum(p - y) AS gb,
               sum(p * (1 - p) * x * x) + 1 AS hww, sum(p * (1 - p) * x) AS hwb, sum(p * (1 - p)) AS hbb
        FROM (SELECT it.k, it.w, it.b, {points}.x, {points}.y,
                     1 / (1 + exp(-(it.w * {points}.x + it.b))) AS p
              FROM it, {points} WHERE it.k < {NEWTON_ROUNDS}) q
        GROUP BY q.k, q.w, q.b) g)"""


#: Momentum steps of the wide fit's twin: enough for 1e-8 at sf0.01 (the step is one over a bound of the curvature).
WIDE_ROUNDS = 1500


def _train_wide(digits: int) -> str:
    """Accelerated gradient steps on the same objective; vectors are lists, the last element the intercept."""
    k = c.EMBED_DIM + 1
    zeros = f"list_transform(range({k}), lambda i: CAST(0 AS DOUBLE))"
    return f"""WITH RECURSIVE e AS (
  SELECT list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), CAST(1 AS DOUBLE)) AS x,
         CAST(label >= 5 AS DOUBLE) AS y FROM embeddings),
lip AS (SELECT 0.25 * sum(list_dot_product(x, x)) + 1 AS l FROM e),
pace AS (SELECT l, (sqrt(l) - sqrt(0.5)) / (sqrt(l) + sqrt(0.5)) AS m FROM lip),
it(k, w, v) AS (
  SELECT 0, {zeros}, {zeros}
  UNION ALL
  SELECT k + 1, list(nw ORDER BY j), list(nw + m * (nw - ow) ORDER BY j)
  FROM (
    SELECT q.k, j, q.v[j] - (sum(r * x[j]) + CASE WHEN j < {k} THEN q.v[j] ELSE 0 END) / pace.l AS nw, q.w[j] AS ow, pace.m
    FROM (SELECT it.k, it.w, it.v, e.x, 1 / (1 + exp(-list_dot_product(e.x, it.v))) - e.y AS r
          FROM it, e WHERE it.k < {WIDE_ROUNDS}) q, range(1, {k + 1}) u(j), pace
    GROUP BY q.k, j, q.v[j], q.w[j], pace.l, pace.m) g
  GROUP BY k)
SELECT (SELECT count(*) FROM e) AS n, CASE WHEN j = {k} THEN 'intercept' ELSE 'e' || (j - 1) END AS term,
       round(w[j], {digits}) AS value
FROM it, range(1, {k + 1}) u(j) WHERE k = {WIDE_ROUNDS}"""


def _wide_margin() -> str:
    exprs = {f: f"embedding[{i + 1}]" for i, f in enumerate(c.EMBED_MODEL.features)}
    return sql_margin(c.EMBED_MODEL, exprs=exprs)


def _train_logistic() -> str:
    return f"""WITH RECURSIVE src AS (
  SELECT CAST(d.n_chars AS DOUBLE) AS x, CAST(l.quality AS DOUBLE) AS y
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL),
st AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM src),
z AS (SELECT (x - m) / (CASE WHEN sd = 0 THEN 1.0 ELSE sd END) AS x, y FROM src, st),
{_newton("z")}
SELECT (SELECT count(*) FROM src) AS n, 'intercept' AS term, round(b, 6) AS value
FROM it WHERE k = {NEWTON_ROUNDS}
UNION ALL
SELECT (SELECT count(*) FROM src) AS n, 'n_chars' AS term, round(w, 6) AS value
FROM it WHERE k = {NEWTON_ROUNDS}"""


def _train_job(source: str = LABELLED, counts: str = "(SELECT count(*) FROM src) AS n") -> str:
    return _train_job_ctes(source) + f"""
SELECT {counts},
  round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp + tn AS DOUBLE) / n END, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1
FROM c"""


def _train_own_function() -> str:
    scored = "scored AS (SELECT y, CAST(x - (SELECT avg(x) FROM train WHERE y = 1) / 3 > 0 AS DOUBLE) AS p FROM test)"
    sql = _train_job()
    start = sql.index("scored AS (")
    return sql[:start] + scored + sql[sql.index(",\nc AS ("):]


def _train_and_score() -> str:
    margin = "(((CAST(d.n_chars AS DOUBLE) - m) / sd) * w + b)"
    return _train_job_ctes() + f"""
SELECT d.doc_id, CAST({margin} > 0 AS INTEGER) AS prediction,
       round({ONE} / ({ONE} + exp(-{margin})), 6) AS probability
FROM documents d, st, fin"""


def _train_job_ctes(source: str = LABELLED) -> str:
    h = sql_hash32(["doc_id"], 42)
    return f"""WITH RECURSIVE src AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y
  FROM ({source}) t WHERE quality IS NOT NULL),
ranked AS (SELECT x, y, row_number() OVER (ORDER BY {h}, doc_id) AS rn FROM src),
cut AS (SELECT ceil(count(*) * 0.2) AS kk FROM src),
train AS (SELECT x, y FROM ranked, cut WHERE rn > kk),
test AS (SELECT x, y FROM ranked, cut WHERE rn <= kk),
st AS (SELECT avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM train),
z AS (SELECT (x - m) / sd AS x, y FROM train, st),
{_newton("z")},
fin AS (SELECT w, b FROM it WHERE k = {NEWTON_ROUNDS}),
scored AS (SELECT y, CAST(((x - m) / sd) * w + b > 0 AS DOUBLE) AS p FROM test, st, fin),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp,
             count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn,
             count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn FROM scored)"""


VALID = "value IS NOT NULL AND NOT isnan(value)"


def _score_many_invalid() -> str:
    return "\nUNION ALL ".join(
        f"SELECT event_id, '{m.name}' AS model_name, '{m.version}' AS model_version, "
        f"CASE WHEN {VALID} THEN {pred(m)} END AS prediction, CASE WHEN {VALID} THEN {prob(m)} END AS probability "
        f"FROM ({invalid_events()}) e" for m in c.EVENTS_MODELS)


def _model_status_invalid() -> str:
    known = {m.name: m for m in c.EVENTS_MODELS}
    parts = []
    for name in c.STATUS_REQUEST:
        if name in known:
            parts.append(f"SELECT '{name}' AS model_name, CASE WHEN count(*) FILTER (WHERE NOT ({VALID})) = 0 THEN 'ok' "
                         f"ELSE 'error: ' || count(*) FILTER (WHERE NOT ({VALID})) || ' invalid rows' END AS status, "
                         f"count(*) AS \"rows\", count(*) FILTER (WHERE {VALID} AND "
                         f"{sql_margin(known[name])} > {sql_double(0.0)}) AS positives FROM ({invalid_events()}) e")
        else:
            parts.append(f"SELECT '{name}' AS model_name, 'error: unknown model' AS status, "
                         f"CAST(NULL AS BIGINT) AS \"rows\", CAST(NULL AS BIGINT) AS positives")
    return "\nUNION ALL ".join(parts)


def _train_job_invalid() -> str:
    holed = f"FROM ({HOLED}) h"
    unlabelled = "quality IS NULL OR isnan(quality)"
    return _train_job(LABELLED_AND_VALID, f"""(SELECT count(*) {holed}) AS n, (SELECT count(*) {holed}) AS rows_in,
  (SELECT count(*) {holed} WHERE {unlabelled}) AS rows_unlabelled,
  (SELECT count(*) {holed} WHERE NOT ({unlabelled}) AND n_chars IS NULL) AS rows_invalid,
  (SELECT count(*) FROM train) AS train, (SELECT count(*) FROM test) AS test""")


def build() -> dict[str, str]:
    m = c.EVENTS_MODEL
    inv = f"({invalid_events()}) e"
    h_split = sql_hash32(["o_orderkey"], c.SPLIT_SEED)
    frac = f"CAST('{c.SPLIT_FRACTION!r}' AS DOUBLE)"
    return {
        "training_extract": (
            "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber AS target FROM lineitem "
            f"WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{c.TRAIN_WINDOW[0]}' AND DATE '{c.TRAIN_WINDOW[1]}' "
            "AND l_linenumber IS NOT NULL "
            f"AND {sql_hash32(['l_orderkey', 'l_linenumber'])} < {c.SAMPLE_FRACTION} * 4294967296.0"),
        "scoring_extract": (
            "SELECT o_orderkey, o_totalprice, o_custkey FROM orders "
            f"WHERE CAST(o_orderdate AS DATE) = DATE '{c.SCORING_DAY}'"),
        "keyed_sample": (
            "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders "
            f"WHERE {sql_hash32(['o_orderkey'], c.SAMPLE_SEED)} < {c.SAMPLE_FRACTION} * 4294967296.0"),
        "filter_project": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000.0",
        "exact_split": (
            f"WITH h AS (SELECT o_orderkey, o_custkey, o_totalprice, {h_split} AS h FROM orders), "
            "r AS (SELECT *, row_number() OVER (ORDER BY h, o_orderkey) AS rn FROM h) "
            "SELECT o_orderkey, o_custkey, o_totalprice FROM r "
            f"WHERE rn <= (SELECT ceil(count(*) * {frac}) FROM orders)"),
        "split_sizes": (
            f"SELECT 'train' AS side, count(*) - CAST(ceil(count(*) * {frac}) AS BIGINT) AS \"rows\" FROM orders "
            f"UNION ALL SELECT 'test' AS side, CAST(ceil(count(*) * {frac}) AS BIGINT) AS \"rows\" FROM orders"),
        "approx_split": (
            "SELECT event_id, user_id, value FROM events "
            f"WHERE {sql_hash32(['event_id'], c.SPLIT_SEED)} < {c.SPLIT_FRACTION} * 4294967296.0"),
        "scaler_fit": _scaler_fit(),
        "scaler_transform": _scaler_transform(),
        "score_linear": _score_events(),
        "score_lineitem": f"SELECT l_orderkey, l_linenumber, {pred(c.LINEITEM_MODEL)} AS prediction FROM lineitem",
        "score_lineitem_python": (
            f"SELECT l_orderkey, l_linenumber, {pred(c.LINEITEM_MODEL)} AS prediction FROM lineitem"),
        "score_wide": (
            f"SELECT vec_id, label, CAST({_wide_margin()} > {sql_double(0.0)} AS DOUBLE) AS prediction, "
            f"round({ONE} / ({ONE} + exp(-{_wide_margin()})), 6) AS probability FROM embeddings"),
        "score_documents": (
            f"SELECT doc_id, n_chars, n_lines, {prob(c.DOC_TEXT_MODEL)} AS probability, "
            f"{pred(c.DOC_TEXT_MODEL, typ='INTEGER')} AS prediction "
            "FROM (SELECT doc_id, n_chars, len(string_split(text, chr(10))) AS n_lines FROM documents) d"),
        "score_lineitem_udf": (
            f"SELECT l_orderkey, l_linenumber, {pred(c.LINEITEM_MODEL)} AS prediction FROM lineitem"),
        "score_threshold": (
            f"SELECT event_id, {pred(m, c.THRESHOLD, 'INTEGER')} AS is_positive, {prob(m)} AS p_positive, "
            f"TIMESTAMP '{c.RUN_TS.isoformat(sep=' ')}' AS scored_at FROM events"),
        "score_python": _score_events(),
        "score_skip_invalid": _score_events("WHERE value IS NOT NULL AND NOT isnan(value)", inv),
        "score_null_invalid": _score_events("", inv, null_invalid=True),
        "quarantine_counts": f"SELECT {_quarantine_reason()} AS reason, count(*) AS \"rows\" FROM {inv} GROUP BY 1",
        "quarantine_rows": (
            f"SELECT event_id, user_id, {_quarantine_reason()} AS reject_reason FROM {inv} "
            "WHERE value IS NULL OR isnan(value) OR user_id IS NULL"),
        "validate_report": _validate_report(),
        "evaluate_binary": _metrics(c.DOC_MODEL, "quality"),
        "evaluate_no_positives": _metrics(c.DOC_NEVER, "toxic"),
        "evaluate_positional": _metrics(c.DOC_MODEL, "quality"),
        "evaluate_many": _evaluate_many(),
        "describe_numeric": _describe(),
        "value_counts": ("SELECT event_type, count(*) AS \"count\" FROM events "
                         "WHERE event_type IS NOT NULL GROUP BY event_type"),
        "head_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10",
        "not_null_check": (
            f"WITH s AS ({_score_events('', inv, null_invalid=True)}) "
            "SELECT count(*) FILTER (WHERE prediction IS NULL OR isnan(prediction)) AS null_rows, "
            "count(*) AS \"rows\" FROM s"),
        "score_many": _score_many(),
        "score_ensemble": _score_ensemble(),
        "model_status": _model_status(),
        "runlog_current": (
            "SELECT run_id, key, value, seq FROM (SELECT user_id AS run_id, event_type AS key, value, "
            "event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type "
            "ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1"),
        "latest_version": (
            "SELECT model_name, version, accuracy FROM (SELECT event_type AS model_name, event_id AS version, "
            "value AS accuracy, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn "
            "FROM events) t WHERE rn = 1"),
        "batch_score_job": _score_events(),
        "stream_score": _score_events(),
        "stream_batch_sink": _score_events(),
        "stream_requests": (
            f"SELECT event_id // {c.REQUEST_SIZE} AS request_id, "
            f"row_number() OVER (PARTITION BY event_id // {c.REQUEST_SIZE} ORDER BY event_id) - 1 AS pos, "
            f"event_id, user_id, value, {pred(m)} AS prediction FROM events"),
        "csv_roundtrip": "SELECT * FROM customer",
        "parquet_roundtrip": "SELECT * FROM customer",
        "json_roundtrip": "SELECT * FROM part",
        "table_roundtrip": "SELECT * FROM customer",
        "train_logistic": _train_logistic(),
        "train_wide": _train_wide(5),
        "train_wide_lbfgs": _train_wide(5),
        "train_wide_mllib": _train_wide(3),
        "train_job": _train_job(),
        "train_from_config": _train_job(),
        "train_own_function": _train_own_function(),
        "train_from_extract": _train_job(
            f"SELECT o_orderkey AS doc_id, o_totalprice AS n_chars, {c.ORDER_DONE} AS quality FROM orders WHERE CAST(o_orderdate AS DATE) "
            f"BETWEEN DATE '{c.TRAIN_WINDOW[0]}' AND DATE '{c.TRAIN_WINDOW[1]}'",
            "(SELECT count(*) FROM src) AS n, (SELECT count(*) FROM train) AS train, (SELECT count(*) FROM test) AS test"),
        "train_and_score": _train_and_score(),
        "score_python_invalid": _score_events("", inv, null_invalid=True),
        "score_udf_invalid": _score_events(f"WHERE {VALID}", inv),
        "score_many_invalid": _score_many_invalid(),
        "score_ensemble_invalid": _score_ensemble(f"({invalid_events()}) e WHERE {VALID}"),
        "model_status_invalid": _model_status_invalid(),
        "stream_reply_invalid": (
            f"SELECT event_id // {c.REQUEST_SIZE} AS request_id, "
            f"row_number() OVER (PARTITION BY event_id // {c.REQUEST_SIZE} ORDER BY event_id) - 1 AS pos, "
            f"event_id, user_id, value, CASE WHEN {VALID} THEN {pred(m)} END AS prediction FROM {inv}"),
        "stream_rejects": (
            "SELECT CASE WHEN event_type <> 'error' THEN event_id END AS request_id, "
            "CASE WHEN event_type = 'error' THEN 'not json' ELSE 'no records' END AS reason, "
            "CASE WHEN event_type = 'error' THEN 'broken ' || event_id END AS _corrupt_record "
            "FROM events WHERE event_type = 'error' OR user_id % 3 = 0"),
        "flagged_rows": (
            f"SELECT event_id, nullif({_quarantine_reason()}, 'ok') AS reject_reason, "
            f"{_quarantine_reason()} = 'ok' AS is_valid FROM {inv}"),
        "evaluate_invalid": _metrics(
            c.DOC_MODEL, "quality", f"SELECT * FROM ({HOLED}) WHERE n_chars IS NOT NULL AND NOT coalesce(isnan(quality), FALSE)"),
        "train_job_invalid": _train_job_invalid(),
        "predictor_whole_row_invalid": _whole_row_invalid(),
        "training_extract_nan_label": _training_extract_nan_label(),
        "evaluate_many_invalid": _evaluate_many_invalid(),
        "score_models_job_invalid": _score_models_job_invalid(),
        "exact_split_sides": (
            f"WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY {h_split}, o_orderkey) AS rn "
            "FROM orders) SELECT o_orderkey, o_totalprice, "
            f"CASE WHEN rn <= (SELECT ceil(count(*) * {frac}) FROM orders) THEN 'test' ELSE 'train' END AS side FROM r"),
        "approx_split_sides": (
            f"SELECT event_id, value, CASE WHEN {sql_hash32(['event_id'], c.SPLIT_SEED)} "
            f"< {c.SPLIT_FRACTION} * 4294967296.0 THEN 'test' ELSE 'train' END AS side FROM events"),
        "csv_text_roundtrip": f"SELECT doc_id, text, {c.HOLED_NOTE} AS note, lang FROM documents",
        "path_over_table": "SELECT c_custkey, c_name, FALSE AS table_made FROM customer",
        "runlog_roundtrip": (
            "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run_id, "
            "CASE WHEN event_type = 'error' THEN 'artifact' ELSE 'metric' END AS kind, event_type AS key, "
            "CAST(event_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id, event_type "
            "ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
            "SELECT run_id, kind, key, value FROM l WHERE kind = 'artifact' OR rn = 1"),
        "runlog_compacted": (
            "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run_id, "
            "CASE WHEN event_type = 'error' THEN 'artifact' ELSE 'metric' END AS kind, event_type AS key, "
            "CAST(event_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id, event_type "
            "ORDER BY ts DESC, event_id DESC) AS rn FROM events) "
            "SELECT run_id, kind, key, value FROM l WHERE kind = 'artifact' OR rn = 1"),
        "random_sample_law": ("SELECT count(*) AS n, 0 AS strangers, 0 AS repeats, TRUE AS near_share, "
                              "count(*) AS drawn_of_all FROM orders"),
        "daily_score_replay": (
            f"SELECT event_id, user_id, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, "
            f"CASE WHEN CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) THEN {pred(c.EVENTS_MODEL_B)} "
            f"ELSE {pred(m)} END AS prediction FROM events"),
        "describe_sketch": ("SELECT column_name, statistic, CASE WHEN statistic NOT IN "
                            "('25%', '50%', '75%') THEN value END AS value, "
                            "CASE WHEN statistic IN ('25%', '50%', '75%') THEN TRUE END AS within "
                            f"FROM ({_describe()}) t"),
        "registry_conflict": "SELECT event_type AS model_name, 1 AS \"rows\", 1 AS conflicts FROM events GROUP BY 1",
        "registry_roundtrip": _score_events(),
        "score_models_job": _score_many(),
        "observed_rows": "SELECT count(*) AS rows_written, count(*) AS rows_observed FROM events",
        "predictor_score_job": (
            f"SELECT event_id, user_id, value, {c.BIG_ID} AS big_id, CASE WHEN {VALID} THEN {pred(m)} END AS prediction, "
            "(SELECT count(*) FROM events) AS rows_observed "
            f"FROM {inv}"),
    }


ORACLE = build()
