"""Plain SQL for each query that SQL can express, for comparison on another engine."""

from __future__ import annotations

from ..config import LOG_EPS, Z_CUT
from ..functions.normal import (
    CENTRAL_DEN, CENTRAL_NUM, FAR_DEN, FAR_NUM, LAST_WEIGHT, MIDDLE_DEN, MIDDLE_NUM, NEXT_WEIGHT,
)


def _role(key: str, seed: int = 1) -> str:
    return (
        f"CASE WHEN ('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT % 100 < 75 "
        "THEN 'train' ELSE 'test' END"
    )


def _polynomial(coefficients, x: str) -> str:
    out = repr(coefficients[-1]) + "::DOUBLE"
    for c in reversed(coefficients[:-1]):
        out = f"({out} * {x} + {c!r})"
    return out


_QUANTILE = (
    "CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * "
    f"{_polynomial(CENTRAL_NUM, '(0.180625 - (p - 0.5) * (p - 0.5))')} / "
    f"{_polynomial(CENTRAL_DEN, '(0.180625 - (p - 0.5) * (p - 0.5))')} "
    f"WHEN t <= 5 THEN sign(p - 0.5) * {_polynomial(MIDDLE_NUM, '(t - 1.6)')} / {_polynomial(MIDDLE_DEN, '(t - 1.6)')} "
    f"ELSE sign(p - 0.5) * {_polynomial(FAR_NUM, '(t - 5)')} / {_polynomial(FAR_DEN, '(t - 5)')} END"
)


def _weights(coefficients) -> str:
    return " + ".join(f"({c!r}) * pow(n::DOUBLE, -0.5 * {k + 1})" for k, c in enumerate(coefficients))


def shapes(cells: str, eps: float = LOG_EPS) -> str:
    """CTEs up to `w` (column_name, pop, n, w_raw, w_log) from a query giving (column_name, pop, v)."""
    return f"""
    cells AS ({cells}),
    based AS (
        SELECT column_name, pop, v, min(v) OVER (PARTITION BY column_name, pop) AS low FROM cells
    ),
    both_forms AS (
        SELECT column_name, pop, 'raw' AS form, v FROM based
        UNION ALL SELECT column_name, pop, 'log', ln(v - low + {eps!r}::DOUBLE) FROM based
    ),
    ranked AS (
        SELECT column_name, pop, form, v,
            row_number() OVER (PARTITION BY column_name, pop, form ORDER BY v) AS i,
            count(*) OVER (PARTITION BY column_name, pop, form) AS n,
            avg(v) OVER (PARTITION BY column_name, pop, form) AS mu
        FROM both_forms
    ),
    placed AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM ranked),
    tailed AS (SELECT *, sqrt(-ln(least(p, 1 - p))) AS t FROM placed),
    scored AS (SELECT column_name, pop, form, v, i, n, mu, {_QUANTILE} AS m FROM tailed),
    summed AS (
        SELECT column_name, pop, form, max(n) AS n, sum(m * m) AS mm, sum(m * (v - mu)) AS mx,
            sum((v - mu) * (v - mu)) AS ss,
            max(CASE WHEN i = n THEN m END) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2,
            max(CASE WHEN i = 1 THEN v END) AS v1, max(CASE WHEN i = 2 THEN v END) AS v2,
            max(CASE WHEN i = n - 1 THEN v END) AS v3, max(CASE WHEN i = n THEN v END) AS v4
        FROM scored GROUP BY column_name, pop, form
    ),
    weighed AS (
        SELECT *, m1 / sqrt(mm) + {_weights(LAST_WEIGHT)} AS a1, m2 / sqrt(mm) + {_weights(NEXT_WEIGHT)} AS a2 FROM summed
    ),
    scaled AS (
        SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS root FROM weighed
    ),
    stat AS (
        SELECT column_name, pop, form, n, pow(
            (mx - m1 * (v4 - v1) - m2 * (v3 - v2)) / root + a1 * (v4 - v1) + a2 * (v3 - v2), 2) / ss AS w
        FROM scaled
    ),
    w AS (
        SELECT column_name, pop, max(n) AS n, max(CASE WHEN form = 'raw' THEN w END) AS w_raw,
            max(CASE WHEN form = 'log' THEN w END) AS w_log
        FROM stat GROUP BY column_name, pop
    ),
    suggested AS (
        SELECT column_name, pop, CASE WHEN w_raw > w_log + 1e-9 THEN 'normal' ELSE 'log-normal' END AS shape FROM w
    ),
    pivoted AS (
        SELECT column_name, max(CASE WHEN pop = 'train' THEN shape END) AS choice_train,
            max(CASE WHEN pop = 'test' THEN shape END) AS choice_test,
            max(CASE WHEN pop = 'combined' THEN shape END) AS choice_combined
        FROM suggested GROUP BY column_name
    ),
    chosen AS (
        SELECT *, CASE WHEN choice_train = choice_test THEN choice_train ELSE choice_combined END AS choice FROM pivoted
    )"""


def three(column: str, value: str, name: str, source: str) -> str:
    """(column_name, pop, v) for train, test and combined."""
    return (
        f"SELECT '{column}' AS column_name, {name} AS pop, ({value})::DOUBLE AS v FROM {source} "
        f"UNION ALL SELECT '{column}', 'combined', ({value})::DOUBLE FROM {source}"
    )


EVENTS = f"""e AS (
        SELECT event_id, value, floor(value / 10)::DOUBLE AS bucket, {_role('event_id')} AS name FROM events
    )"""
LINES = f"l AS (SELECT *, {_role('l_orderkey')} AS name FROM lineitem)"
PARTS = f"q AS (SELECT *, {_role('p_partkey')} AS name FROM part)"
VALUE_SHAPES = shapes(three("value", "value", "name", "e"))

# Values of events after the choice, with the moments of the row's own part.
VALUE_CHOSEN = f"""{EVENTS}, {VALUE_SHAPES},
    lowest AS (SELECT name, min(value) AS low FROM e GROUP BY name),
    shifted AS (
        SELECT e.event_id, e.name, CASE WHEN choice = 'normal' THEN e.value ELSE ln(e.value - low + {LOG_EPS!r}::DOUBLE) END AS x
        FROM e JOIN lowest ON e.name = lowest.name CROSS JOIN chosen
    ),
    spread AS (SELECT name, avg(x) AS mu, stddev_samp(x) AS sd FROM shifted GROUP BY name),
    stated AS (
        SELECT event_id, shifted.name, x, (x - mu) / sd AS z,
            CASE WHEN abs((x - mu) / sd) >= {Z_CUT} THEN sign((x - mu) / sd)::DOUBLE ELSE 0.0::DOUBLE END AS state
        FROM shifted JOIN spread ON shifted.name = spread.name
    )"""

LINE_COLUMNS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
CONTINUOUS = ("l_extendedprice", "l_discount", "l_tax")


def _line_moments(c: str) -> str:
    return f"avg({c}) AS {c}_mu, stddev_samp({c}) AS {c}_sd"


def _line_state(c: str) -> str:
    z = f"(({c} - {c}_mu) / {c}_sd)"
    return f"CASE WHEN abs({z}) >= {Z_CUT} THEN sign({z})::DOUBLE ELSE 0.0::DOUBLE END"


# Every continuous column of lineitem is normal here and has outliers (see normal_or_log).
DERIVED_LINES = f"""{LINES},
    spread AS (SELECT name, {', '.join(_line_moments(c) for c in CONTINUOUS)} FROM l GROUP BY name),
    derived AS (
        SELECT l_orderkey, l.name, l_linenumber::DOUBLE AS l_linenumber_cat, l_quantity AS l_quantity_cat,
            {_line_state('l_extendedprice')} AS l_extendedprice_state,
            CASE WHEN ({_line_state('l_extendedprice')}) = 0 THEN l_extendedprice ELSE 0.0::DOUBLE END AS l_extendedprice_st_inter,
            {_line_state('l_discount')} AS l_discount_state,
            CASE WHEN ({_line_state('l_discount')}) = 0 THEN l_discount ELSE 0.0::DOUBLE END AS l_discount_st_inter,
            {_line_state('l_tax')} AS l_tax_state,
            CASE WHEN ({_line_state('l_tax')}) = 0 THEN l_tax ELSE 0.0::DOUBLE END AS l_tax_st_inter
        FROM l JOIN spread ON l.name = spread.name
    )"""


def _profiled(table: str, column: str) -> str:
    return (
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, count({column}) AS n, "
        f"count(DISTINCT {column}) AS n_distinct, NOT bool_or({column}::DOUBLE <> round({column}::DOUBLE, 1)) AS is_categorical "
        f"FROM {table}"
    )


def _whole(table: str, column: str) -> str:
    return f"SELECT '{column}' AS column_name, 'all' AS pop, {column} AS v FROM {table}"


def _rule(rule: str) -> str:
    return (
        "SELECT l_orderkey AS id, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS label, "
        f"CASE WHEN {rule} THEN 1.0 ELSE 0.0 END AS prediction FROM lineitem"
    )


_COUNTS = """count(*) AS n, count(*) FILTER (prediction = 1) AS p, count(*) FILTER (prediction = 0) AS neg,
        count(*) FILTER (prediction = 1 AND label = 1) AS tp, count(*) FILTER (prediction = 1 AND label = 0) AS fp,
        count(*) FILTER (label = 1) AS ap, count(*) FILTER (label = 0) AS an, sum(pow(label - prediction, 2)) AS sse"""


def _splits(rule: str, tag: str) -> str:
    seeds = ", ".join(f"({s})" for s in range(1, 6))
    return f"""{tag}_rule AS ({_rule(rule)}),
    {tag}_out AS (
        SELECT seed, r.* FROM {tag}_rule r CROSS JOIN (VALUES {seeds}) AS s(seed)
        WHERE ('0x' || substr(md5(seed::VARCHAR || ':' || id::VARCHAR), 1, 8))::BIGINT % 100 >= 75
    ),
    {tag}_split AS (SELECT seed, {_COUNTS} FROM {tag}_out GROUP BY seed),
    {tag}_summary AS (
        SELECT avg((tp::DOUBLE / nullif(p, 0)) / nullif(fp::DOUBLE / nullif(neg, 0), 0)) AS mroc,
            stddev_samp((tp::DOUBLE / nullif(p, 0)) / nullif(fp::DOUBLE / nullif(neg, 0), 0)) AS sdroc,
            avg(sse / n) AS mmse, stddev_samp(sse / n) AS sdmse, count(*) AS splits
        FROM {tag}_split
    )"""


def _three_counts(binned: str, extra: str = "") -> str:
    return f"""SELECT name, bin, count(*) AS count FROM ({binned}) GROUP BY name, bin
        UNION ALL SELECT 'combined', bin, count(*) FROM ({binned}) GROUP BY bin"""


def _index(table: str, column: str) -> str:
    return (
        f"SELECT '{column}' AS column_name, {column}::VARCHAR AS value, "
        f"row_number() OVER (ORDER BY count(*) DESC, {column}::VARCHAR) - 1 AS position, count(*) AS n "
        f"FROM {table} GROUP BY {column}"
    )


_VECTORS = """SELECT name, l_orderkey AS id,
        CASE WHEN name = 'train' THEN CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS label,"""

_BUCKETS = """i AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS position, n
        FROM (SELECT bucket::VARCHAR AS value, count(*) AS n FROM e {} GROUP BY bucket))"""


def _validated() -> str:
    """Rows and labels of the five hold-outs."""
    large = "l_extendedprice * (1 - l_discount) > 50000"
    return " UNION ALL ".join(
        f"SELECT {seed} AS seed, count(*) AS n, count(*) FILTER ({large}) AS actual_pos, count(*) FILTER (NOT ({large})) AS actual_neg, "
        f"TRUE AS complete, TRUE AS better FROM lineitem WHERE {_role('l_orderkey', seed)} = 'test'"
        for seed in range(1, 6)
    )


def _log_shifts() -> str:
    """The best of five shifts by W in train, the first of several; every shift has its own ranks here."""
    cells = three("doubled", "pow(2.0, l_linenumber) + 0.25", "name", "l") + " UNION ALL " + three("l_extendedprice", "l_extendedprice", "name", "l")
    tried = " UNION ALL ".join(
        f"(WITH {LINES}, {shapes(cells, eps)} SELECT {k} AS k, {eps!r}::DOUBLE AS log_eps, w.column_name, w_raw, w_log, choice "
        "FROM w JOIN chosen ON chosen.column_name = w.column_name WHERE pop = 'train')"
        for k, eps in enumerate((LOG_EPS, 0.01, 0.5, 1.0, 20.0))
    )
    return f"""SELECT column_name, log_eps, round(w_raw, 5) AS w_raw, round(w_log, 5) AS w_log, choice FROM ({tried})
        QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY w_log DESC, k) = 1"""


def _derived_branches() -> str:
    """Kinds and values of every column decided here from the rows, with a log shift of 1 and rare values up to a ratio of 0.35."""
    columns = {
        "over": "greatest(l_quantity - 46, 0)", "step": "floor(pow(l_extendedprice / 10000, 2) / 4)", "quantity": "l_quantity",
        "place": "l_linenumber + 0.25", "doubled": "pow(2.0, l_linenumber) + 0.25", "price": "l_extendedprice",
        "mixed": "CASE WHEN name = 'train' THEN l_linenumber + 0.25 ELSE pow(2.0, l_linenumber) + 0.25 END",
    }
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, name, ({v})::DOUBLE AS v FROM l" for c, v in columns.items())
    cells = """SELECT column_name, name AS pop, v FROM long JOIN tested USING (column_name) WHERE NOT is_category
        UNION ALL SELECT column_name, 'combined', v FROM long JOIN tested USING (column_name) WHERE NOT is_category"""
    return f"""WITH {LINES}, long AS MATERIALIZED ({long}),
    tested AS (SELECT column_name, NOT bool_or(v <> round(v, 1)) AS is_category FROM long WHERE name = 'train' GROUP BY column_name),
    {shapes(cells, 1.0)},
    lowest AS (SELECT column_name, name, min(v) AS low FROM long GROUP BY column_name, name),
    moved AS (
        SELECT column_name, name, choice_train, choice_test, choice, CASE WHEN choice = 'normal' THEN v ELSE ln(v - low + 1.0::DOUBLE) END AS x
        FROM long JOIN chosen USING (column_name) JOIN lowest USING (column_name, name)
    ),
    spread AS (SELECT column_name, name, avg(x) AS mu, stddev_samp(x) AS sd, min(x) AS low, max(x) AS high FROM moved GROUP BY column_name, name),
    counted AS (SELECT column_name, v, count(*) AS n FROM long JOIN tested USING (column_name) WHERE is_category AND name = 'train' GROUP BY column_name, v),
    rated AS (SELECT *, round(n::DOUBLE / max(n) OVER (PARTITION BY column_name), 4) <= 0.35 AS is_rare FROM counted),
    balanced AS (
        SELECT column_name, count(*) FILTER (v <= 0)::DOUBLE / nullif(count(*) FILTER (v <> 0), 0) AS ratio FROM long WHERE name = 'train' GROUP BY column_name
    ),
    categories AS (
        SELECT column_name, CASE WHEN any_value(ratio) > 10 THEN 'binarized' WHEN bool_or(is_rare) THEN 'trunc_cat' ELSE 'cat' END AS kind,
            avg(rated.v) FILTER (is_rare) AS replacement
        FROM rated JOIN balanced USING (column_name) GROUP BY column_name
    ),
    curves AS (
        SELECT column_name, CASE WHEN greatest(high - mu, mu - low) / sd > {Z_CUT} THEN 'state' WHEN choice = 'normal' THEN 'N' ELSE 'LN' END AS kind,
            choice_train, choice_test, choice
        FROM spread JOIN chosen USING (column_name) WHERE name = 'train'
    ),
    stated AS (
        SELECT m.column_name, m.name, x, CASE WHEN abs((x - mu) / sd) >= {Z_CUT} THEN sign((x - mu) / sd)::DOUBLE ELSE 0.0::DOUBLE END AS state
        FROM moved m JOIN spread s ON s.column_name = m.column_name AND s.name = m.name
    ),
    derived AS (
        SELECT column_name, kind, NULL::VARCHAR AS choice_train, NULL::VARCHAR AS choice_test, NULL::VARCHAR AS choice, kind AS suffix, name,
            CASE WHEN kind = 'binarized' THEN CASE WHEN long.v > 0 THEN 1.0::DOUBLE ELSE long.v END WHEN is_rare THEN replacement ELSE long.v END AS value
        FROM long JOIN categories USING (column_name) LEFT JOIN rated USING (column_name, v)
        UNION ALL
        SELECT column_name, kind, choice_train, choice_test, choice, CASE WHEN kind = 'state' THEN 'state' ELSE kind END, name,
            CASE WHEN kind = 'state' THEN state ELSE x END
        FROM stated JOIN curves USING (column_name)
        UNION ALL
        SELECT column_name, kind, choice_train, choice_test, choice, 'st_inter', name, CASE WHEN state = 0 THEN x ELSE 0.0::DOUBLE END
        FROM stated JOIN curves USING (column_name) WHERE kind = 'state'
    )
    SELECT column_name, kind, choice_train, choice_test, choice, column_name || '_' || suffix AS derived_name, name, count(value) AS n,
        round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high
    FROM derived GROUP BY ALL"""


_KERNEL_DENSITY = f"""WITH {EVENTS}, a AS (SELECT name, value FROM e UNION ALL SELECT 'combined', value FROM e),
        s AS (SELECT name, count(*) AS n, 1.06::DOUBLE * stddev_samp(value) * pow(count(*)::DOUBLE, -0.2) AS width, min(value) AS low, max(value) AS high FROM a GROUP BY name),
        g AS (SELECT name, n, width, low - 3 * width AS start, (high + 3 * width - (low - 3 * width)) / 127 AS step FROM s),
        p AS (SELECT name, (value - start) / step AS place, least(floor((value - start) / step), 126)::INT AS cell FROM a JOIN g USING (name)),
        c AS (SELECT name, cell, sum(weight) AS weight FROM (
            SELECT name, cell, 1 - (place - cell) AS weight FROM p UNION ALL SELECT name, cell + 1, place - cell FROM p) GROUP BY name, cell),
        t AS (SELECT name, point, sum(weight * exp(-0.5 * pow((point - cell) * step / width, 2))) AS total
            FROM c JOIN g USING (name) CROSS JOIN (SELECT unnest(range(128))::INT AS point) GROUP BY name, point)
        SELECT name, point, round(start + point * step, 6) AS x, round(total / (n * width * sqrt(2 * pi())), 8) AS density FROM t JOIN g USING (name)"""

_SMOOTH_RATE = """WITH r AS (SELECT min(l_extendedprice) AS low, max(l_extendedprice) - min(l_extendedprice) AS reach FROM lineitem),
        u AS (SELECT (l_extendedprice - low) / reach AS u, CASE WHEN l_quantity * l_discount > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM lineitem, r),
        c AS (SELECT least(floor(u * 64), 63)::INT AS cell, sum(1.0::DOUBLE) AS s0, sum(u) AS s1, sum(u ** 2) AS s2, sum(u ** 3) AS s3, sum(u ** 4) AS s4,
            sum(y) AS t0, sum(y * u) AS t1, sum(y * u ** 2) AS t2 FROM u GROUP BY 1),
        d AS (SELECT *, (point + 0.5) / 32 AS g, abs((cell + 0.5) / 64 - (point + 0.5) / 32) / 0.5 AS away
            FROM c CROSS JOIN (SELECT unnest(range(32))::INT AS point)),
        w AS (SELECT *, pow(1 - pow(away, 3), 3)::DOUBLE AS w FROM d WHERE away < 1),
        m AS (SELECT point, max(g)::DOUBLE AS g, sum(w * s0) AS s0, sum(w * s1) AS s1, sum(w * s2) AS s2, sum(w * s3) AS s3, sum(w * s4) AS s4,
            sum(w * t0) AS t0, sum(w * t1) AS t1, sum(w * t2) AS t2 FROM w GROUP BY point),
        k AS (SELECT point, g, s0 AS m0, s1 - g * s0 AS m1, s2 - 2 * g * s1 + g * g * s0 AS m2, s3 - 3 * g * s2 + 3 * g * g * s1 - g * g * g * s0 AS m3,
            s4 - 4 * g * s3 + 6 * g * g * s2 - 4 * g * g * g * s1 + g * g * g * g * s0 AS m4,
            t0 AS v0, t1 - g * t0 AS v1, t2 - 2 * g * t1 + g * g * t0 AS v2 FROM m)
        SELECT point, round(low + g * reach, 8) AS x, round(
            (v0 * (m2 * m4 - m3 * m3) - m1 * (v1 * m4 - m3 * v2) + m2 * (v1 * m3 - m2 * v2))
            / (m0 * (m2 * m4 - m3 * m3) - m1 * (m1 * m4 - m3 * m2) + m2 * (m1 * m3 - m2 * m2)), 6) AS rate FROM k, r"""

ORACLE: dict[str, str] = {
    "kernel_density": _KERNEL_DENSITY,
    "smooth_rate": _SMOOTH_RATE,
    "derive_branches": _derived_branches(),
    "log_shift": _log_shifts(),
    "row_number_text": """SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS name, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR)) - 1 AS row_num
        FROM orders""",
    "score_later": f"""WITH e AS (SELECT event_id, hour(ts)::DOUBLE AS hour, {_role('event_id')} AS name FROM events),
        i AS (SELECT hour::VARCHAR AS value, row_number() OVER (ORDER BY count(*) DESC, hour::VARCHAR) - 1 AS position FROM e WHERE name = 'train' GROUP BY hour),
        k AS (SELECT count(*) AS k FROM i)
        SELECT event_id + 1000000 AS id, k + 1 AS width, CASE WHEN event_id % 10 <> 0 AND position < k - 1 THEN position ELSE -1 END AS slot, TRUE AS valid
        FROM e CROSS JOIN k LEFT JOIN i ON i.value = hour::VARCHAR WHERE name = 'test'""",
    "lr_cv": _validated(),
    "svm": _validated(),
    "gbt": _validated(),
    "score_unlabelled": """SELECT 'lr' AS model_name, doc_id AS id, TRUE AS valid FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "workflow_run": f"""WITH {EVENTS}
        SELECT 'gbt_0.75_10.0_False_True_True_10.0_0.01_5.0_0.1' AS model_name, event_id AS id, TRUE AS valid, TRUE AS accepted
        FROM e WHERE name = 'test'""",
    "category_index_keep": """WITH p AS (SELECT CASE WHEN p_size <> 7 THEN p_size::VARCHAR END AS value, p_size <= 40 AS known FROM part),
        i AS (SELECT value, row_number() OVER (ORDER BY count(*) DESC, value) - 1 AS position FROM p
            WHERE known AND value IS NOT NULL GROUP BY value),
        found AS (SELECT p.value, coalesce(position, (SELECT count(*) FROM i)) AS position, count(*) AS n
            FROM p LEFT JOIN i ON p.value = i.value GROUP BY ALL)
        SELECT path, value, position, n FROM found CROSS JOIN (VALUES ('model'), ('table')) AS t(path)""",
    "assemble_encoded": f"""WITH {EVENTS}, {_BUCKETS.format('')},
        placed AS (SELECT event_id, value AS v, bucket, (SELECT position FROM i WHERE i.value = bucket::VARCHAR) AS position,
            (SELECT n FROM i WHERE i.value = bucket::VARCHAR) AS n FROM e),
        s AS (SELECT stddev_samp(v) AS sv, stddev_samp(bucket) AS sb, stddev_samp(position) AS sp, count(*) AS total,
            (SELECT count(*) FROM i) AS k FROM placed)
        SELECT event_id AS id, k - 1 + 3 AS width, round(v / sv, 6) AS value, round(bucket / sb, 6) AS bucket, round(position / sp, 6) AS place,
            CASE WHEN position < k - 1 THEN position ELSE -1 END AS slot,
            CASE WHEN position < k - 1 THEN round(1 / sqrt((n - n::DOUBLE * n / total) / (total - 1)), 6) ELSE 0.0::DOUBLE END AS top
        FROM placed CROSS JOIN s""",
    "assemble_encoded_train": f"""WITH {EVENTS}, {_BUCKETS.format("WHERE name = 'train'")}, s AS (SELECT count(*) AS k FROM i)
        SELECT event_id AS id, k AS width, CASE WHEN position < k - 1 THEN position ELSE -1 END AS slot
        FROM e CROSS JOIN s LEFT JOIN i ON i.value = bucket::VARCHAR""",
    "row_number_csv": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_num FROM orders",
    "split_null_keys": """WITH k AS (SELECT ('0x' || substr(md5('1:' || o_orderkey::VARCHAR), 1, 8))::BIGINT AS h FROM orders WHERE o_orderkey % 7 <> 0),
        t AS (SELECT count(*) AS total, (SELECT count(*) FROM k WHERE h % 100 < 75) AS a,
            (SELECT count(*) FROM k WHERE h % 100 < 33 OR (h % 100 = 33 AND h // 100 < 0.33 * 4294967296 / 100)) AS b FROM orders)
        SELECT 'named' AS way, 'train' AS name, a AS n FROM t UNION ALL SELECT 'named', 'test', total - a FROM t
        UNION ALL SELECT 'keyed 0.75', 'train', a FROM t UNION ALL SELECT 'keyed 0.75', 'test', total - a FROM t
        UNION ALL SELECT 'keyed 0.3333', 'train', b FROM t UNION ALL SELECT 'keyed 0.3333', 'test', total - b FROM t""",
    "bernoulli_checked": "SELECT 0 AS strangers, 0 AS repeats, TRUE AS plausible, 0 AS changed, count(*) AS n FROM orders",
    "constant_side": f"""WITH {EVENTS}, s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM e WHERE name = 'train'),
        z AS (SELECT event_id, name, CASE WHEN name = 'train' THEN value ELSE 5.25::DOUBLE END AS v,
            CASE WHEN name = 'train' AND abs((value - mu) / sd) >= {Z_CUT} THEN sign((value - mu) / sd)::DOUBLE ELSE 0.0::DOUBLE END AS state
            FROM e CROSS JOIN s)
        SELECT event_id, name, state, round(CASE WHEN state = 0 THEN v ELSE 0.0::DOUBLE END, 6) AS interaction, TRUE AS reported FROM z""",
    "derive_stored_profile": f"""WITH {EVENTS}, c AS (SELECT bucket, count(*) AS n FROM e WHERE name = 'train' GROUP BY bucket),
        rare AS (SELECT bucket FROM c WHERE round(n::DOUBLE / (SELECT max(n) FROM c), 4) <= 0.01)
        SELECT event_id, bucket, round(CASE WHEN bucket IN (SELECT bucket FROM rare)
            THEN (SELECT avg(bucket) FROM rare) ELSE bucket END, 6) AS bucket_trunc_cat FROM e""",
    "categorical_profile": " UNION ALL ".join(
        [_profiled("lineitem", c) for c in LINE_COLUMNS]
        + [_profiled("part", "p_size"), _profiled("part", "p_retailprice"), _profiled("orders", "o_totalprice")]
    ),
    "balance_ratio": """
        SELECT 'toxic' AS column_name, round(count(*) FILTER (toxic <= 0)::DOUBLE / nullif(count(*) FILTER (toxic <> 0), 0), 6) AS ratio FROM labels
        UNION ALL
        SELECT 'over_46', round(count(*) FILTER (v <= 0)::DOUBLE / nullif(count(*) FILTER (v <> 0), 0), 6)
        FROM (SELECT greatest(l_quantity - 46, 0) AS v FROM lineitem)""",
    "category_ratio": f"""WITH {EVENTS}, c AS (SELECT bucket AS value, count(*) AS n FROM e GROUP BY bucket)
        SELECT value, n, round(n::DOUBLE / (SELECT max(n) FROM c), 4) AS ratio FROM c""",
    "truncate_rare": f"""WITH {EVENTS}, c AS (SELECT bucket, count(*) AS n FROM e GROUP BY bucket),
        rare AS (SELECT bucket FROM c WHERE round(n::DOUBLE / (SELECT max(n) FROM c), 4) <= 0.01)
        SELECT event_id, bucket, round(CASE WHEN bucket IN (SELECT bucket FROM rare)
            THEN (SELECT avg(bucket) FROM rare) ELSE bucket END, 6) AS bucket_trunc_cat FROM e""",
    "binarize": """SELECT raw, CASE WHEN raw > 0 THEN 1.0::DOUBLE ELSE raw END AS binarized, count(*) AS n
        FROM (SELECT greatest(l_quantity - 46, 0)::DOUBLE AS raw FROM lineitem) GROUP BY raw""",
    "category_passthrough": f"""WITH {PARTS}
        SELECT p_partkey, name, 'p_size_cat' AS derived_name, p_size::DOUBLE AS value FROM q""",
    "category_mismatch": f"""WITH {EVENTS}
        SELECT DISTINCT 'bucket' AS column_name, bucket AS value FROM e
        WHERE name = 'test' AND bucket NOT IN (SELECT bucket FROM e WHERE name = 'train')""",
    "mismatch_report": f"""WITH {EVENTS}, {VALUE_SHAPES}
        SELECT 'bucket' AS column_name, 'category' AS kind, 'test only: ' || count(DISTINCT bucket) AS detail
        FROM e WHERE name = 'test' AND bucket NOT IN (SELECT bucket FROM e WHERE name = 'train') HAVING count(*) > 0
        UNION ALL
        SELECT column_name, 'transform', 'train: ' || choice_train || ', test: ' || choice_test
        FROM chosen WHERE choice_train <> choice_test""",
    "moments_zscore": f"""WITH {EVENTS}, a AS (SELECT name, value FROM e UNION ALL SELECT 'combined', value FROM e)
        SELECT name, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd,
            round(greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value), 6) AS max_abs_z
        FROM a GROUP BY name""",
    "zscores": f"""WITH {EVENTS}, s AS (SELECT name, avg(value) AS mu, stddev_samp(value) AS sd FROM e GROUP BY name)
        SELECT event_id, e.name, round((value - mu) / sd, 6) AS z FROM e JOIN s ON e.name = s.name""",
    "shift_log": f"""WITH {EVENTS}, s AS (SELECT name, min(value) AS low FROM e GROUP BY name)
        SELECT event_id, e.name, round(ln(value - low + {LOG_EPS!r}::DOUBLE), 6) AS value_log FROM e JOIN s ON e.name = s.name""",
    "shapiro_w": "WITH "
    + shapes(
        " UNION ALL ".join(
            [_whole("lineitem", c) for c in CONTINUOUS] + [_whole("customer", "c_acctbal"), _whole("events", "value")]
        )
    )
    + " SELECT column_name, n, round(w_raw, 5) AS w_raw, round(w_log, 5) AS w_log FROM w",
    "normal_or_log": f"WITH {LINES}, {EVENTS}, "
    + shapes(
        " UNION ALL ".join(
            [three(c, c, "name", "l") for c in ("l_extendedprice", "l_tax")] + [three("value", "value", "name", "e")]
        )
    )
    + " SELECT column_name, choice_train, choice_test, choice_combined, choice FROM chosen",
    "transformed_column": f"WITH {LINES}, "
    + shapes(
        three("flat", "l_linenumber + 0.25", "name", "l")
        + " UNION ALL "
        + three("steep", "pow(2.0, l_linenumber) + 0.25", "name", "l"),
        1.0,
    )
    + """, forms AS (
            SELECT name, 'flat' AS column_name, l_linenumber + 0.25::DOUBLE AS v FROM l
            UNION ALL SELECT name, 'steep', pow(2.0, l_linenumber) + 0.25::DOUBLE FROM l
        ),
        lowest AS (SELECT name, column_name, min(v) AS low FROM forms GROUP BY name, column_name)
        SELECT f.name, f.column_name || CASE WHEN choice = 'normal' THEN '_N' ELSE '_LN' END AS derived_name,
            round(CASE WHEN choice = 'normal' THEN v ELSE ln(v - low + 1.0) END, 6) AS value, count(*) AS n
        FROM forms f JOIN lowest g ON f.name = g.name AND f.column_name = g.column_name
            JOIN chosen c ON c.column_name = f.column_name
        GROUP BY 1, 2, 3""",
    "state": f"WITH {VALUE_CHOSEN} SELECT event_id, name, state AS value_state FROM stated",
    "state_interaction": f"""WITH {VALUE_CHOSEN}
        SELECT event_id, name, CASE WHEN state = 0 THEN x ELSE 0.0::DOUBLE END AS value_st_inter FROM stated""",
    "derive_all": f"WITH {DERIVED_LINES} SELECT * FROM derived",
    "derived_view": f"""WITH {DERIVED_LINES}
        SELECT name, l_tax_state, count(*) AS n, round(sum(l_discount_st_inter), 4) AS discount FROM derived GROUP BY name, l_tax_state""",
    "histogram": f"""WITH {PARTS},
        r AS (SELECT min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high, count(DISTINCT p_size) AS k FROM q),
        b AS (SELECT name, least(floor((p_size - low) / ((high - low) / k)), k - 1)::INTEGER AS bin FROM q CROSS JOIN r),
        c AS ({_three_counts('SELECT * FROM b')})
        SELECT name, bin, round(low + bin * ((high - low) / k), 6) AS bin_low, count FROM c CROSS JOIN r""",
    "density": f"""WITH {EVENTS}, r AS (SELECT min(value) AS low, max(value) AS high FROM e),
        b AS (SELECT name, least(floor((value - low) / ((high - low) / 64)), 63)::INTEGER AS bin FROM e CROSS JOIN r),
        c AS ({_three_counts('SELECT * FROM b')}),
        t AS (SELECT name, sum(count) AS total FROM c GROUP BY name)
        SELECT c.name, bin, round(low + bin * ((high - low) / 64), 6) AS bin_low,
            round(count / (total * ((high - low) / 64)), 8) AS density
        FROM c JOIN t ON c.name = t.name CROSS JOIN r""",
    "class_rate": """WITH r AS (SELECT min(l_discount) AS low, max(l_discount) AS high FROM lineitem),
        b AS (SELECT least(floor((l_discount - low) / ((high - low) / 20)), 19)::INTEGER AS bin,
            CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem CROSS JOIN r)
        SELECT bin, round(max(low) + bin * ((max(high) - max(low)) / 20), 6) AS bin_low, count(*) AS count,
            round(avg(y), 8) AS rate FROM b CROSS JOIN r GROUP BY bin""",
    "row_number_dense": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS row_num FROM orders",
    "row_number_files": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_num FROM orders",
    "attach_columns": "SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "attach_labels": "SELECT l.doc_id AS id, quality AS label, n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "split_holdout": f"SELECT o_orderkey, {_role('o_orderkey')} AS name FROM orders",
    "holdout_anti_join": f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (
        SELECT o_orderkey FROM orders WHERE {_role('o_orderkey')} = 'train')""",
    "union_sources": """SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance FROM customer
        UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
    "category_index": f"{_index('orders', 'o_orderpriority')} UNION ALL {_index('part', 'p_size')}",
    "category_index_large": f"SELECT value, position FROM ({_index('part', 'p_name')})",
    "one_hot": f"""WITH i AS ({_index('part', 'p_size')})
        SELECT p_partkey, CASE WHEN position < (SELECT count(*) - 1 FROM i) THEN position ELSE -1 END AS slot,
            (SELECT count(*) - 1 FROM i) AS width,
            CASE WHEN position < (SELECT count(*) - 1 FROM i) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS total
        FROM part JOIN i ON p_size::VARCHAR = value""",
    "assemble": f"""WITH {LINES} {_VECTORS}
        round(l_quantity, 6) AS f0, round(l_extendedprice, 6) AS f1, round(l_discount, 6) AS f2, round(l_tax, 6) AS f3 FROM l""",
    "standard_scale": f"""WITH {LINES}, s AS (SELECT stddev_samp(l_quantity) AS s0, stddev_samp(l_extendedprice) AS s1,
            stddev_samp(l_discount) AS s2, stddev_samp(l_tax) AS s3 FROM l WHERE name = 'train')
        {_VECTORS} round(l_quantity / s0, 6) AS f0, round(l_extendedprice / s1, 6) AS f1, round(l_discount / s2, 6) AS f2,
        round(l_tax / s3, 6) AS f3 FROM l CROSS JOIN s""",
    "confusion_metrics": f"""WITH c AS (SELECT {_COUNTS} FROM ({_rule('l_discount > 0.05')}))
        SELECT n, p, neg, tp, fp, round(tp::DOUBLE / p, 8) AS tpr, round(fp::DOUBLE / neg, 8) AS fpr,
            round((tp::DOUBLE / p) / (fp::DOUBLE / neg), 8) AS roc, round(tp::DOUBLE / p, 8) AS precision,
            round(tp::DOUBLE / ap, 8) AS recall, round(fp::DOUBLE / an, 8) AS fall_out FROM c""",
    "sse": f"""SELECT round(sum(pow(label - prediction, 2)), 4) AS sse, round(avg(pow(label - prediction, 2)), 8) AS mse
        FROM ({_rule('l_discount > 0.05')})""",
    "split_summary": f"""WITH {_splits('l_discount > 0.05', 'a')}
        SELECT round(mroc, 6) AS mroc, round(sdroc, 6) AS sdroc, round(mmse, 6) AS mmse, round(sdmse, 6) AS sdmse, splits
        FROM a_summary""",
    "auc": """WITH s AS (SELECT l_extendedprice AS score, count(*) FILTER (l_returnflag = 'R') AS pos,
            count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY l_extendedprice),
        o AS (SELECT *, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) AS upto FROM s)
        SELECT round(sum(pos * (upto - neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 8) AS auc,
            sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM o""",
    "champion_gate": f"""WITH {_splits('l_tax > 0.04', 'b')}, {_splits('l_discount > 0.05', 'a')}
        SELECT 'discount' AS name, round(a.mroc, 6) AS mroc, round(a.sdroc, 6) AS sdroc, round(b.mroc, 6) AS best_mroc,
            round(b.mroc, 2) <= round(a.mroc, 2) AS accepted FROM a_summary a CROSS JOIN b_summary b""",
    "csv_roundtrip": "SELECT * FROM customer",
    "read_roles": "SELECT 'train' AS name, doc_id FROM labels UNION ALL SELECT 'test', doc_id FROM documents",
    "sample_head": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20",
}
