"""Expected results, computed by SQL from the raw columns (no log text is parsed here)."""

from __future__ import annotations

LOGS = """
logs AS (
  SELECT event_id, user_id, event_type, value,
    'user_' || CAST(user_id % 4 AS VARCHAR) || '.log' AS source,
    date_trunc('milliseconds', ts) AS ts,
    ' ' || event_type || '_module user=' || CAST(user_id AS VARCHAR) || ' value='
      || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)
      || CASE event_type WHEN 'error' THEN 's' WHEN 'click' THEN 'us' WHEN 'purchase' THEN 'ns'
                         WHEN 'signup' THEN 'ms' ELSE '' END AS remainder,
    CASE event_type WHEN 'error' THEN value * 1000.0::DOUBLE WHEN 'click' THEN value / 1000.0::DOUBLE
                    WHEN 'purchase' THEN value / 1000000.0::DOUBLE ELSE value END AS ms
  FROM events)
"""



def lines_of(table: str, text: str, source: str) -> str:
    """CTE ``text_lines(source, line)`` of a table's multi-line texts."""
    return f"""
pieces AS (SELECT coalesce({source}, '') AS source, string_split({text}, chr(10)) AS p FROM {table} WHERE {text} <> ''),
numbered AS (SELECT source, unnest(p) AS line, generate_subscripts(p, 1) AS i, len(p) AS k FROM pieces),
text_lines AS (
  SELECT source, CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS line
  FROM numbered WHERE NOT (i = k AND line = ''))
"""


TEXT_LINES = lines_of("documents", "text", "source")


def text_filter(condition: str) -> str:
    where = f"WHERE {condition}" if condition else ""
    return f"""WITH {TEXT_LINES}
SELECT source, line, count(*) AS n FROM text_lines {where} GROUP BY source, line"""


def hits(*branches: tuple[str, str, str], base: str = "logs") -> str:
    """CTE ``recs(spec, source, event_id, ts, value, count, delta)`` of (name, condition, value)."""
    union = " UNION ALL ".join(
        f"SELECT '{name}' AS spec, source, event_id, ts, CAST({value} AS DOUBLE) AS value"
        f" FROM {base} WHERE {condition}"
        for name, condition, value in branches
    )
    return f"""hits AS ({union}),
recs AS (
  SELECT spec, source, event_id, ts, value,
    row_number() OVER w AS count,
    CAST(epoch_ms(ts) - lag(epoch_ms(ts)) OVER w AS DOUBLE) AS delta
  FROM hits WINDOW w AS (PARTITION BY spec, source ORDER BY event_id))
"""


def records(columns: str, *branches, where: str = "", base: str = "logs", extra: str = "") -> str:
    where = f"WHERE {where}" if where else ""
    return f"WITH {LOGS}, {extra} {hits(*branches, base=base)} SELECT {columns} FROM recs {where}"


RECORD = "source, count, ts, value"
MIXED = (
    ("error_value", "event_type = 'error'", "ms"),
    ("purchase", "event_type = 'purchase'", "3.0"),
    ("click", "event_type = 'click'", "1.0"),
    ("user_1", "CAST(user_id AS VARCHAR) LIKE '1%'", "1.0"),
)
GAPS = """gaps AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE ms END AS ms) FROM logs),"""

LATER = """later AS (SELECT source, event_id, remainder, date_trunc('second', ts + INTERVAL 45 DAY) AS ts
  FROM logs)"""

AUDIT = """
audited AS (
  SELECT 'error' AS spec, source, event_id, event_type = 'error' AS guard, true AS hit,
         event_id % 7 <> 0 AS numeric_text FROM logs
  UNION ALL
  SELECT 'user_1', source, event_id, true, user_id BETWEEN 10 AND 19, true FROM logs)
"""

INPUTS = "inputs AS (SELECT * FROM (VALUES (0, 'user_0.log'), (1, 'user_1.log'), (2, 'user_2.log'), (3, 'user_3.log')) t(input_ix, source))"

ALL_INPUTS = -1

# (panel_ix, line_ix, spec, kind, pattern, title, file); file: an input index or ALL_INPUTS.
BOUND_LINES = """
lines AS (SELECT * FROM (VALUES
  (0, 0, 'error_value', 'field', 'value', 'value of error_module value', 1, 'y'),
  (0, 1, 'purchase', 'value', 'purchase_module', 'presence of purchase_module', -1, 'y'),
  (0, 2, 'click', 'count', 'click_module', 'count of click_module', 3, 'y2'),
  (1, 0, 'none', 'count', 'nothing like it', 'count of nothing like it', 0, 'y'),
  (1, 1, 'user_1', 'delta', 'user=1[0-9]* ', 'delta user=1[0-9]* ', 2, 'y'),
  (2, 0, 'error_value', 'field', 'value', 'errors', -1, 'y')
) t(p, l, spec, kind, pattern, title, file, axis))
"""
COUNTED = f"""WITH {LOGS}, {hits(*MIXED)}, {INPUTS}, {BOUND_LINES},
counted AS (SELECT spec, source, count(*) AS n FROM recs GROUP BY spec, source)
"""
# Without repeated panels: lines after the unbound one of panel 0 move by three.
BOUND = """
bound AS (
  SELECT p AS panel_ix, CASE WHEN file = -1 THEN l + input_ix WHEN p = 0 AND l = 2 THEN 5 ELSE l END AS line_ix,
         CASE WHEN spec <> 'click' THEN input_ix END AS input_ix, source, lines.*
  FROM lines JOIN inputs ON file = -1 OR file = input_ix)
"""
# With repeated panels: bound lines first, then the unbound one, once per input.
PER_FILE = """
bound AS (
  SELECT CASE p WHEN 0 THEN i.input_ix WHEN 1 THEN 4 ELSE 5 + i.input_ix END AS panel_ix,
         CASE WHEN p = 0 THEN CASE l WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END ELSE l END AS line_ix,
         CASE WHEN file = -1 THEN i.source ELSE own.source END AS source,
         CASE WHEN p = 1 THEN NULL ELSE i.source END AS panel_source,
         lines.*
  FROM lines JOIN inputs i ON p <> 1 OR i.input_ix = 0 LEFT JOIN inputs own ON own.input_ix = file)
"""
BOUND_N = "coalesce(n, 0) AS n FROM bound LEFT JOIN counted USING (spec, source)"

QUANTILES = {"median": 0.5, "q75": 0.75, "q90": 0.9, "q95": 0.95, "q99": 0.99}


def quantiles(keys: str, rows: str) -> str:
    """``rows`` selects the keys and ``v``."""
    wanted = ", ".join(f"('{name}', {p}::DOUBLE)" for name, p in QUANTILES.items())
    picked = ", ".join(f"max(q) FILTER (WHERE name = '{name}') AS {name}" for name in QUANTILES)
    return f"""
ranked AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS k,
                  count(*) OVER (PARTITION BY {keys}) AS n FROM ({rows})),
wanted AS (SELECT * FROM (VALUES {wanted}) t(name, p)),
places AS (SELECT *, (n + 1.0::DOUBLE / 3.0::DOUBLE) * p + 1.0::DOUBLE / 3.0::DOUBLE AS h
           FROM (SELECT DISTINCT {keys}, n FROM ranked), wanted),
spots AS (SELECT *, CAST(least(greatest(floor(h), 1), n) AS BIGINT) AS lo,
                 CAST(least(greatest(CASE WHEN floor(h) < 1 THEN 1 ELSE floor(h) + 1 END, 1), n) AS BIGINT) AS hi,
                 CASE WHEN floor(h) < 1 OR floor(h) >= n THEN 0.0::DOUBLE ELSE h - floor(h) END AS w FROM places),
lows AS (SELECT s.*, r.v AS low FROM spots s JOIN ranked r USING ({keys}) WHERE r.k = s.lo),
both_ends AS (SELECT s.*, r.v AS high FROM lows s JOIN ranked r USING ({keys}) WHERE r.k = s.hi),
quants AS (SELECT {keys}, name, low + w * (high - low) AS q FROM both_ends)
SELECT {keys}, {picked} FROM quants GROUP BY {keys}"""


def histogram(keys: str, rows: str, buckets: int) -> str:
    return f"""
vals AS ({rows}),
limits AS (SELECT {keys}, min(v) AS lo, max(v) AS hi FROM vals GROUP BY {keys}),
widths AS (SELECT *, ((hi - lo) + CAST(CAST(trunc(hi - lo) AS BIGINT) % {buckets} AS DOUBLE)) / {buckets}.0::DOUBLE AS width
           FROM limits),
filled AS (SELECT {keys}, CAST(least(floor((v - lo) / width), {buckets - 1}) AS INTEGER) AS bucket, count(*) AS n
           FROM vals JOIN widths USING ({keys}) GROUP BY ALL),
frame AS (SELECT widths.*, CAST(b AS INTEGER) AS bucket FROM widths, range({buckets}) t(b)),
counted AS (SELECT {keys}, bucket, lo, width, coalesce(n, 0) AS n FROM frame LEFT JOIN filled USING ({keys}, bucket)),
scaled AS (SELECT *, greatest(max(n) OVER (PARTITION BY {keys}) // 50, 1) AS per_char FROM counted)
SELECT {keys}, bucket, lo + bucket * width AS bucket_start, lo + (bucket + 1) * width AS bucket_end,
       n AS count, repeat('∎', CAST(n // per_char AS INTEGER)) AS bar FROM scaled"""


UNIT_VALUES = "SELECT source, ms AS v FROM logs"

RANGE_LINES = """
lines AS (SELECT * FROM (VALUES
  (0, 0, 'error_value', 'value', 'value of error_module value', 'full', 0), (0, 1, 'error_value', 'value', 'value of error_module value', 'full', 1),
  (0, 2, 'error_value', 'value', 'value of error_module value', 'full', 2), (0, 3, 'error_value', 'value', 'value of error_module value', 'full', 3),
  (0, 4, 'click', 'count', 'count of click_module', 'full', 0), (0, 5, 'click', 'count', 'count of click_module', 'full', 1),
  (0, 6, 'click', 'count', 'count of click_module', 'full', 2), (0, 7, 'click', 'count', 'count of click_module', 'full', 3),
  (1, 0, 'purchase', 'value', 'presence of purchase_module', 'best-fit', 1),
  (1, 1, 'user_1', 'delta', 'delta user=1[0-9]* ', 'best-fit', 2),
  (1, 2, 'none', 'count', 'count of nothing like it', 'best-fit', 0),
  (2, 0, 'user_7', 'count', 'count of user=7 ', 'best-fit', 3),
  (2, 1, 'user_11', 'count', 'count of user=11 ', 'best-fit', 3),
  (3, 0, 'nobody', 'count', 'count of nothing at all', 'full', 0)
) t(panel_ix, line_ix, spec, measure, title, range_mode, file)),
bound AS (SELECT lines.*, 'user_' || CAST(file AS VARCHAR) || '.log' AS source FROM lines)
"""
RANGE_SPECS = MIXED + (("user_7", "user_id = 7", "1.0"), ("user_11", "user_id = 11", "1.0"))
RANGES = f"""WITH {LOGS}, {hits(*RANGE_SPECS)}, {RANGE_LINES},
spans AS (SELECT spec, source, arg_min(ts, event_id) AS s, arg_max(ts, event_id) AS e, count(*) AS n
          FROM recs GROUP BY spec, source),
ranged AS (SELECT bound.*, s, e, coalesce(n, 0) AS n FROM bound LEFT JOIN spans USING (spec, source)),
sums AS (SELECT panel_ix, range_mode, min(s) AS full_s, max(e) AS full_e, max(s) AS fit_s, min(e) AS fit_e
         FROM ranged GROUP BY panel_ix, range_mode),
panels AS (SELECT panel_ix, range_mode,
             CASE WHEN range_mode = 'best-fit' AND fit_s < fit_e THEN fit_s ELSE full_s END AS s,
             CASE WHEN range_mode = 'best-fit' AND fit_s < fit_e THEN fit_e ELSE full_e END AS e FROM sums),
total AS (SELECT min(s) AS s, max(e) AS e FROM ranged)
"""
ABS_START, ABS_END = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-09 12:30:00.25'"


def _at(fraction: float) -> str:
    micros = f"CAST(round((epoch_us(e) - epoch_us(s)) * {fraction}::DOUBLE) AS BIGINT)"
    return f"s + to_microseconds({micros})"


SERIES = """SELECT panel_ix, line_ix, title || ' (user_' || CAST(file AS VARCHAR) || ')' AS title, 'y' AS axis, recs.ts AS ts,
  CASE measure WHEN 'value' THEN value WHEN 'count' THEN CAST(count AS DOUBLE) ELSE coalesce(delta, 0) END AS y
FROM bound JOIN recs USING (spec, source)"""

ORACLES = {
    "table_lines": text_filter(""),
    "scan_lines": """WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT lang, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       max(length(line)) AS longest, count(DISTINCT line) AS n_distinct FROM l GROUP BY lang""",
    "guard_filter": text_filter("contains(line, 'ung ')"),
    "regex_filter": text_filter("regexp_matches(line, '[a-z]+(tion|keit|ado)[,.] [A-Z]')"),
    "page_lines": f"""WITH {lines_of("pages", "html", "url")}
SELECT source, count(*) AS n_lines, count(*) FILTER (WHERE contains(line, '<article')) AS n_articles,
  count(*) FILTER (WHERE regexp_matches(line, '<h1>[^<]{{20,}}(?:</h1>|&[[:alpha:]]+;)')) AS n_headed
FROM text_lines GROUP BY source""",
    "conversation_lines": f"""WITH {lines_of("conversations", "text", "role")}
SELECT source, line, count(*) AS n FROM text_lines
WHERE regexp_matches(line, '(?i)(?:^| )(?P<word>the|der|que) [[:alpha:]]+[?.!]$') GROUP BY source, line""",
    "field_shorthand": records(RECORD, ("user", "true", "user_id")),
    "field_patterns": records(
        "spec, " + RECORD,
        ("named", "event_type = 'error'", "ms"),
        ("flags", "event_type = 'click' AND user_id BETWEEN 10 AND 14", "1.0"),
        ("lazy", "event_type = 'view'", "user_id"),
        ("property", "user_id < 10", "1.0"),
    ),
    "extract_ts": f"WITH {LOGS} SELECT source, event_id, ts, remainder FROM logs",
    "extract_ts_yearless": f"""WITH {LOGS}, {LATER},
checked AS (SELECT *, NOT (month(ts) = 2 AND day(ts) = 29) AS good FROM later)
SELECT source, event_id, CASE WHEN good THEN
         make_timestamp(2025, month(ts), CASE WHEN good THEN day(ts) ELSE 1 END, hour(ts), minute(ts), second(ts)::DOUBLE)
       END AS ts, CASE WHEN good THEN remainder END AS remainder FROM checked""",
    "extract_ts_epoch": f"""WITH {LOGS}
SELECT source, event_id, date_trunc('second', ts) AS ts, remainder FROM logs""",
    "extract_ts_doy": f"WITH {LOGS}, {LATER} SELECT source, event_id, ts, remainder FROM later",
    "extract_ts_time_only": records(
        RECORD + ", delta",
        ("all", "true", "ms"),
        base="clocks",
        extra="clocks AS (SELECT * REPLACE (TIMESTAMP '2025-01-01 00:00:00' + (ts - date_trunc('day', ts)) AS ts) FROM logs),",
    ),
    "bad_timestamps": f"""WITH {LOGS}, {AUDIT}
SELECT spec, source, count(*) FILTER (WHERE guard AND event_id % 97 = 0) AS bad_timestamps,
       count(*) FILTER (WHERE guard AND event_id % 97 = 0) > 3 AS aborts
FROM audited GROUP BY spec, source""",
    "extract_audit": f"""WITH {LOGS}, {AUDIT}
SELECT spec, source, count(*) AS lines, count(*) FILTER (WHERE guard) AS guard_hits,
  count(*) FILTER (WHERE guard AND event_id % 97 = 0) AS bad_timestamps,
  count(*) FILTER (WHERE guard AND event_id % 97 <> 0 AND NOT hit) AS pattern_misses,
  count(*) FILTER (WHERE guard AND event_id % 97 <> 0 AND hit) AS matches,
  count(*) FILTER (WHERE guard AND event_id % 97 <> 0 AND hit AND numeric_text) AS records
FROM audited GROUP BY spec, source""",
    "match_preview": f"""WITH {LOGS},
first AS (SELECT *, event_id % 97 <> 0 AS ok FROM logs WHERE CAST(user_id AS VARCHAR) LIKE '1%'
          ORDER BY source, event_id LIMIT 25)
SELECT source, event_id, ok AS ts_ok, CASE WHEN ok THEN ts END AS ts, CASE WHEN ok THEN remainder END AS remainder,
  ok AND event_type = 'click' AS matched,
  CASE WHEN ok AND event_type = 'click' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS value_text,
  CASE WHEN ok AND event_type = 'click' THEN 'us' END AS unit,
  CASE WHEN ok AND event_type = 'click' THEN ms END AS value FROM first""",
    "field_value": records(RECORD, ("view", "event_type = 'view'", "value")),
    "field_value_units": records(RECORD, ("all", "true", "ms")),
    "field_value_gaps": records(
        RECORD + ", delta", ("all", "true", "ms"), base="gaps", extra=GAPS, where="value IS NOT NULL"
    ),
    "event_value": records(RECORD, ("purchase", "event_type = 'purchase'", "2.5")),
    "event_count": records("source, ts, count", ("error", "event_type = 'error'", "1")),
    "event_delta": records(
        "source, ts, count, delta", ("both", "event_type IN ('click', 'view')", "1")
    ),
    "cat_field": records("source, count AS position, value", MIXED[0]),
    "cat_delta": records(
        "source, count AS position, delta AS value",
        ("purchase", "event_type = 'purchase'", "1"),
        where="delta IS NOT NULL",
    ),
    "multi_spec_scan": records("spec, " + RECORD + ", delta", *MIXED),
    "shared_records": f"""WITH {LOGS},
{hits(("click_value", "event_type = 'click'", "ms"), ("error", "event_type = 'error'", "1"))},
lines AS (SELECT * FROM (VALUES (0, 'click_value', 'field'), (4, 'click_value', 'count'), (8, 'click_value', 'delta'),
                                (12, 'error', 'delta'), (16, 'error', 'count')) t(base, spec, kind)),
{INPUTS},
totals AS (SELECT spec, source, count(*) AS n, max(count) AS last_count, sum(delta) AS sum_delta FROM recs GROUP BY ALL)
SELECT 0 AS panel_ix, base + input_ix AS line_ix, source, kind, n, last_count, sum_delta, spec
FROM lines CROSS JOIN inputs JOIN totals USING (spec, source)""",
    "match_counts": f"{COUNTED}, {BOUND} SELECT DISTINCT source, kind, pattern, {BOUND_N}",
    "bind_files": f"{COUNTED}, {BOUND} SELECT panel_ix, line_ix, input_ix, source, kind, {BOUND_N}",
    "per_file_panels": f"{COUNTED}, {PER_FILE} SELECT panel_ix, line_ix, source, kind, panel_source, {BOUND_N}",
    "line_titles": f"""{COUNTED}, {PER_FILE}
SELECT panel_ix, line_ix,
  title || ' (' || replace(source, '.log', '') || ')' || CASE axis WHEN 'y2' THEN ' | y2' ELSE '' END AS title,
  CASE p WHEN 0 THEN 'first / [' || replace(panel_source, '.log', '') || ']' WHEN 1 THEN ''
         ELSE 'last / [' || replace(panel_source, '.log', '') || ']' END AS heading, {BOUND_N}""",
    "stat_summary": f"""WITH {LOGS}
SELECT source, count(*) AS count, min(ms) AS min, max(ms) AS max, round(avg(ms), 6) AS mean FROM logs GROUP BY source""",
    "stat_quantiles": f"WITH {LOGS}, {quantiles('source', UNIT_VALUES)}",
    "stat_quantiles_delta": f"""WITH {LOGS}, {hits(('click', "event_type = 'click'", '1'))},
{quantiles('source', 'SELECT source, delta AS v FROM recs WHERE delta IS NOT NULL')}""",
    "stat_quantiles_wide": "WITH "
    + quantiles(
        "l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, l_extendedprice AS v FROM lineitem",
    ),
    "stat_histogram": f"WITH {LOGS}, {histogram('source', UNIT_VALUES, 10)}",
    "stat_histogram_wide": "WITH "
    + histogram("l_returnflag", "SELECT l_returnflag, l_extendedprice AS v FROM lineitem", 16),
    "line_ranges": f"{RANGES} SELECT panel_ix, line_ix, source, s AS range_start, e AS range_end, n FROM ranged",
    "global_range": f"{RANGES} SELECT s AS range_start, e AS range_end FROM total",
    "panel_ranges_full": f"""{RANGES}
SELECT panel_ix, s AS range_start, e AS range_end FROM panels WHERE range_mode = 'full'""",
    "panel_ranges_best_fit": f"""{RANGES}
SELECT panel_ix, s AS range_start, e AS range_end FROM panels WHERE range_mode = 'best-fit'""",
    "align_per_panel": f"{RANGES} SELECT panel_ix, s AS range_start, e AS range_end FROM panels",
    "align_shared_full": f"""{RANGES}
SELECT panel_ix, (SELECT min(s) FROM panels) AS range_start, (SELECT max(e) FROM panels) AS range_end FROM panels""",
    "align_shared_overlap": f"""{RANGES}, common AS (SELECT max(s) AS cs, min(e) AS ce FROM panels)
SELECT panel_ix, CASE WHEN cs < ce THEN cs ELSE s END AS range_start, CASE WHEN cs < ce THEN ce ELSE e END AS range_end
FROM panels, common""",
    "align_fixed_relative": f"""{RANGES}
SELECT panel_ix, w.s AS range_start, w.e AS range_end FROM panels, (SELECT {_at(0.25)} AS s, {_at(0.6)} AS e FROM total) w""",
    "align_fixed_absolute": f"""{RANGES}
SELECT panel_ix, {ABS_START} AS range_start, {ABS_END} AS range_end, (SELECT count(*) FROM bound JOIN recs
  ON recs.spec = bound.spec AND recs.source = bound.source WHERE bound.panel_ix = panels.panel_ix
  AND recs.ts >= {ABS_START} AND recs.ts < {ABS_END}) AS n_records FROM panels""",
    "lines_in_range": f"""{RANGES}
SELECT panel_ix, line_ix, source, EXISTS (SELECT 1 FROM recs WHERE recs.spec = bound.spec AND recs.source = bound.source
  AND recs.ts >= {ABS_START} AND recs.ts < {ABS_END}) AS has_data FROM bound""",
    "chart_series": f"{RANGES} {SERIES}",
    "chart_series_clipped": f"""{RANGES}, w AS (SELECT {_at(0.25)} AS ws, {_at(0.6)} AS we FROM total)
SELECT * FROM ({SERIES}) x WHERE ts >= (SELECT ws FROM w) AND ts <= (SELECT we FROM w)""",
    "records_export": records(
        "source, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S.%g') AS time, value, count,"
        " coalesce(delta, 0) AS delta",
        MIXED[0],
    ),
    "records_roundtrip": records("spec, " + RECORD + ", coalesce(delta, 0) AS delta", *MIXED),
    "refresh_records": f"""WITH {LOGS}, {hits(MIXED[0], MIXED[2])}
SELECT replace(replace(source, 'user_', ''), '.log', '') AS user, spec, count(*) AS n, round(sum(value), 6) AS total,
       1::BIGINT AS runs FROM recs GROUP BY ALL""",
}
