"""Registered trace queries (T1-T3, T15-T18) on X1 step records from `events`."""

from __future__ import annotations

from snipflow.functions.text import sql_py_strip
from snipflow.operators import trace
from snipflow.sources import fixtures as fx

CAP = fx.X1_CAP
LIMIT = fx.X1_TIME_LIMIT_S


def trace_call_depth(spark, sf_dir):
    t = trace.traced_steps(fx.x1_steps(spark, sf_dir), CAP)
    return t.select("run_id", "seq", "step_no", "event", "line_number", "call_depth")


def trace_run_status(spark, sf_dir):
    return trace.run_status(fx.x1_runs(spark, sf_dir), fx.x1_steps(spark, sf_dir), CAP, LIMIT)


def trace_run_summary(spark, sf_dir):
    return trace.run_summary(fx.x1_runs(spark, sf_dir), fx.x1_steps(spark, sf_dir), CAP, LIMIT)


def trace_run_outcomes(spark, sf_dir):
    """T15 with all nine outcomes, T1 with module frames."""
    out = trace.run_status(fx.x1b_runs(spark, sf_dir), fx.x1b_steps(spark, sf_dir), fx.X1B_CAP, fx.X1B_TIME_LIMIT_S)
    return out.drop("duration_s")


def trace_hot_lines(spark, sf_dir):
    return trace.hot_lines(fx.x1_steps(spark, sf_dir), CAP)


# Oracle: the depth is stepped one event at a time by a recursive CTE (the
# reference's loop), not by the reflected running sum used on the Spark side.
def _walk_sql() -> str:
    return f"""
WITH RECURSIVE st AS ({fx.x1_steps_sql()}),
u AS (SELECT * FROM st WHERE event IN ('call', 'line', 'return')
        AND NOT (func_name = '<module>' AND event IN ('call', 'return'))),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS step_no FROM u),
kc AS (SELECT * FROM k WHERE step_no <= {CAP + 1}),
walk(run_id, step_no, after, shown) AS (
  SELECT run_id, step_no,
         CASE WHEN event = 'call' THEN 1 ELSE 0 END,
         CASE WHEN event = 'call' THEN 1 ELSE 0 END
  FROM kc WHERE step_no = 1
  UNION ALL
  SELECT kc.run_id, kc.step_no,
         CASE WHEN kc.event = 'call' THEN w.after + 1
              WHEN kc.event = 'return' THEN greatest(0, w.after - 1) ELSE w.after END,
         CASE WHEN kc.event = 'call' THEN w.after + 1 ELSE w.after END
  FROM walk w JOIN kc ON kc.run_id = w.run_id AND kc.step_no = w.step_no + 1
),
steps AS (SELECT kc.*, CAST(walk.shown AS INT) AS call_depth
          FROM kc JOIN walk USING (run_id, step_no))"""


def _status_sql() -> str:
    return _walk_sql() + f""",
span AS (SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s,
                arg_max(event, seq) FILTER (WHERE event <> 'return') AS last_event,
                arg_max(line_number, seq) FILTER (WHERE event <> 'return') AS last_line
         FROM st GROUP BY run_id),
agg AS (SELECT run_id, count(*) FILTER (WHERE step_no <= {CAP}) AS n_steps,
               max(step_no) > {CAP} AS truncated,
               max(call_depth) FILTER (WHERE step_no <= {CAP}) AS max_depth,
               coalesce(string_agg(output, '' ORDER BY step_no)
                        FILTER (WHERE step_no <= {CAP} AND output IS NOT NULL), '') AS out
        FROM steps GROUP BY run_id),
runs AS (SELECT DISTINCT user_id AS run_id FROM events),
j AS (SELECT runs.run_id, span.*, agg.n_steps, agg.truncated, agg.max_depth, agg.out,
        CASE WHEN span.duration_s > {LIMIT} THEN 'timed_out'
             WHEN agg.truncated THEN 'truncated'
             WHEN span.last_event = 'exception' THEN 'runtime_error'
             ELSE 'ok' END AS status
      FROM runs LEFT JOIN span USING (run_id) LEFT JOIN agg USING (run_id)),
status AS (
  SELECT run_id, status,
    CASE status WHEN 'timed_out' THEN 'Execution timed out - possible infinite loop'
                WHEN 'truncated' THEN 'Trace truncated at {CAP} steps (execution may be long-running).'
                WHEN 'runtime_error' THEN 'Exception raised at line ' || CAST(last_line AS VARCHAR)
                END AS error,
    CAST(CASE WHEN status = 'timed_out' THEN 0 ELSE coalesce(n_steps, 0) END AS BIGINT) AS step_count,
    CAST(CASE WHEN status = 'timed_out' THEN 0 ELSE coalesce(max_depth, 0) END AS INT) AS max_depth,
    CASE WHEN status = 'timed_out' THEN '' ELSE {sql_py_strip('out')} END AS final_output,
    round(duration_s, 6) AS duration_s
  FROM j)"""


def _outcomes_sql() -> str:
    steps = fx.x1_steps_sql().replace("'main' AS func_name", f"{fx.X1B_FUNC} AS func_name")
    runs = ", ".join(f"{sql} AS {name}" for name, sql in fx.X1B_RUNS.items())
    walk = _walk_sql().replace(fx.x1_steps_sql(), steps).replace(f"step_no <= {CAP + 1}", f"step_no <= {fx.X1B_CAP + 1}")
    cap = fx.X1B_CAP
    return walk + f""",
span AS (SELECT run_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s FROM st GROUP BY run_id),
agg AS (SELECT run_id, count(*) FILTER (WHERE step_no <= {cap}) AS n_steps, max(step_no) > {cap} AS truncated,
               max(call_depth) FILTER (WHERE step_no <= {cap}) AS max_depth,
               coalesce(string_agg(output, '' ORDER BY step_no) FILTER (WHERE step_no <= {cap} AND output IS NOT NULL), '') AS out
        FROM steps GROUP BY run_id),
runs AS (SELECT DISTINCT user_id AS run_id, {runs} FROM events),
j AS (SELECT *, CASE WHEN trim(code, ' ' || chr(10)) = '' THEN 1 WHEN duration_s > {fx.X1B_TIME_LIMIT_S} THEN 2 WHEN no_result THEN 3
        WHEN syntax_error IS NOT NULL THEN 4 WHEN policy_error IS NOT NULL THEN 5 WHEN prepare_error IS NOT NULL THEN 6
        WHEN truncated THEN 7 WHEN error IS NOT NULL THEN 8 ELSE 9 END AS k
      FROM runs LEFT JOIN span USING (run_id) LEFT JOIN agg USING (run_id))
SELECT run_id, ['empty', 'timed_out', 'no_result', 'syntax_error', 'policy_error', 'prepare_error', 'truncated', 'runtime_error', 'ok'][k] AS status,
  CASE k WHEN 1 THEN '`code` field is empty.' WHEN 2 THEN 'Execution timed out - possible infinite loop'
         WHEN 3 THEN 'Execution failed before a trace result could be returned.' WHEN 4 THEN syntax_error WHEN 5 THEN policy_error
         WHEN 6 THEN 'Could not prepare code: ' || prepare_error
         WHEN 7 THEN 'Trace truncated at {cap} steps (execution may be long-running).' WHEN 8 THEN error END AS error,
  CAST(CASE WHEN k >= 7 THEN coalesce(n_steps, 0) ELSE 0 END AS BIGINT) AS step_count,
  CAST(CASE WHEN k >= 7 THEN coalesce(max_depth, 0) ELSE 0 END AS INT) AS max_depth,
  CASE WHEN k >= 7 THEN {sql_py_strip("coalesce(out, '')")} ELSE '' END AS final_output
FROM j"""


def oracle():
    return {
        "trace_run_outcomes": _outcomes_sql(),
        "trace_call_depth": _walk_sql() + """
SELECT run_id, seq, CAST(step_no AS INT) AS step_no, event, line_number, call_depth
FROM steps WHERE step_no <= """
        + str(CAP),
        "trace_run_status": _status_sql() + "\nSELECT * FROM status",
        "trace_run_summary": _status_sql() + f""",
first AS (SELECT run_id, string_agg(event || ':' || CAST(line_number AS VARCHAR) || ':' ||
                                    CAST(call_depth AS VARCHAR), ' | ' ORDER BY step_no) AS f
          FROM steps WHERE step_no <= 12 GROUP BY run_id)
SELECT s.run_id, status, error, step_count, final_output,
       CASE WHEN step_count > 0 THEN f ELSE '' END AS first_steps,
       CASE WHEN step_count > 12 THEN '... ' || CAST(step_count - 12 AS VARCHAR) || ' more steps'
            END AS more
FROM status s LEFT JOIN first USING (run_id)""",
        "trace_hot_lines": _walk_sql() + f"""
SELECT run_id, line_number, hits, max_depth,
       CAST(rank() OVER (PARTITION BY run_id ORDER BY hits DESC, line_number) AS INT) AS line_rank
FROM (SELECT run_id, line_number, count(*) AS hits, max(call_depth) AS max_depth
      FROM steps WHERE step_no <= {CAP} GROUP BY run_id, line_number) t""",
    }


def queries():
    return {
        "trace_call_depth": trace_call_depth,
        "trace_run_status": trace_run_status,
        "trace_run_summary": trace_run_summary,
        "trace_hot_lines": trace_hot_lines,
        "trace_run_outcomes": trace_run_outcomes,
    }
