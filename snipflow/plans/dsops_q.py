"""Registered step-view queries: T4 on X1 + documents, T5/T6 on documents,
T7-T14 and the operation mix (T18) on X2."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipflow.functions.text import PY_LINE_BREAK, PY_WS, sql_py_strip
from snipflow.operators import dsops
from snipflow.sources import fixtures as fx
from snipflow.sources.tables import table

_OPS_COLS = ["run_id", "seq", "line_number", "line_text", "operation", "ds_type", "value", "data",
             "active_indices", "front", "rear", "top", "log"]


def _ops(spark, sf_dir):
    steps = dsops.attach_line_text(fx.x2_steps(spark, sf_dir), fx.x2_runs(spark, sf_dir))
    return dsops.detect_operations(steps)


def trace_operations(spark, sf_dir):
    return _ops(spark, sf_dir).select(*_OPS_COLS)


def trace_operation_mix(spark, sf_dir):
    return dsops.operation_mix(_ops(spark, sf_dir))


def trace_line_text(spark, sf_dir):
    steps = fx.x1_steps(spark, sf_dir).select("run_id", "seq", "line_number")
    runs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"),
                                                    F.col("text").alias("code"))
    return dsops.attach_line_text(steps, runs).select("run_id", "seq", "line_number", "line_text")


def trace_locals_bounds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    loc = F.array(
        F.struct(F.lit("text").alias("name"), F.lit("str").alias("kind"),
                 F.lit(None).cast("array<string>").alias("items"), F.col("text").alias("repr")),
        dsops.words_local(F.col("text")),
        F.struct(F.lit("__name__").alias("name"), F.lit("str").alias("kind"),
                 F.lit(None).cast("array<string>").alias("items"), F.lit("__main__").alias("repr")),
        F.struct(F.lit("collections").alias("name"), F.lit("module").alias("kind"),
                 F.lit(None).cast("array<string>").alias("items"),
                 F.lit("<module 'collections'>").alias("repr")),
    )
    s = d.select("doc_id", dsops.sanitise_locals(loc).alias("l"))
    return s.select(
        "doc_id", F.size("l").alias("n_locals"),
        F.col("l")[0]["repr"].alias("text_value"),
        F.col("l")[1]["kind"].alias("words_kind"),
        F.when(F.col("l")[1]["items"].isNotNull(), F.size(F.col("l")[1]["items"])).alias("words_n_items"),
        F.array_join(F.col("l")[1]["items"], " ").alias("words_items"),
        F.col("l")[1]["repr"].alias("words_repr"),
    )


_T = sql_py_strip("line_text")


def _ops_sql() -> str:
    lines = ", ".join("'" + s.replace("'", "''") + "'" for s in fx.X2_LINES)
    return f"""
WITH s AS ({fx.x2_steps_sql()}),
l AS (SELECT s.*, coalesce([{lines}][line_number], '') AS line_text FROM s),
t AS (SELECT l.*, {_T} AS t FROM l),
o AS (SELECT t.*,
  CASE WHEN t = '' THEN NULL
       WHEN contains(t, '.popleft(') OR contains(t, '.pop(0)') THEN 'dequeue'
       WHEN regexp_matches(t, '\\.pop\\(\\s*\\)') AND NOT contains(t, '.pop(0)') THEN 'pop'
       WHEN regexp_matches(t, '\\b(queue|deque|q|frontier)\\b') AND contains(t, '.append(') THEN 'enqueue'
       WHEN regexp_matches(t, '\\b(stack|stk)\\b') AND regexp_matches(t, '\\.(append|push)\\(') THEN 'push'
  END AS operation,
  regexp_matches(t, '\\.\\w+\\(\\s*([^\\)]+?)\\s*\\)') AS has_arg,
  regexp_replace({sql_py_strip("regexp_extract(t, '\\.\\w+\\(\\s*([^\\)]+?)\\s*\\)', 1)")},
                 '^[''"]+|[''"]+$', '', 'g') AS raw
  FROM t),
f AS (SELECT o.*,
  CASE WHEN operation IN ('dequeue', 'enqueue') THEN coll_kind = 'list'
       WHEN operation = 'pop' THEN coll_kind = 'list' AND (
            contains(coll_name, 'stack') OR contains(coll_name, 'stk')
            OR contains(lower(coll_name), 'arr') OR coll_name = 's'
            OR coll_name NOT IN ('result', 'res', 'output', 'ans'))
       WHEN operation = 'push' THEN coll_kind = 'list'
            AND (contains(coll_name, 'stack') OR contains(coll_name, 'stk'))
       ELSE false END AS found,
  len(items) AS n,
  CASE WHEN NOT has_arg THEN 'None'
       WHEN regexp_matches(raw, '^[+-]?[0-9]+$') AND TRY_CAST(raw AS BIGINT) IS NOT NULL
         THEN CAST(TRY_CAST(raw AS BIGINT) AS VARCHAR)
       WHEN regexp_matches(raw, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)$') THEN CAST(TRY_CAST(raw AS DOUBLE) AS VARCHAR)
       WHEN raw = coll_name AND coll_kind = 'list' THEN '[' || array_to_string(items, ', ') || ']'
       WHEN raw = coll_name AND coll_kind = 'tuple' AND len(items) = 1 THEN '(' || items[1] || ',)'
       WHEN raw = coll_name AND coll_kind = 'tuple' THEN '(' || array_to_string(items, ', ') || ')'
       WHEN raw = scalar_name THEN scalar_repr
       ELSE raw END AS arg
  FROM o),
v AS (SELECT f.*,
  CASE WHEN n > 0 THEN items[1] ELSE 'None' END AS first_v,
  CASE WHEN n > 0 THEN items[n] ELSE 'None' END AS last_v,
  '[' || array_to_string(items[1:20], ', ') || ']' AS view
  FROM f)
SELECT run_id, seq, line_number, line_text, operation,
  CASE WHEN operation IN ('dequeue', 'enqueue') THEN 'queue' WHEN operation IS NOT NULL THEN 'stack' END AS ds_type,
  CASE WHEN operation = 'dequeue' THEN CASE WHEN found THEN first_v END
       WHEN operation = 'pop' THEN CASE WHEN found THEN last_v END
       WHEN operation IN ('enqueue', 'push') THEN arg END AS value,
  CASE WHEN found THEN view END AS data,
  CASE WHEN NOT found THEN NULL WHEN n = 0 THEN '[]' WHEN operation = 'dequeue' THEN '[0]'
       ELSE '[' || CAST(n - 1 AS VARCHAR) || ']' END AS active_indices,
  CAST(CASE WHEN found AND operation IN ('dequeue', 'enqueue') THEN CASE WHEN n > 0 THEN 0 ELSE -1 END END AS INT) AS front,
  CAST(CASE WHEN found AND operation IN ('dequeue', 'enqueue') THEN CASE WHEN n > 0 THEN n - 1 ELSE -1 END END AS INT) AS rear,
  CAST(CASE WHEN found AND operation IN ('pop', 'push') THEN n - 1 END AS INT) AS top,
  CASE operation
    WHEN 'dequeue' THEN CASE WHEN found THEN 'Dequeued ' || first_v || ' from queue. Queue is now: ['
                              || array_to_string(items[2:20], ', ') || ']' ELSE 'Dequeued from queue.' END
    WHEN 'pop' THEN CASE WHEN found THEN 'Popped ' || last_v || ' from stack. Stack is now: ['
                          || array_to_string(items[1:n - 1], ', ') || ']' ELSE 'Popped from stack.' END
    WHEN 'enqueue' THEN CASE WHEN found THEN 'Enqueued ' || arg || ' to queue. Queue is now: ' || view
                              ELSE 'Enqueued ' || arg || ' to queue.' END
    WHEN 'push' THEN CASE WHEN found THEN 'Pushed ' || arg || ' to stack. Stack is now: ' || view
                           ELSE 'Pushed ' || arg || ' to stack.' END
  END AS log
FROM v"""


def _repr_sql(w: str) -> str:
    return (f"CASE WHEN contains({w}, '''') AND NOT contains({w}, '\"') "
            f"THEN '\"' || replace({w}, '\\', '\\\\') || '\"' "
            f"ELSE '''' || replace(replace({w}, '\\', '\\\\'), '''', '\\''') || '''' END")


def _trunc_sql(x: str) -> str:
    return f"CASE WHEN length({x}) > 1000 THEN substr({x}, 1, 1000) || '... (truncated)' ELSE {x} END"


def oracle():
    return {
        "trace_operations": _ops_sql(),
        "trace_operation_mix": f"""SELECT run_id, operation, count(*) AS n_ops FROM ({_ops_sql()}) x
WHERE operation IS NOT NULL GROUP BY run_id, operation""",
        "trace_line_text": f"""SELECT e.user_id AS run_id, e.event_id AS seq,
  CAST(e.event_id % 20 + 1 AS INT) AS line_number,
  coalesce(string_split_regex(d.text, '{PY_LINE_BREAK}')[CAST(e.event_id % 20 + 1 AS INT)], '')
    AS line_text
FROM events e LEFT JOIN documents d ON d.doc_id = e.user_id""",
        "trace_locals_bounds": f"""
WITH w AS (SELECT doc_id, text,
  list_transform(list_filter(string_split_regex(text, '{PY_WS}+'), lambda x: x <> ''),
                 lambda x: {_repr_sql('x')}) AS reprs FROM documents),
f AS (SELECT *, '[' || array_to_string(reprs, ', ') || ']' AS full_repr FROM w)
SELECT doc_id, 2 AS n_locals, {_trunc_sql('text')} AS text_value,
  CASE WHEN length(full_repr) > 1000 THEN 'repr' ELSE 'list' END AS words_kind,
  CAST(CASE WHEN length(full_repr) > 1000 THEN NULL ELSE len(reprs[1:50]) END AS INT) AS words_n_items,
  CASE WHEN length(full_repr) > 1000 THEN NULL ELSE array_to_string(reprs[1:50], ' ') END AS words_items,
  CASE WHEN length(full_repr) > 1000 THEN {_trunc_sql('full_repr')} END AS words_repr
FROM f""",
    }


def queries():
    return {
        "trace_operations": trace_operations,
        "trace_operation_mix": trace_operation_mix,
        "trace_line_text": trace_line_text,
        "trace_locals_bounds": trace_locals_bounds,
    }
