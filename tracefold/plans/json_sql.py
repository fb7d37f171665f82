"""SQL over the JSON texts of records: the elements of lists in all their shapes, and the attempts."""

from __future__ import annotations

DECODED = "CASE WHEN trim(coalesce({c}, '')) = '' THEN NULL WHEN json_type({c}) = 'VARCHAR' THEN CAST(json_extract_string({c}, '$') AS JSON) ELSE CAST({c} AS JSON) END"


def elements_sql(v: str, name: str) -> str:
    """The list of a JSON value's elements in SQL: lists, lists in lists, position keys, envelopes and groups, as in operators.nested."""
    many = f"len(list_filter(json_extract({v}, '$.*'), lambda y: json_type(y) = 'ARRAY' AND json_type(y, '$[0]') IN ('OBJECT', 'ARRAY', 'NULL')))"
    inner = f"json_extract(list_filter(json_extract({v}, '$.*'), lambda y: json_type(y) = 'ARRAY')[1], '$[*]')"
    boxed = f"json_type({v}, '$.{name}')"
    top = (
        f"CASE json_type({v}) WHEN 'ARRAY' THEN json_extract({v}, '$[*]') WHEN 'OBJECT' THEN CASE WHEN len(json_keys({v})) > 0 AND len(list_filter(json_keys({v}), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0 THEN json_extract({v}, '$.*') "
        f"WHEN len(json_keys({v})) = 1 AND {boxed} = 'ARRAY' THEN json_extract({v}, '$.{name}[*]') WHEN len(json_keys({v})) = 1 AND {boxed} = 'OBJECT' THEN [json_extract({v}, '$.{name}')] "
        f"WHEN len(json_keys({v})) <= 3 AND {many} = 1 THEN {inner} ELSE [{v}] END WHEN 'NULL' THEN [] ELSE [{v}] END"
    )
    each = "flatten(list_transform({x}, lambda e: CASE WHEN json_type(e) = 'ARRAY' THEN json_extract(e, '$[*]') WHEN json_type(e) = 'OBJECT' AND len(json_keys(e)) <= 3 AND json_type(e, '$.calls') = 'ARRAY' THEN list_transform(json_extract(e, '$.calls[*]'), lambda c: CASE WHEN json_type(c) = 'OBJECT' AND json_type(e, '$.turn_id') IS NOT NULL THEN json_merge_patch(json_object('turn_id', json_extract(e, '$.turn_id')), c) ELSE c END) ELSE [e] END))"
    return f"list_filter({each.format(x=each.format(x=top))}, lambda e: e IS NOT NULL AND json_type(e) <> 'NULL' AND CAST(e AS VARCHAR) NOT IN ('{{}}', '[]'))"


def attempts_sql() -> str:
    """`att`: (record_id, pos, step, attempt, goal, status, reason, files, tools) of the attempts of trajectories, as export.parsed_attempts reads them."""
    text = lambda m: f"CASE json_type(e, '$.{m}') WHEN 'VARCHAR' THEN e->>'$.{m}' WHEN 'NULL' THEN '' ELSE coalesce(CAST(json_extract(e, '$.{m}') AS VARCHAR), '') END"
    many = lambda m: f"list_transform(coalesce({elements_sql('m_' + m, m)}, []), lambda y: json_extract_string(y, '$'))"
    return f"""a0 AS (SELECT record_id, {DECODED.format(c="attempts")} AS v FROM trajectories),
a1 AS (SELECT record_id, unnest({elements_sql("v", "attempts")}) AS e, unnest(range(len({elements_sql("v", "attempts")}))) AS pos FROM a0),
a2 AS (SELECT *, json_extract(e, '$.target_files') AS m_target_files, json_extract(e, '$.tool_names') AS m_tool_names FROM a1),
att AS (SELECT record_id, pos, coalesce(e->>'$.step_number', CAST(pos + 1 AS VARCHAR)) AS step, coalesce(e->>'$.attempt_number', '1') AS attempt, {text("goal")} AS goal, {text("status")} AS status, {text("failure_reason")} AS reason, {many("target_files")} AS files, {many("tool_names")} AS tools FROM a2)"""
