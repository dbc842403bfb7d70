"""DuckDB SQL of the interval tables, to build the queries' SQL from."""

from __future__ import annotations

import re

from ..operators import align, integrity
from ..sources import trace_view


def edges(kind: str, opened: str, closed: str, missing: str, unmatched: str, owner_open: str, owner_lone: str) -> dict[str, str]:
    return {
        f"{kind}_base": f"""SELECT dataset_id, task_id, CASE WHEN event_name <> 'TASK_EXIT' THEN obj_id END AS own_obj, owner_task_id, event_name, ts, core_id, seq, event_uid, trusted FROM al
  WHERE event_name IN ('{opened}', '{closed}', 'TASK_EXIT') AND (event_name <> '{opened}' OR obj_id IS NOT NULL)""",
        f"{kind}_rows": f"""SELECT *, own_obj AS obj_id FROM {kind}_base WHERE own_obj IS NOT NULL
  UNION ALL SELECT b.*, k.obj_id FROM {kind}_base AS b LEFT JOIN (SELECT DISTINCT dataset_id, task_id, own_obj AS obj_id FROM {kind}_base WHERE event_name = '{opened}') AS k USING (dataset_id, task_id) WHERE b.own_obj IS NULL""",
        f"{kind}_near": f"""SELECT *, lead(event_name) OVER w AS n_name, lead(ts) OVER w AS n_ts, lead(event_uid) OVER w AS n_uid, lead(trusted) OVER w AS n_trusted, lag(event_name) OVER w AS l_name
  FROM {kind}_rows WINDOW w AS (PARTITION BY dataset_id, task_id, obj_id ORDER BY ts, core_id, seq)""",
        f"{kind}s": f"""SELECT dataset_id, '{kind}' AS edge_kind, task_id, obj_id, {owner_open} AS owner_task_id, ts AS t_begin, coalesce(n_ts, end_ts) AS t_end, event_uid AS evidence_ref, n_uid AS end_event,
    CASE WHEN n_name IS NULL THEN 'OPEN' WHEN n_name = '{opened}' THEN 'SUCCESSOR_OPEN' WHEN n_name = 'TASK_EXIT' THEN 'TERMINAL_TASK_EXIT' ELSE 'NORMAL' END AS close_kind,
    CASE WHEN n_name IS NULL OR n_name <> '{closed}' THEN '{missing}' END AS reason_code, trusted AND coalesce(n_trusted, true) AS trusted
  FROM {kind}_near JOIN ends USING (dataset_id) WHERE event_name = '{opened}'
  UNION ALL SELECT dataset_id, '{kind}', any_value(task_id), any_value(own_obj), {owner_lone}, any_value(ts), any_value(ts), event_uid, NULL, 'UNMATCHED', '{unmatched}', any_value(trusted)
  FROM {kind}_near WHERE event_name = '{closed}' GROUP BY dataset_id, event_uid HAVING NOT bool_or(coalesce(l_name = '{opened}', false))""",
    }


#: CRC-32 of an ASCII text, bit by bit.
CRC32 = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), flatten(list_transform(string_split(CAST({} AS varchar), ''), lambda c: [CAST(ascii(c) AS bigint), 0, 0, 0, 0, 0, 0, 0]))),"
    " lambda s, v: xor(xor(s, v) >> 1, (xor(s, v) & 1) * 3988292384)), 4294967295)"
)

VIEWS = {
    **trace_view.SQL,
    **integrity.SQL,
    **align.SQL,
    "ends": "SELECT dataset_id, max(ts) AS end_ts FROM al GROUP BY dataset_id",
    "changes": """SELECT dataset_id, ts, core_id, seq, 0 AS sub, event_uid, trusted, CASE WHEN event_name IN ('TASK_BLOCK', 'TASK_WAKEUP') THEN obj_id END AS related_obj, task_id,
    CASE event_name WHEN 'TASK_BLOCK' THEN 'BLOCKED' WHEN 'TASK_EXIT' THEN 'EXIT' ELSE 'READY' END AS state, false AS cond FROM al WHERE event_name IN ('TASK_READY', 'TASK_BLOCK', 'TASK_WAKEUP', 'TASK_EXIT')
  UNION ALL SELECT dataset_id, ts, core_id, seq, 0, event_uid, trusted, NULL, prev_task_id, 'READY', true FROM al WHERE event_name = 'CTX_SWITCH' AND prev_task_id <> 0
  UNION ALL SELECT dataset_id, ts, core_id, seq, 1, event_uid, trusted, NULL, next_task_id, 'RUNNING', false FROM al WHERE event_name = 'CTX_SWITCH' AND next_task_id <> 0""",
    "accepted": """SELECT * FROM (SELECT *, lag(CASE WHEN NOT cond THEN state END) OVER (PARTITION BY dataset_id, task_id ORDER BY ts, core_id, seq, sub) AS before FROM changes) AS x WHERE NOT cond OR before = 'RUNNING'""",
    "states": """SELECT dataset_id, 'seg:' || dataset_id || ':' || task_id || ':' || row_number() OVER w AS seg_id, task_id, state, ts AS t_begin, coalesce(lead(ts) OVER w, end_ts) AS t_end,
  event_uid AS cause_event, related_obj, trusted FROM accepted JOIN ends USING (dataset_id) WINDOW w AS (PARTITION BY dataset_id, task_id ORDER BY ts, core_id, seq, sub)""",
    "dispatches": """SELECT * FROM (SELECT dataset_id, event_uid, task_id, core_id, event_name, CASE WHEN lag(event_name) OVER w = 'TASK_DISPATCH' THEN lag(event_uid) OVER w END AS dispatch_event,
    CASE WHEN lag(event_name) OVER w = 'TASK_DISPATCH' THEN lag(trusted) OVER w END AS dispatch_trusted FROM al WHERE event_name = 'TASK_DISPATCH' OR event_name = 'CTX_SWITCH' AND next_task_id <> 0
  WINDOW w AS (PARTITION BY dataset_id, task_id, core_id ORDER BY ts, seq)) AS x WHERE event_name = 'CTX_SWITCH'""",
    "switched": """SELECT *, lead(ts) OVER w AS c_ts, lead(event_uid) OVER w AS c_uid, lead(next_task_id) OVER w AS c_next, lead(reason) OVER w AS c_reason, lead(trusted) OVER w AS c_trusted
  FROM al WHERE event_name = 'CTX_SWITCH' WINDOW w AS (PARTITION BY dataset_id, core_id ORDER BY ts, seq)""",
    "slices": """SELECT s.dataset_id, 'slice:' || s.dataset_id || ':' || s.core_id || ':' || row_number() OVER (PARTITION BY s.dataset_id, s.core_id ORDER BY ts, seq) AS slice_id, next_task_id AS task_id, s.core_id,
  ts AS t_begin, coalesce(c_ts, end_ts) AS t_end, s.event_uid AS start_event, c_uid AS end_event, nullif(c_next, 0) AS preempted_by, c_reason AS run_reason,
  trusted AND coalesce(dispatch_trusted, true) AND coalesce(c_trusted, true) AS trusted, dispatch_event
  FROM switched AS s JOIN ends USING (dataset_id) JOIN dispatches AS d ON d.dataset_id = s.dataset_id AND d.event_uid = s.event_uid WHERE next_task_id <> 0""",
    **edges("hold", "SYNC_LOCK", "SYNC_UNLOCK", "LOCK_WITHOUT_UNLOCK", "UNLOCK_WITHOUT_LOCK", "task_id", "any_value(task_id)"),
    **edges("wait", "TASK_BLOCK", "TASK_WAKEUP", "WAIT_WITHOUT_WAKEUP", "WAKEUP_WITHOUT_BLOCK", "owner_task_id", "any_value(owner_task_id)"),
    "irq_rows": """SELECT dataset_id, core_id, irq_id, CAST(nesting_depth AS int) AS nesting_depth, event_name, ts, seq, event_uid, trusted, row_number() OVER (PARTITION BY dataset_id, core_id ORDER BY ts, seq) AS i
  FROM al WHERE event_name LIKE 'IRQ%'""",
    "irq_walk": """SELECT dataset_id, core_id, 0 AS i, CAST([] AS STRUCT(irq bigint, depth int, ts bigint, uid varchar, trusted boolean)[]) AS stack, CAST(NULL AS STRUCT(irq bigint, depth int, ts bigint, uid varchar, trusted boolean)) AS enter,
    CAST(NULL AS varchar) AS kind, CAST(NULL AS bigint) AS irq, CAST(NULL AS int) AS depth, CAST(NULL AS bigint) AS ts, CAST(NULL AS varchar) AS uid, CAST(NULL AS boolean) AS trusted FROM irq_rows GROUP BY ALL
  UNION ALL SELECT w.dataset_id, w.core_id, CAST(r.i AS int), CASE WHEN r.event_name = 'IRQ_ENTER' THEN list_append(w.stack, {'irq': r.irq_id, 'depth': r.nesting_depth, 'ts': r.ts, 'uid': r.event_uid, 'trusted': r.trusted})
      WHEN len(w.stack) > 0 AND w.stack[-1].irq = r.irq_id AND w.stack[-1].depth = r.nesting_depth THEN w.stack[:-2] ELSE w.stack END,
    CASE WHEN r.event_name = 'IRQ_EXIT' AND len(w.stack) > 0 AND w.stack[-1].irq = r.irq_id AND w.stack[-1].depth = r.nesting_depth THEN w.stack[-1] END,
    CASE WHEN r.event_name = 'IRQ_ENTER' THEN 'PUSH' WHEN len(w.stack) > 0 AND w.stack[-1].irq = r.irq_id AND w.stack[-1].depth = r.nesting_depth THEN 'NORMAL' ELSE 'UNMATCHED' END,
    r.irq_id, r.nesting_depth, r.ts, r.event_uid, r.trusted FROM irq_walk AS w JOIN irq_rows AS r ON r.dataset_id = w.dataset_id AND r.core_id = w.core_id AND r.i = w.i + 1""",
    "irq_closed": """SELECT dataset_id, core_id, irq AS irq_id, depth AS nesting_depth, CASE WHEN kind = 'NORMAL' THEN enter.ts ELSE ts END AS t_begin, ts AS t_end, CASE WHEN kind = 'NORMAL' THEN enter.uid END AS enter_event,
    uid AS exit_event, kind AS close_kind, trusted AND coalesce(enter.trusted, true) AS trusted FROM irq_walk WHERE kind IN ('NORMAL', 'UNMATCHED')
  UNION ALL SELECT dataset_id, core_id, e.irq, e.depth, e.ts, end_ts, e.uid, NULL, 'OPEN', e.trusted
    FROM (SELECT dataset_id, core_id, unnest(max_by(stack, i)) AS e FROM irq_walk GROUP BY dataset_id, core_id) AS x JOIN ends USING (dataset_id)""",
    "irqs": """SELECT c.*, nullif((SELECT max_by(s.next_task_id, (s.ts, s.seq)) FROM al AS s WHERE s.event_name = 'CTX_SWITCH' AND s.dataset_id = c.dataset_id AND s.core_id = c.core_id
    AND (s.ts, s.seq) <= (c.t_end, coalesce(x.seq, 1152921504606846976))), 0) AS delayed_task, 'irq:' || c.dataset_id || ':' || coalesce(c.enter_event, c.exit_event) AS irq_span_id
  FROM irq_closed AS c LEFT JOIN al AS x ON x.event_uid = c.exit_event""",
    "relation_windows": """SELECT dataset_id, 'uw:' || dataset_id || ':' || reason_code || ':' || key AS window_id, 'relation' AS source, 'object' AS scope, t_begin, t_end, reason_code, 'warning' AS severity FROM (
    SELECT dataset_id, reason_code, t_begin, t_end, evidence_ref AS key FROM holds WHERE reason_code IS NOT NULL UNION ALL SELECT dataset_id, reason_code, t_begin, t_end, evidence_ref FROM waits WHERE reason_code IS NOT NULL
    UNION ALL SELECT dataset_id, CASE close_kind WHEN 'UNMATCHED' THEN 'IRQ_EXIT_WITHOUT_MATCHING_ENTER' ELSE 'IRQ_ENTER_WITHOUT_EXIT' END, t_begin, t_end, coalesce(enter_event, exit_event) FROM irqs WHERE close_kind <> 'NORMAL') AS x""",
    "windows": "SELECT * FROM gap_windows UNION ALL SELECT * FROM loss_windows UNION ALL SELECT * FROM align_windows UNION ALL SELECT * FROM relation_windows",
    "scope": "SELECT dataset_id, min(ts) + (max(ts) - min(ts)) // 10 AS w_begin, max(ts) - (max(ts) - min(ts)) // 10 AS w_end FROM al GROUP BY dataset_id",
}
RECURSIVE = {"irq_walk", "c_irq_walk", "vwalk"}


def with_views(query: str, extra: dict[str, str] | None = None) -> str:
    """The query after the views that it names, and those that they name."""
    views = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def need(text: str, inside: tuple = ()) -> None:
        for name in views:
            if name not in needed and name not in inside and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(views[name], (*inside, name))
                needed.append(name)

    need(query)
    heads = [f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({views[n]})" for n in needed]
    word = "WITH RECURSIVE" if any(n in RECURSIVE for n in needed) else "WITH"
    return f"{word} " + ",\n".join(heads) + f"\n{query}" if heads else query
