"""DuckDB SQL for the queries' results, formulated another way wherever there is one.

Windows are self joins over the queue, bursts come from those counts, clusters from a
recursive walk, hits from a join with the list of patterns.
"""

from __future__ import annotations

from checks.fixture import DUCK_FILES, DUCK_MIXED, DUCK_RUN
from checks.queries import (
    BIG,
    LOGIN,
    RUN_SPECS,
    SCAN,
    SHIPPED,
    SIGNATURES,
    SSH,
    STUFFING,
    WINDOW_MINUTES,
    tuned,
)
from logwarden.schema import SEVERITIES

WEB_RE = (
    r"^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+\"([^\"]*)\"\s+(\d{3}|-)\s+(\d+|-)"
    r"(?:\s+\"([^\"]*)\"\s+\"([^\"]*)\")?\s*$"
).replace('\\"', '"')
WEB_NAMES = "['ip', 'identity', 'usr', 'stamp', 'request', 'status', 'size', 'referrer', 'agent']"
AUTH_RE = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[\s:]+)(?:\[(\d+)\])?:\s*(.*)$"
AUTH_NAMES = "['mon', 'day', 'clock', 'host', 'process', 'pid', 'message']"
PAIR_RE = r'(?:\d|-)\s+"[^"]*"\s+"[^"]*"\s*$'
FROM_RE = r"\bfrom\s+(\d{1,3}(?:\.\d{1,3}){3})(?:\s+port\s+(\d+))?"
ANY_RE = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
FAILED_RE = r"Failed password for (?:invalid user\s+)?(\S+)\s+from"
ACCEPTED_RE = r"Accepted \S+ for (\S+)\s+from"
INVALID_RE = r"invalid user\s+(\S+)"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def parsed(lines: str, *, seq: str = "pos", anchored: bool = False) -> str:
    """CTEs lines, web, auth, entries, errors, paths from lines with a known format.

    ``seq`` is the order of arrival. ``anchored``: auth stamps after the newest web stamp are
    of the year before.
    """
    newest = "(SELECT max(t) FROM (SELECT arg_max(ts, line_no) AS t FROM web WHERE ts IS NOT NULL GROUP BY source))"
    auth_ts = f"CASE WHEN ts > {newest} THEN ts - 31536000 ELSE ts END" if anchored else "ts"
    return f"""
lines AS ({lines}),
web_groups AS (
  SELECT source, source_idx, line_no, value AS raw, regexp_matches(value, {text(WEB_RE)}) AS fits,
    regexp_matches(value, {text(PAIR_RE)}) AS pair, regexp_extract(value, {text(WEB_RE)}, {WEB_NAMES}) AS g
  FROM lines WHERE format = 'web' AND trim(value) <> ''
),
web AS (
  SELECT 'web' AS kind, source, source_idx, line_no, raw, fits,
    CASE WHEN fits THEN epoch(try_strptime(g.stamp, '%d/%b/%Y:%H:%M:%S %z'))::BIGINT END AS ts,
    nullif(g.ip, '-') AS source_ip, string_split_regex(trim(g.request), '\\s+') AS tokens,
    try_cast(g.status AS BIGINT) AS status, coalesce(try_cast(g.size AS BIGINT), 0) AS size,
    nullif(g.identity, '-') AS identity, nullif(g.usr, '-') AS user_name,
    CASE WHEN pair THEN g.referrer END AS referrer, CASE WHEN pair THEN g.agent END AS user_agent
  FROM web_groups
),
auth_groups AS (
  SELECT source, source_idx, line_no, value AS raw, regexp_matches(value, {text(AUTH_RE)}) AS fits,
    regexp_extract(value, {text(AUTH_RE)}, {AUTH_NAMES}) AS g
  FROM lines WHERE format = 'auth' AND trim(value) <> ''
),
auth AS (
  SELECT 'auth' AS kind, source, source_idx, line_no, raw, fits,
    CASE WHEN fits THEN epoch(try_strptime('2024 ' || g.mon || ' ' || g.day || ' ' || g.clock,
      '%Y %b %d %H:%M:%S'))::BIGINT END AS ts,
    g.host AS hostname, g.process AS process, try_cast(g.pid AS BIGINT) AS pid, g.message AS message,
    CASE WHEN regexp_matches(g.message, {text(FROM_RE)}) THEN regexp_extract(g.message, {text(FROM_RE)}, 1)
         ELSE nullif(regexp_extract(g.message, {text(ANY_RE)}, 1), '') END AS source_ip,
    try_cast(CASE WHEN regexp_matches(g.message, {text(FROM_RE)}) THEN regexp_extract(g.message, {text(FROM_RE)}, 2)
         WHEN regexp_matches(g.message, {text(ANY_RE)}) THEN regexp_extract(g.message, '\\bport\\s+(\\d+)', 1)
         END AS BIGINT) AS source_port,
    regexp_matches(g.message, {text(FAILED_RE)}, 'i') AS failed,
    regexp_matches(g.message, {text(INVALID_RE)}, 'i') AS invalid,
    regexp_matches(g.message, {text(ACCEPTED_RE)}, 'i') AS accepted,
    lower(g.message) LIKE 'failed%' AS begins
  FROM auth_groups
),
entries AS (
  SELECT kind, source, source_idx, line_no, source_idx::BIGINT * 1099511627776 + line_no AS pos, raw, ts, source_ip,
    CASE WHEN tokens[1] <> '' THEN tokens[1] END AS method,
    CASE WHEN len(tokens) > 3 THEN array_to_string(tokens[2:len(tokens) - 1], ' ')
         WHEN len(tokens) >= 2 THEN tokens[2] END AS target,
    CASE WHEN len(tokens) >= 3 THEN tokens[len(tokens)] END AS protocol,
    status, size, identity, user_name, referrer, user_agent,
    NULL::VARCHAR AS hostname, NULL::VARCHAR AS process, NULL::BIGINT AS pid, NULL::VARCHAR AS message,
    NULL::BIGINT AS source_port, NULL::VARCHAR AS outcome, NULL::VARCHAR AS username
  FROM web WHERE ts IS NOT NULL
  UNION ALL
  SELECT kind, source, source_idx, line_no, source_idx::BIGINT * 1099511627776 + line_no, raw, {auth_ts}, source_ip,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    hostname, process, pid, message, source_port,
    CASE WHEN failed AND invalid THEN 'invalid_user' WHEN failed THEN 'failure' WHEN accepted THEN 'success'
         WHEN begins AND invalid THEN 'invalid_user' ELSE 'other' END,
    CASE WHEN failed THEN regexp_extract(message, {text(FAILED_RE)}, 1, 'i')
         WHEN accepted THEN regexp_extract(message, {text(ACCEPTED_RE)}, 1, 'i')
         WHEN begins AND invalid THEN regexp_extract(message, {text(INVALID_RE)}, 1, 'i') END
  FROM auth WHERE ts IS NOT NULL
),
errors AS (
  SELECT source, line_no, raw, CASE WHEN fits THEN 'bad timestamp' ELSE 'does not match Combined log format' END AS reason
  FROM web WHERE ts IS NULL
  UNION ALL
  SELECT source, line_no, raw, CASE WHEN fits THEN 'bad timestamp' ELSE 'does not match BSD syslog format' END
  FROM auth WHERE ts IS NULL
),
paths AS (
  SELECT *, {seq} AS seq, split_part(target, '?', 1) AS path,
    CASE WHEN contains(target, '?') THEN substr(target, strpos(target, '?') + 1) END AS query
  FROM entries
)"""


RUN = "WITH RECURSIVE " + parsed(DUCK_RUN)
# The live runs read one half of the events, then the other.
HALF = "(line_no > (SELECT count(*) / 2 FROM events))"
LIVE = "WITH RECURSIVE " + parsed(DUCK_RUN, seq=f"{HALF}::BIGINT * 1152921504606846976 + pos")
FILES = "WITH RECURSIVE " + parsed(
    f"SELECT *, dense_rank() OVER (ORDER BY source)::INTEGER - 1 AS source_idx FROM ({DUCK_FILES})", anchored=True
)

_MATCH = {
    "auth_failure": "kind = 'auth' AND outcome IN ('failure', 'invalid_user')",
    "web_login_failure": "kind = 'web' AND status IN (401, 403) AND lower(path) LIKE '%login%'",
    "web_404": "kind = 'web' AND status = 404",
}
_ITEM = {
    "path": "CASE WHEN kind = 'web' THEN coalesce(nullif(regexp_replace(path, '/+$', ''), ''), "
    "CASE WHEN path = '' THEN '' WHEN path IS NOT NULL THEN '/' END) END",
    "username": "username",
    None: "pos::VARCHAR",
}
_TARGET = {
    "request_target": "target",
    "path": "path",
    "query": "query",
    "user_agent": "user_agent",
    "referrer": "referrer",
    "auth_message": "message",
}


def _level(spec: dict) -> int:
    return SEVERITIES[spec["severity"].upper()]


def _rules(specs: list[dict]) -> str:
    rows = ", ".join(
        f"({i}, {text(s['id'])}, {text(s['params']['title'])}, {_level(s)}, {text(s['severity'].upper())}, "
        f"{text(s['params'].get('description', ''))})"
        for i, s in enumerate(specs)
    )
    return f"rules(rule_pos, rule_id, title, severity, severity_name, description) AS (VALUES {rows})"


def _hits(specs: list[dict]) -> str:
    signatures = [s for s in specs if s["type"] == "signature"]
    patterns = ", ".join(
        f"({text(s['id'])}, {text(s['params'].get('target', 'request_target'))}, {n}, {text(p)})"
        for s in signatures
        for n, p in enumerate(s["params"]["patterns"])
    )
    targets = sorted({s["params"].get("target", "request_target") for s in signatures})
    values = " UNION ALL ".join(
        f"SELECT pos, {text(t)} AS target_name, {_TARGET[t]} AS v FROM paths WHERE {_TARGET[t]} <> ''" for t in targets
    )
    return f"""
patterns(rule_id, target_name, pno, pattern) AS (VALUES {patterns}),
searched AS ({values}),
forms AS (
  SELECT pos, target_name, v AS value, 0 AS depth, v AS form FROM searched
  UNION ALL SELECT pos, target_name, v, 1, url_decode(v) FROM searched
  UNION ALL SELECT pos, target_name, v, 2, url_decode(url_decode(v)) FROM searched
),
hits AS (
  SELECT p.rule_id, f.pos, arg_min(p.pattern, f.depth * 1000 + p.pno) AS pattern,
    arg_min(regexp_extract(f.form, p.pattern, 0, 'i'), f.depth * 1000 + p.pno) AS snippet, any_value(f.value) AS value
  FROM forms f JOIN patterns p ON f.target_name = p.target_name AND regexp_matches(f.form, p.pattern, 'i')
  GROUP BY p.rule_id, f.pos
)"""


def _signature_found(specs: list[dict]) -> str:
    needs = ", ".join(
        f"({text(s['id'])}, {s['params'].get('min_hits', 1)}, {s['params'].get('max_evidence', 20)})"
        for s in specs
        if s["type"] == "signature"
    )
    return f"""
needs(rule_id, min_hits, max_evidence) AS (VALUES {needs}),
numbered AS (
  SELECT h.*, e.source_ip, e.source, e.line_no, e.ts, n.min_hits, n.max_evidence,
    row_number() OVER (PARTITION BY h.rule_id, e.source_ip ORDER BY e.seq) AS nth
  FROM hits h JOIN paths e USING (pos) JOIN needs n USING (rule_id)
),
signature_found AS (
  SELECT rule_id, source_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS count,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(pos) FILTER (nth = min_hits) AS emit_pos,
    coalesce(string_agg(source || ':' || line_no, ',' ORDER BY pos) FILTER (nth <= max_evidence), '') AS evidence,
    coalesce(string_agg(pattern || '|' || snippet || '|' || value, ',' ORDER BY pos) FILTER (nth <= max_evidence), '')
      AS matches
  FROM numbered GROUP BY rule_id, source_ip HAVING count(*) >= any_value(min_hits)
)"""


def _windows(specs: list[dict]) -> str:
    """CTEs events, counted, hot, threshold_found: the queue of each event by self join."""
    thresholds = [s for s in specs if s["type"] == "threshold"]
    events = " UNION ALL ".join(
        f"SELECT {text(s['id'])} AS rule_id, {p['window_seconds']} AS w, {p['threshold']} AS need, "
        f"{p.get('max_evidence', 20)} AS max_evidence, pos, seq, ts, source, line_no, source_ip AS ip, "
        f"{_ITEM[p.get('distinct_by')]} AS item FROM paths WHERE {_MATCH[p['match']]}"
        for s in thresholds
        for p in [s["params"]]
    )
    return f"""
matching AS ({events}),
events AS (
  SELECT *, row_number() OVER k AS rn, max(ts) OVER (k ROWS UNBOUNDED PRECEDING) AS edge
  FROM matching WINDOW k AS (PARTITION BY rule_id, ip ORDER BY seq)
),
fronts AS (
  SELECT i.rule_id, i.ip, i.rn, min(j.rn) AS front
  FROM events i JOIN events j
    ON i.rule_id = j.rule_id AND i.ip IS NOT DISTINCT FROM j.ip AND j.rn <= i.rn AND j.ts >= i.edge - i.w
  GROUP BY i.rule_id, i.ip, i.rn
),
counted AS (
  SELECT i.rule_id, i.ip, i.rn, any_value(i.pos) AS pos, any_value(i.ts) AS ts, any_value(i.source) AS source,
    any_value(i.line_no) AS line_no, any_value(i.need) AS need, any_value(i.max_evidence) AS max_evidence,
    count(DISTINCT j.item) AS count, arg_min(j.ts, j.rn) AS front_ts
  FROM events i
  JOIN fronts f ON i.rule_id = f.rule_id AND i.ip IS NOT DISTINCT FROM f.ip AND i.rn = f.rn
  JOIN events j ON i.rule_id = j.rule_id AND i.ip IS NOT DISTINCT FROM j.ip AND j.rn BETWEEN f.front AND i.rn
  GROUP BY i.rule_id, i.ip, i.rn
),
hot AS (
  SELECT * FROM (
    SELECT *, sum(CASE WHEN count >= need AND NOT before THEN 1 ELSE 0 END)
        OVER (PARTITION BY rule_id, ip ORDER BY rn)::BIGINT AS burst
    FROM (SELECT *, coalesce(lag(count) OVER (PARTITION BY rule_id, ip ORDER BY rn) >= need, false) AS before FROM counted)
  ) WHERE count >= need
),
burst_rows AS (SELECT *, row_number() OVER (PARTITION BY rule_id, ip, burst ORDER BY rn) AS nth FROM hot),
threshold_found AS (
  SELECT rule_id, ip AS source_ip, arg_min(front_ts, rn) AS first_seen, max(ts) AS last_seen, arg_max(count, rn) AS count,
    string_agg(DISTINCT source, ',' ORDER BY source) AS sources, arg_min(pos, rn) AS emit_pos,
    coalesce(string_agg(source || ':' || line_no, ',' ORDER BY rn) FILTER (nth <= max_evidence), '') AS evidence,
    '' AS matches
  FROM burst_rows GROUP BY rule_id, ip, burst
)"""


FOUND_VIEW = (
    "rule_id, title, severity, severity_name, description, source_ip, first_seen, last_seen, count, sources, emit_pos, "
    "rule_pos"
)


def _found(specs: list[dict], run: str = RUN) -> str:
    """CTE found: findings of all rules of a set with the texts of their rules."""
    kinds = {s["type"] for s in specs}
    parts = [run, _rules(specs)]
    if "signature" in kinds:
        parts += [_hits(specs), _signature_found(specs)]
    if "threshold" in kinds:
        parts += [_windows(specs)]
    both = " UNION ALL ".join(f"SELECT * FROM {k}_found" for k in ("signature", "threshold") if k in kinds)
    parts.append(f"found AS (SELECT * FROM ({both}) JOIN rules USING (rule_id))")
    return ",\n".join(parts)


def found(specs: list[dict], columns: str, run: str = RUN) -> str:
    return f"{_found(specs, run)} SELECT {columns} FROM found"


_ISO = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
_SPAN = (
    "CASE WHEN span >= 172800 THEN (span // 86400) || ' days, ' WHEN span >= 86400 THEN '1 day, ' ELSE '' END"
    " || (span % 86400 // 3600) || ':' || lpad((span % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((span % 60)::VARCHAR, 2, '0')"
)


def _clusters(run: str, minutes: float) -> str:
    """CTEs clustered, gated, incidents over the findings of the run's rules."""
    limit = minutes * 60
    return f"""{_found(RUN_SPECS, run)},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY first_seen, emit_pos, rule_pos) AS n
  FROM found WHERE source_ip IS NOT NULL
),
walk AS (
  SELECT source_ip, n, 1 AS cluster, last_seen AS until FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.source_ip, o.n,
    CASE WHEN o.first_seen - w.until <= {limit} THEN w.cluster ELSE w.cluster + 1 END,
    CASE WHEN o.first_seen - w.until <= {limit} THEN greatest(w.until, o.last_seen) ELSE o.last_seen END
  FROM walk w JOIN ordered o ON o.source_ip = w.source_ip AND o.n = w.n + 1
),
clustered AS (SELECT o.*, w.cluster FROM ordered o JOIN walk w ON o.source_ip = w.source_ip AND o.n = w.n),
origins AS (SELECT DISTINCT source_ip, cluster, unnest(string_split(sources, ',')) AS source FROM clustered),
gated AS (
  SELECT c.source_ip, c.cluster, count(*) AS finding_count, count(DISTINCT rule_id) AS n_rules,
    string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids, string_agg(DISTINCT title, ', ' ORDER BY title) AS titles,
    (SELECT string_agg(source, ',' ORDER BY source) FROM origins o
      WHERE o.source_ip = c.source_ip AND o.cluster = c.cluster) AS sources,
    min(first_seen) AS first_seen, max(last_seen) AS last_seen, max(severity) AS top
  FROM clustered c GROUP BY c.source_ip, c.cluster
  HAVING count(DISTINCT rule_id) >= 2 OR
    (SELECT count(*) FROM origins o WHERE o.source_ip = c.source_ip AND o.cluster = c.cluster) >= 2
),
described AS (
  SELECT *, last_seen - first_seen AS span, {_ISO.format("first_seen")} AS first_iso, {_ISO.format("last_seen")} AS last_iso,
    CASE top WHEN 10 THEN 20 WHEN 20 THEN 30 WHEN 30 THEN 40 ELSE 50 END AS raised
  FROM gated
),
incidents AS (
  SELECT 'INC-' || substr(sha1(source_ip || '|' || first_iso || '|' || rule_ids), 1, 10) AS incident_id,
    'Correlated activity from ' || source_ip AS title, raised AS severity,
    CASE raised WHEN 20 THEN 'LOW' WHEN 30 THEN 'MEDIUM' WHEN 40 THEN 'HIGH' ELSE 'CRITICAL' END AS severity_name,
    source_ip, cluster, first_seen, last_seen, finding_count,
    source_ip || ' triggered ' || finding_count || ' findings across ' || n_rules || ' rule(s) (' || titles || ') over '
      || replace(sources, ',', ', ') || ' within ' || {_SPAN} || ' (' || first_iso || ' → ' || last_iso || ').' AS narrative
  FROM described
)"""


CLUSTERS = _clusters(RUN, WINDOW_MINUTES)
INCIDENT_VIEW = "incident_id, title, severity, severity_name, source_ip, first_seen, last_seen, finding_count, narrative"

_ORDER_CLOCK = "(o_orderkey % 25) || ':' || (o_orderkey % 60) || ':' || (o_orderkey % 61)"
WEB_STAMPS = f"""
SELECT o_orderkey AS line_no,
  CASE WHEN valid THEN epoch(day)::BIGINT + (o_orderkey % 25) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 61 - shift
    END AS ts,
  CASE WHEN NOT valid THEN 'bad timestamp' END AS reason
FROM (
  SELECT o_orderkey, date_trunc('day', o_orderdate::TIMESTAMP) AS day,
    CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN -27000 WHEN 2 THEN 19800 WHEN 3 THEN 50400 END AS shift,
    o_orderkey % 7 < 4 AND o_orderkey % 25 < 24 AND o_orderkey % 61 < 60 AS valid
  FROM orders
)"""
SYSLOG_YEARS = """
SELECT o_orderkey AS line_no, CASE WHEN valid THEN CASE WHEN ts > 1708430400 THEN older ELSE ts END END AS ts,
  CASE WHEN NOT valid THEN 'bad timestamp' END AS reason
FROM (
  SELECT o_orderkey, o_orderkey % 25 < 24 AND o_orderkey % 61 < 60 AS valid,
    epoch(make_date(2024, month(o_orderdate), day(o_orderdate)))::BIGINT + clock AS ts,
    epoch(make_date(2023, month(o_orderdate),
      CASE WHEN month(o_orderdate) = 2 THEN least(day(o_orderdate), 28) ELSE day(o_orderdate) END))::BIGINT + clock AS older
  FROM (SELECT *, (o_orderkey % 25) * 3600 + 1800 + o_orderkey % 61 AS clock FROM orders)
)"""

MIXED = f"""
WITH mixed AS ({DUCK_MIXED}),
tried AS (
  SELECT *, regexp_extract(value, {text(WEB_RE)}, {WEB_NAMES}) AS w, regexp_extract(value, {text(AUTH_RE)}, {AUTH_NAMES}) AS a
  FROM mixed WHERE trim(value) <> ''
),
judged AS (
  SELECT source, source_idx, line_no, epoch(try_strptime(w.stamp, '%d/%b/%Y:%H:%M:%S %z'))::BIGINT AS web_ts,
    regexp_extract(w.stamp, ' (\\S+)$', 1) AS zone,
    try_strptime('2024 ' || a.mon || ' ' || a.day || ' ' || a.clock, '%Y %b %d %H:%M:%S') IS NOT NULL AS is_auth,
    row_number() OVER (PARTITION BY source ORDER BY line_no) AS nth
  FROM tried
),
formats AS (
  SELECT source, source_idx::INTEGER AS source_idx,
    arg_min(CASE WHEN web_ts IS NOT NULL THEN 'web' ELSE 'auth' END, line_no)
      FILTER (nth <= 20 AND (web_ts IS NOT NULL OR is_auth)) AS format
  FROM judged GROUP BY source, source_idx
)"""

_PART_RULES = """
WITH specs AS (
  SELECT p_partkey AS k, 'rule' || (p_partkey % 700) AS id,
    CASE WHEN p_partkey % 11 = 0 THEN 'sequence' WHEN p_partkey % 2 = 0 THEN 'threshold' ELSE 'signature' END AS type,
    p_partkey % 5 <> 0 AS enabled, p_partkey % 2 = 0 AS even,
    CASE p_partkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN ' Low ' WHEN 2 THEN 'urgent' END AS severity
  FROM part
),
active AS (SELECT * FROM specs WHERE enabled),
"""
_UNKNOWN_MATCH = (
    "SELECT id, 'unknown match preset ''dns''' AS reason FROM {0} WHERE type = 'threshold' AND k % 3 = 2"
    " UNION ALL SELECT id, 'unknown distinct_by field ''port''' FROM {0} WHERE type = 'threshold' AND k % 8 = 0"
    " UNION ALL SELECT id, 'unknown signature target ''cookie''' FROM {0} WHERE type = 'signature' AND k % 3 = 2"
)
RULE_VIOLATIONS = (
    _PART_RULES
    + f"""faults AS (
  SELECT id, 'unknown rule type ''sequence''' AS reason FROM active WHERE type = 'sequence'
  UNION ALL SELECT id, 'unknown severity ''URGENT''' FROM active WHERE severity = 'urgent'
  UNION ALL {_UNKNOWN_MATCH.format("active")}
  UNION ALL SELECT DISTINCT id, 'unknown parameter ''colour''' FROM active WHERE type = 'threshold' AND k % 14 = 0
  UNION ALL SELECT id, 'threshold must be >= 1' FROM active WHERE type = 'threshold' AND k % 4 < 1
  UNION ALL SELECT id, 'window_seconds must be > 0' FROM active WHERE type = 'threshold' AND k % 9 - 1 <= 0
  UNION ALL SELECT id, 'max_decode_passes must be >= 0' FROM active WHERE type = 'signature' AND k % 13 = 0
  UNION ALL SELECT id, 'bad pattern ''a(b''' FROM active WHERE type = 'signature' AND k % 7 <> 0 AND k % 9 = 0
  UNION ALL SELECT id, 'missing parameter ''patterns''' FROM active WHERE type = 'signature' AND k % 7 = 0
)
SELECT id, reason, count(*) AS n FROM faults GROUP BY id, reason"""
)
RULE_CATALOGUE = """
SELECT min(k)::INTEGER AS pos, id, arg_max(type, k) AS type, arg_max(struct_pack(s := severity), k).s AS severity,
  arg_max(params, k) AS params
FROM (
  SELECT p_partkey AS k, 'rule' || (p_partkey % 700) AS id, p_partkey % 5 <> 0 AS enabled,
    CASE WHEN p_partkey % 11 = 0 THEN 'sequence' WHEN p_partkey % 2 = 0 THEN 'threshold' ELSE 'signature' END AS type,
    CASE p_partkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN ' Low ' WHEN 2 THEN 'urgent' END AS severity,
    CASE WHEN p_partkey % 2 = 0
      THEN '{"match": "' || (['auth_failure', 'web_404', 'dns'])[p_partkey % 3 + 1] || '", "threshold": ' || (p_partkey % 4)
        || ', "window_seconds": ' || (p_partkey % 9 - 1)
        || CASE WHEN p_partkey % 8 = 0 THEN ', "distinct_by": "port"' ELSE '' END
        || CASE WHEN p_partkey % 14 = 0 THEN ', "colour": "red"' ELSE '' END || '}'
      ELSE '{"target": "' || (['path', 'query', 'cookie'])[p_partkey % 3 + 1] || '"'
        || CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 9 = 0 THEN ', "patterns": ["a(b"]'
           ELSE ', "patterns": ["a+"]' END
        || CASE WHEN p_partkey % 13 = 0 THEN ', "max_decode_passes": -1' ELSE '' END || '}' END AS params
  FROM part
) GROUP BY id HAVING arg_max(enabled, k)
"""

ALERT_SPECS = [tuned("sql_injection", min_hits=3), tuned("scanner_user_agent", min_hits=2)]
WEB_VIEW = (
    "source, line_no, ts, source_ip, method, target, path, query, protocol, status, size, identity, user_name, referrer, "
    "user_agent"
)
STATS = """
SELECT source, count(*) AS lines_read, count(*) - count(*) FILTER (trim(value) = '')
    - (SELECT count(*) FROM errors e WHERE e.source = l.source) AS parsed,
  (SELECT count(*) FROM errors e WHERE e.source = l.source) AS malformed,
  count(*) FILTER (trim(value) = '') AS skipped_blank
FROM lines l GROUP BY source"""
TOTALS = (
    "sum(lines_read)::BIGINT AS lines_read, sum(parsed)::BIGINT AS parsed, sum(malformed)::BIGINT AS malformed, "
    "sum(skipped_blank)::BIGINT AS skipped_blank, (SELECT count(*) FROM found) AS findings, "
    "(SELECT count(*) FROM incidents) AS incidents"
)
COUNTED_VIEW = "rule_id, ip AS source_ip, pos, ts, count, front_ts"


def _windows_run(specs: list[dict], columns: str, table: str) -> str:
    return f"{RUN}, {_windows(specs)} SELECT {columns} FROM {table}"


def _rule(spec: dict) -> str:
    return found([spec], f"{FOUND_VIEW}, {'matches' if spec['type'] == 'signature' else 'evidence'}")


ORACLES: dict[str, str] = {
    "read_log_lines": f"""
        SELECT source, dense_rank() OVER (ORDER BY source)::INTEGER - 1 AS source_idx, line_no, value FROM ({DUCK_FILES})""",
    "drop_blank_lines": f"SELECT source, line_no, value FROM ({DUCK_RUN}) WHERE regexp_matches(value, '\\S')",
    "unreadable_sources": """
        SELECT 'missing-' || r_name || '.log' AS source, 0::BIGINT AS line_no, 'missing-' || r_name || '.log' AS raw,
          'missing-' || r_name || '.log' AS reason FROM region""",
    "detect_format": f"{MIXED} SELECT source, source_idx, format FROM formats",
    "skipped_sources": f"{MIXED} SELECT source FROM formats WHERE format IS NULL",
    "build_sources": f"""
        SELECT DISTINCT source, dense_rank() OVER (ORDER BY source)::INTEGER - 1 AS source_idx, format
        FROM ({DUCK_FILES})""",
    "reference_time_anchor": f"""{MIXED},
        last AS (
          SELECT j.source, arg_max(web_ts, line_no) AS ts, arg_max(zone, line_no) AS zone
          FROM judged j JOIN formats f ON j.source = f.source AND f.format = 'web' WHERE web_ts IS NOT NULL GROUP BY j.source
        )
        SELECT max(ts) AS anchor, arg_max(zone, ts) AS utc_offset FROM last""",
    "write_report_tables": f"""{_found(SIGNATURES)}
        SELECT 'report_2024_06_01_12_30_15' AS run_id, rule_id, count(*) AS findings, sum(count)::BIGINT AS hits
        FROM found GROUP BY rule_id""",
    "list_reports": """
        SELECT DISTINCT 'report_' || strftime(o_orderdate, '%Y_%m_%d') || '_' || lpad((o_orderkey % 24)::VARCHAR, 2, '0')
            || '_10_00' AS run_id,
          epoch(date_trunc('day', o_orderdate::TIMESTAMP))::BIGINT + (o_orderkey % 24) * 3600 + 600 AS generated_at
        FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""",
    "list_written_reports": """
        SELECT 'report_2024_06_01_0' || h || '_30_15' AS run_id, 1717200000 + h * 3600 + 1815 AS generated_at,
          (SELECT count(*) FROM events) AS lines_read FROM (VALUES (1), (2), (3)) AS t(h)""",
    "parse_web_log": f"{RUN} SELECT {WEB_VIEW} FROM paths WHERE kind = 'web'",
    "web_timestamp": WEB_STAMPS,
    "split_request": r"""
        SELECT doc_id, CASE WHEN t[1] <> '' THEN t[1] END AS method,
          md5(CASE WHEN len(t) > 3 THEN array_to_string(t[2:len(t) - 1], ' ') WHEN len(t) >= 2 THEN t[2] END) AS target_md5,
          CASE WHEN len(t) >= 3 THEN t[len(t)] END AS protocol
        FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS t FROM documents)""",
    "dash_to_null": f"""{RUN} SELECT source, line_no, source_ip, identity, user_name, status, size, referrer, user_agent
        FROM entries WHERE kind = 'web'""",
    "split_target": r"""
        SELECT page_id, regexp_extract(url, '^([^?]*)', 1) AS path,
          CASE WHEN regexp_matches(url, '\?') THEN regexp_replace(url, '^[^?]*\?', '') END AS query FROM pages""",
    "parse_auth_log": f"{RUN} SELECT source, line_no, ts, hostname, process, pid, message FROM entries WHERE kind = 'auth'",
    "resolve_syslog_year": SYSLOG_YEARS,
    "classify_auth": f"{RUN} SELECT source, line_no, outcome, username FROM entries WHERE kind = 'auth'",
    "extract_ip_port": f"{RUN} SELECT source, line_no, source_ip, source_port FROM entries WHERE kind = 'auth'",
    "parse_errors": f"{RUN} SELECT source, line_no, raw, reason FROM errors",
    "parse_lines": f"""{RUN} SELECT kind, source, line_no, pos, ts, source_ip, target, status, outcome, username, raw
        FROM entries""",
    **{name: f"{RUN} SELECT source, line_no, source_ip FROM paths WHERE {test}" for name, test in _MATCH.items()},
    "distinct_path": f"{RUN} SELECT {_ITEM['path']} AS path, count(*) AS entries FROM paths GROUP BY 1",
    "normal_url": "SELECT page_id, regexp_replace(url || '//', '/+$', '') AS path FROM pages",
    "distinct_username": f"{RUN} SELECT username, count(*) AS entries FROM entries GROUP BY 1",
    "signature_targets": f"""{RUN} SELECT source, line_no, target AS request_target, path, query, user_agent, referrer,
        message AS auth_message FROM paths""",
    "unknown_presets": f"""{_PART_RULES} faults AS ({_UNKNOWN_MATCH.format("specs")}) SELECT id, reason FROM faults""",
    "decode_variants": f"""{RUN}, v AS (
          SELECT source, line_no, target AS v0, url_decode(target) AS v1, url_decode(url_decode(target)) AS v2
          FROM entries WHERE target IS NOT NULL
        )
        SELECT source, line_no, (1 + (v1 <> v0)::INTEGER + (v2 <> v1)::INTEGER)::INTEGER AS forms,
          v0 || CASE WHEN v1 <> v0 THEN ' ' || v1 ELSE '' END || CASE WHEN v2 <> v1 THEN ' ' || v2 ELSE '' END AS variants
        FROM v""",
    "decode_text": """
        SELECT doc_id, CASE WHEN contains(text, ' ') THEN 3 ELSE 1 END AS forms, md5(replace(text, '%', '')) AS last_md5
        FROM documents""",
    "pattern_hits": f"""{RUN}, {_hits([SHIPPED["sql_injection"], SHIPPED["directory_traversal"]])}
        SELECT CASE rule_id WHEN 'sql_injection' THEN 0 ELSE 1 END AS rule, source, line_no, source_ip, pattern, snippet, value
        FROM hits JOIN entries USING (pos)""",
    "signature_findings": found(
        [tuned("sensitive_file_exposure", min_hits=3, max_evidence=2)], f"{FOUND_VIEW}, matches"
    ),
    "capped_evidence": found(
        [tuned("directory_traversal", max_evidence=4)], "rule_id, source_ip, count, evidence"
    ),
    "all_signatures": found(SIGNATURES, f"{FOUND_VIEW}, evidence, matches"),
    **{
        name: _rule(SHIPPED[name])
        for name in (
            "directory_traversal",
            "sql_injection",
            "sensitive_file_exposure",
            "scanner_user_agent",
            "sudo_privilege_escalation",
            "xss_probe",
        )
    },
    "sliding_count": _windows_run([SSH], COUNTED_VIEW, "counted"),
    "sliding_count_event_time": f"""{RUN}, f AS (SELECT * FROM paths WHERE {_MATCH["auth_failure"]})
        SELECT 'ssh_brute_force' AS rule_id, source_ip, pos, (
          SELECT count(*) FROM f j WHERE j.source_ip = f.source_ip AND j.ts >= f.ts - 60
            AND (j.ts < f.ts OR j.ts = f.ts AND j.pos <= f.pos)) AS count
        FROM f""",
    "sliding_distinct_count": _windows_run([SCAN], COUNTED_VIEW, "counted"),
    "burst_segments": _windows_run([SSH, SCAN], "rule_id, ip AS source_ip, pos, burst", "hot"),
    "threshold_findings": found([SSH, LOGIN, SCAN], f"{FOUND_VIEW}, evidence"),
    "ssh_brute_force": _rule(SSH),
    "web_login_brute_force": _rule(LOGIN),
    "web_scanning": _rule(SCAN),
    "credential_stuffing": _rule(STUFFING),
    "all_findings": found(RUN_SPECS, FOUND_VIEW),
    "cap_evidence": found(
        RUN_SPECS,
        "rule_id, emit_pos, count, CASE WHEN matches = '' THEN 0 ELSE least(count, 20) END::INTEGER AS matches, "
        "array_to_string(string_split(evidence, ',')[1:3], ',') AS evidence",
    ),
    "cluster_findings": f"{CLUSTERS} SELECT rule_id, source_ip, emit_pos, cluster FROM clustered",
    "incident_gate": f"""{CLUSTERS}
        SELECT source_ip, cluster, finding_count, rule_ids, sources, first_seen, last_seen FROM gated""",
    "escalate_severity": f"{CLUSTERS} SELECT source_ip, cluster, severity FROM incidents",
    "incident_id": f"{CLUSTERS} SELECT source_ip, cluster, incident_id FROM incidents",
    "iso_stamp": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
        || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN '.' || strftime(ts, '%f') ELSE '' END || '+00:00' AS iso FROM events""",
    "incident_narrative": f"{CLUSTERS} SELECT source_ip, cluster, narrative FROM incidents",
    "incidents": f"{CLUSTERS} SELECT {INCIDENT_VIEW} FROM incidents",
    "incident_findings": f"""{CLUSTERS}
        SELECT incident_id, rule_id, source_ip, emit_pos FROM incidents JOIN clustered USING (source_ip, cluster)""",
    "source_stats": f"{RUN} {STATS}",
    "total_stats": f"""{CLUSTERS}, stats AS ({STATS})
        SELECT {TOTALS} FROM stats""",
    "findings_report": found(
        RUN_SPECS,
        "severity_name, rule_id, title, coalesce(source_ip, '-') AS source_ip, count, replace(sources, ',', ', ') AS sources, "
        "first_seen, last_seen, description, len(string_split(evidence, ','))::INTEGER AS evidence_lines",
    ),
    "severity_counts": f"""{_found(RUN_SPECS)}
        SELECT severity, severity_name, count(*) AS findings FROM found GROUP BY severity, severity_name""",
    "incident_detail": f"""{CLUSTERS}
        SELECT i.incident_id, c.source_ip, c.severity, c.severity_name, c.rule_id, c.title, c.count,
          replace(c.sources, ',', ', ') AS sources, len(string_split(c.evidence, ','))::INTEGER AS evidence_lines, c.emit_pos
        FROM incidents i JOIN clustered c USING (source_ip, cluster)""",
    "evidence_lines": f"""{_found(RUN_SPECS)},
        listed AS (
          SELECT rule_id, source_ip, emit_pos, unnest(string_split(evidence, ',')) AS item,
            generate_subscripts(string_split(evidence, ','), 1)::INTEGER - 1 AS nth FROM found
        )
        SELECT l.rule_id, l.source_ip, l.emit_pos, l.nth, e.source, e.line_no, e.raw
        FROM listed l JOIN entries e ON e.source || ':' || e.line_no = l.item""",
    "parse_error_report": f"{RUN} SELECT source, line_no, reason, raw[1:30] AS raw FROM errors",
    "analyze": f"{CLUSTERS} SELECT {INCIDENT_VIEW} FROM incidents",
    "analyze_files": f"""{_clusters(FILES, 10)}, stats AS ({STATS})
        SELECT {TOTALS} FROM stats""",
    "follow_lines": f"SELECT source, line_no, value FROM ({DUCK_FILES})",
    "assemble_partial_lines": f"""
        SELECT source, nth AS line_no, md5(value) AS value_md5 FROM (
          SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY line_no) AS nth,
            coalesce(sum(length(value) + 1) OVER (PARTITION BY source ORDER BY line_no
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after_it
          FROM ({DUCK_RUN}))
        WHERE after_it >= 9""",
    "assemble_all_lines": f"""
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY line_no) AS line_no, md5(value) AS value_md5,
          line_no = max(line_no) OVER (PARTITION BY source) AS held
        FROM ({DUCK_RUN})""",
    "stream_parse": f"""{RUN}
        SELECT kind, source, line_no, ts, source_ip, NULL AS reason FROM entries
        UNION ALL SELECT 'error', source, line_no, NULL, NULL, reason FROM errors WHERE reason <> 'bad timestamp'
        UNION ALL SELECT 'error', e.source, e.line_no, NULL, coalesce(w.source_ip, a.source_ip), e.reason
          FROM errors e LEFT JOIN web w USING (source, line_no) LEFT JOIN auth a USING (source, line_no)
          WHERE e.reason = 'bad timestamp'
        UNION ALL SELECT 'blank', source, line_no, NULL, NULL, NULL FROM lines WHERE trim(value) = ''""",
    "stream_signatures": f"""{LIVE}, {_hits(ALERT_SPECS)}, {_signature_found(ALERT_SPECS)}
        SELECT rule_id, source_ip, ts, nth AS count, source FROM numbered WHERE nth = min_hits""",
    "stream_thresholds": f"""{LIVE}, {_windows([SSH, SCAN])}
        SELECT rule_id, ip AS source_ip, ts, count, source FROM burst_rows WHERE nth = 1""",
    "live_alerts": f"""{_found(RUN_SPECS, LIVE)}
        SELECT rule_id, title, severity_name, count(*) AS alerts FROM found GROUP BY ALL""",
    "live_alert_rows": f"""{_found(RUN_SPECS, LIVE)}
        SELECT rule_id, source_ip, ts, nth AS count, source FROM numbered WHERE nth = min_hits
        UNION ALL SELECT rule_id, ip, ts, count, source FROM burst_rows WHERE nth = 1""",
    "finalize_stream": found(RUN_SPECS, "rule_id, source_ip, first_seen, last_seen, count, sources", LIVE),
    "late_data": f"""{LIVE}
        SELECT source, count(*) AS entries, count(*) FILTER (late) AS late_entries FROM (
          SELECT source, EXISTS (SELECT 1 FROM paths b WHERE b.source = a.source AND b.seq < a.seq AND b.ts > a.ts) AS late
          FROM paths a) GROUP BY source""",
    "rule_catalogue": RULE_CATALOGUE,
    "rule_violations": RULE_VIOLATIONS,
    "register_rule": f"""{RUN}
        SELECT 'big_transfer' AS rule_id, 'Big Transfer' AS title, source_ip, 40 AS severity, sum(size)::BIGINT AS count
        FROM entries WHERE kind = 'web' GROUP BY source_ip HAVING sum(size) > {BIG["params"]["limit"]}""",
    "live_rule": f"""{LIVE}
        SELECT 'big_transfer' AS rule_id, source_ip, 1::BIGINT AS alerts, sum(size)::BIGINT AS total
        FROM entries WHERE kind = 'web' GROUP BY source_ip HAVING sum(size) > {BIG["params"]["limit"]}""",
    "rule_failures": f"""{RUN}
        SELECT 'broken' AS rule_id, 'broken' AS type,
          (SELECT count(*) FROM (SELECT source_ip FROM entries WHERE kind = 'web' GROUP BY source_ip HAVING sum(size) > {BIG["params"]["limit"]})) AS findings,
          (SELECT count(*) FROM lines) AS lines_read""",
    "rule_isolation": f"""{_found([SHIPPED["sql_injection"]])}
        SELECT rule_id, count(*) AS findings, sum(count)::BIGINT AS total FROM found GROUP BY rule_id
        UNION ALL SELECT 'big_transfer', count(*), sum(total)::BIGINT FROM (
          SELECT sum(size) AS total FROM entries WHERE kind = 'web' GROUP BY source_ip
          HAVING sum(size) > {BIG["params"]["limit"]})""",
}
