"""Lines to typed entries: one wide table for both formats, bad lines kept beside it."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.functions import fields as X
from logwarden.functions import patterns as P
from logwarden.schema import POS_LINE_BITS

ENTRY_COLUMNS = [
    "kind", "ts", "source", "source_idx", "line_no", "pos", "raw", "source_ip",
    "method", "target", "path", "query", "protocol", "status", "size", "identity", "user", "referrer", "user_agent",
    "hostname", "process", "pid", "message", "outcome", "username", "source_port",
]
WEB_COLUMNS = ENTRY_COLUMNS[1:19]
AUTH_COLUMNS = ENTRY_COLUMNS[1:8] + ENTRY_COLUMNS[19:]


def _anchor(reference_time: datetime | None, default_year: int | None, tz: timezone) -> tuple[int, str]:
    """(year to try first, latest allowed moment in microseconds); the year is read in the anchor's own offset."""
    if default_year is not None:
        return default_year, "cast(NULL AS BIGINT)"
    moment = reference_time if reference_time is not None else datetime.now(tz)
    moment = moment if moment.tzinfo is not None else moment.replace(tzinfo=tz)
    age = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
    micros = (age.days * 86_400 + age.seconds) * 1_000_000 + age.microseconds
    return moment.year, f"{micros}L"


def _matched(pattern: str, groups: int) -> str:
    """All groups of a matching line from a single regex pass; one element if it does not match."""
    listed = lambda text: f"split(regexp_replace({text}, {X.regex(pattern)}, '{P.group_list(groups)}'), '{P.SEPARATOR}', -1)"
    # A line that holds the separator is matched with it escaped, and its groups are restored.
    restored = f"transform({listed(P.escaped('raw'))}, x -> {P.restored('x')})"
    return f"if(contains(raw, '{P.SEPARATOR}'), {restored}, {listed('raw')})"


def parse_lines(
    lines: DataFrame,
    *,
    reference_time: datetime | None = None,
    default_year: int | None = None,
    tz: timezone = timezone.utc,
) -> DataFrame:
    """Parse every line of ``lines`` (with its ``format``, ``web`` or ``auth``).

    Keeps all lines. ``pos`` is their arrival order: source position, then line number, unless
    the lines bring their own; sources or lines too many for that are an error. ``kind`` is ``web`` or ``auth`` for an entry, ``error`` for a line that
    does not parse (``reason`` says why) and ``blank`` for a blank one. Syslog stamps, which name no
    zone, are read in ``tz``.
    """
    year, latest = _anchor(reference_time, default_year, tz)
    east = int(tz.utcoffset(None).total_seconds())
    groups = (
        f"CASE WHEN {X.is_blank('raw')} THEN NULL "
        f"WHEN format = 'web' THEN {_matched(P.WEB_LINE, P.WEB_GROUPS)} ELSE {_matched(P.AUTH_LINE, P.AUTH_GROUPS)} END"
    )
    # The generator keeps filters on parsed fields above it, so the regex runs once per line.
    packed = (
        f"CASE WHEN source_idx >= {1 << 63 - POS_LINE_BITS} OR line_no >= {1 << POS_LINE_BITS}L "
        "THEN raise_error(concat('no place for line ', line_no, ' of source ', source_idx, ': give the lines a pos of their own')) "
        f"ELSE shiftleft(cast(source_idx AS BIGINT), {POS_LINE_BITS}) + line_no END AS pos"
    )
    pos = "pos" if "pos" in lines.columns else packed
    grouped = lines.selectExpr(
        "source", "source_idx", "line_no", "format", pos, r"rtrim('\n', make_valid_utf8(value)) AS raw"
    ).selectExpr("*", f"explode(array({groups})) AS g")

    either = lambda web, auth: f"get(g, if(web, {web}, {auth}))"
    web = lambda expr: f"if(web, {expr}, NULL)"
    auth = lambda expr: f"if(auth, {expr}, NULL)"
    # A number beyond a long integer is an error of its line; none becomes 0 or NULL unseen.
    beyond = lambda i, none: f"(get(g, {i}) <> '{none}' AND try_cast(get(g, {i}) AS BIGINT) IS NULL)"
    timed = grouped.selectExpr(
        "*", "size(g) > 1 AND format = 'web' AS web", "size(g) > 1 AND format <> 'web' AS auth"
    ).selectExpr(
        "*",
        f"{X.day_number(f'if(web, get(g, 5), \'{year:04d}\')', either(4, 0), either(3, 1))} AS day_no",
        f"{X.day_second(either(6, 2), either(7, 3), either(8, 4))} AS day_second",
        "if(web, get(g, 9), NULL) AS utc_offset",
        f"{X.offset_digits('if(web, get(g, 9), NULL)')} AS offset_digits",
        f"{X.request_tokens('if(web, get(g, 10), NULL)')} AS tokens",
        f"{web("try_cast(nullif(get(g, 11), '-') AS BIGINT)")} AS status",
        f"{web("coalesce(try_cast(nullif(get(g, 12), '-') AS BIGINT), 0L)")} AS size",
        f"{web(f"{beyond(11, '-')} OR {beyond(12, '-')}")} AS web_beyond",
    )
    moment = "(day_no * 86400L + day_second)"
    found = [
        f"timestamp_seconds(if(web, {moment} - {X.offset_seconds('utc_offset', 'offset_digits')}, "
        f"if(({moment} - {east}L) * 1000000L > {latest}, {X.year_before('day_no')} * 86400L + day_second, {moment}) - {east}L)) AS ts",
        f"{X.request_target('tokens')} AS target",
        "if(auth, get(g, 8), NULL) AS message",
        *X.auth_parts("if(auth, get(g, 8), NULL)"),
    ]
    # Generated code of the whole would be one method too large (8,000 bytes) for the JVM to compile and run
    # interpreted. The lambda ends a code block here, which leaves two small ones; tests/test_code_size.py watches them.
    split = timed.selectExpr(
        "source", "source_idx", "line_no", "format", "pos", "raw", "g", "web", "auth", "tokens", "status", "size", "web_beyond",
        f"inline(filter(array(struct({', '.join(found)})), f -> f IS NOT NULL))",
    )
    too_large = f"coalesce(if(web, web_beyond, {beyond(7, '')} OR {X.port_beyond()}), false)"
    pair = lambda i: f"if(web AND get(g, 13) <> '', get(g, {i}), NULL)"
    columns = {
        "kind": f"CASE WHEN g IS NULL THEN 'blank' WHEN ts IS NULL OR {too_large} THEN 'error' ELSE format END",
        "source_ip": f"if(web, {X.dash_to_null('get(g, 0)')}, {X.auth_ip()})",
        "method": X.request_method("tokens"),
        "path": X.target_path("target"),
        "query": X.target_query("target"),
        "protocol": X.request_protocol("tokens"),
        "identity": web(X.dash_to_null("get(g, 1)")),
        "user": web(X.dash_to_null("get(g, 2)")),
        "referrer": pair(14),
        "user_agent": pair(15),
        "hostname": auth("get(g, 5)"),
        "process": auth("get(g, 6)"),
        "pid": auth("try_cast(nullif(get(g, 7), '') AS BIGINT)"),
        "outcome": X.auth_outcome("message"),
        "username": X.auth_username("message"),
        "source_port": X.auth_port(),
        "reason": (
            f"CASE WHEN g IS NULL OR ts IS NOT NULL AND NOT {too_large} THEN NULL WHEN ts IS NOT NULL THEN '{P.TOO_LARGE}' "
            f"WHEN size(g) > 1 THEN '{P.BAD_STAMP}' WHEN format = 'web' THEN '{P.NOT_WEB}' ELSE '{P.NOT_AUTH}' END"
        ),
    }
    return split.selectExpr(*[f"{columns[c]} AS {c}" if c in columns else c for c in [*ENTRY_COLUMNS, "reason"]])


def parse_web_log(lines: DataFrame) -> DataFrame:
    """Entries of access-log lines (Common or Combined)."""
    parsed = parse_lines(lines.withColumn("format", F.lit("web")))
    return parsed.where("kind = 'web'").select(*WEB_COLUMNS)


def parse_auth_log(
    lines: DataFrame,
    *,
    reference_time: datetime | None = None,
    default_year: int | None = None,
    tz: timezone = timezone.utc,
) -> DataFrame:
    """Entries of BSD syslog auth lines."""
    parsed = parse_lines(
        lines.withColumn("format", F.lit("auth")), reference_time=reference_time, default_year=default_year, tz=tz
    )
    return parsed.where("kind = 'auth'").select(*AUTH_COLUMNS)


def entries_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("kind IN ('web', 'auth')").select(*ENTRY_COLUMNS)


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Every non-blank line that did not parse, with the reason."""
    return parsed.where("kind = 'error'").select("source", "line_no", "raw", "reason")
