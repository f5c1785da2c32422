"""SQL expressions that turn the groups of a matched line into typed fields.

Each function takes SQL expressions (mostly column names) and returns one.
"""

from __future__ import annotations

from logwarden.functions import patterns as P


def regex(pattern: str) -> str:
    """SQL literal of one of the patterns, none of which holds a single quote."""
    return f"r'{pattern}'"


def is_blank(value: str) -> str:
    return f"{value} rlike {regex(P.BLANK)}"


def dash_to_null(value: str) -> str:
    return f"nullif({value}, '-')"


def day_number(year: str, month_name: str, day: str) -> str:
    """Days since 1970-01-01 of a date with an English month in any case, NULL if there is no such date."""
    month = f"(instr('{P.MONTHS}', lower({month_name})) + 3) div 4"
    date = f"try_cast(concat({year}, '-', {month}, '-', trim({day})) AS DATE)"
    return f"if({year} > '0000' AND {month} > 0, unix_date({date}), NULL)"


def day_second(hour: str, minute: str, second: str) -> str:
    """Seconds since midnight, NULL if there is no such moment (second 60 is not one)."""
    h, m, s = (f"try_cast(nullif({part}, '') AS INT)" for part in (hour, minute, second))
    return f"if({h} < 24 AND {m} < 60 AND {s} < 60, {h} * 3600 + {m} * 60 + {s}, NULL)"


def year_before(day_no: str) -> str:
    """The same day a year earlier; 29 February becomes the 28th where that year lacks it."""
    return f"unix_date(add_months(date_from_unix_date({day_no}), -12))"


def offset_digits(offset: str) -> str:
    """HHMM or HHMMSS of ``+HHMM``, ``+HH:MM`` and the like; ``Z`` stays."""
    return f"regexp_replace({offset}, '[:+-]', '')"


def offset_seconds(offset: str, digits: str) -> str:
    """Seconds east of UTC; 0 for ``Z``. No cast is made that would fail, as that is slow."""
    part = lambda start: f"cast(substr({digits}, {start}, 2) AS BIGINT)"
    size = f"({part(1)} * 3600L + {part(3)} * 60L + if(length({digits}) > 4, {part(5)}, 0L))"
    return f"if({offset} IN ('', 'Z', '+0000'), 0L, if(startswith({offset}, '-'), -1L, 1L) * {size})"


def request_tokens(request: str) -> str:
    trimmed = f"regexp_replace({request}, {regex(f'(?dU)^{P.WS}+|{P.WS}+$')}, '')"
    return f"split({trimmed}, {regex(f'(?U){P.WS}+')})"


def request_method(tokens: str) -> str:
    return f"nullif(get({tokens}, 0), '')"


def request_target(tokens: str) -> str:
    """Second token; with more than three, all between first and last joined by one space."""
    return (
        f"CASE WHEN size({tokens}) > 3 THEN array_join(slice({tokens}, 2, size({tokens}) - 2), ' ') "
        f"ELSE get({tokens}, 1) END"
    )


def request_protocol(tokens: str) -> str:
    return f"CASE WHEN size({tokens}) >= 3 THEN get({tokens}, size({tokens}) - 1) END"


def target_path(target: str) -> str:
    return f"substring_index({target}, '?', 1)"


def target_query(target: str) -> str:
    return f"CASE WHEN contains({target}, '?') THEN substr({target}, instr({target}, '?') + 1) END"


def auth_parts(message: str) -> list[str]:
    """What the auth patterns find in a message, each searched for once; '' for nothing found.

    Columns ``failed_user, accepted_user, named_user, from_ip, from_port, any_ip, any_port``.
    """
    find = lambda pattern, group, name: f"regexp_extract({message}, {regex(pattern)}, {group}) AS {name}"
    return [
        find(P.FAILED_PASSWORD, 1, "failed_user"),
        find(P.ACCEPTED, 1, "accepted_user"),
        find(P.INVALID_USER, 1, "named_user"),
        find(P.FROM_IP, 1, "from_ip"),
        find(P.FROM_IP, 2, "from_port"),
        find(P.ANY_IP, 1, "any_ip"),
        find(P.ANY_PORT, 1, "any_port"),
    ]


def auth_ip() -> str:
    """Address of the ``from`` clause, else the first one anywhere."""
    return "coalesce(nullif(from_ip, ''), nullif(any_ip, ''))"


_PORT = "CASE WHEN from_ip <> '' THEN from_port WHEN any_ip <> '' THEN any_port END"


def auth_port() -> str:
    """Port of the ``from`` clause if there is one, else any port if there is any address."""
    return f"try_cast(nullif({_PORT}, '') AS BIGINT)"


def port_beyond() -> str:
    """Whether there is a port that no long integer holds."""
    return f"(nullif({_PORT}, '') IS NOT NULL AND {auth_port()} IS NULL)"


def auth_outcome(message: str) -> str:
    return (
        "CASE WHEN failed_user <> '' THEN if(named_user <> '', 'invalid_user', 'failure') "
        "WHEN accepted_user <> '' THEN 'success' "
        f"WHEN named_user <> '' AND startswith(lower({message}), 'failed') THEN 'invalid_user' "
        f"WHEN {message} IS NOT NULL THEN 'other' END"
    )


def auth_username(message: str) -> str:
    return (
        "CASE WHEN failed_user <> '' THEN failed_user WHEN accepted_user <> '' THEN accepted_user "
        f"WHEN named_user <> '' AND startswith(lower({message}), 'failed') THEN named_user END"
    )
