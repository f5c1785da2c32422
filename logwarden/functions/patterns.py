"""Regular expressions of the two log formats and of auth messages.

``(?d)``: only a newline ends a line. ``(?U)``: Unicode classes. ``WS`` adds the four
ASCII separators that count as white space in log text but not in Java.
"""

from __future__ import annotations

WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"
BLANK = rf"(?dU)^{WS}*$"

# Month names, and the layout of access-log and syslog lines.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_HOUR_OFFSET = r"[+-](?:[01][0-9]|2[0-3])"
_MINUTE_OFFSET = r"(?:[0-5][0-9](?:[0-5][0-9])?|:[0-5][0-9](?::[0-5][0-9])?)"

# Groups 4-10 are filled only by a stamp that reads as a date, so one pass tells a line of
# another shape (no match at all) from a line with a bad stamp (group 4 empty).
WEB_LINE = (
    "(?dU)^"
    rf"({NOT_WS}+){WS}+({NOT_WS}+){WS}+({NOT_WS}+){WS}+"
    r"\[(?:"
    r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])/"
    r"((?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))/"
    r"([0-9]{4}):(2[0-3]|[01][0-9]|[0-9]):([0-5][0-9]|[0-9]):([0-5][0-9]|[0-9])"
    rf"{WS}+({_HOUR_OFFSET}{_MINUTE_OFFSET}|Z)"
    r"|[^\]]+)\]"
    rf'{WS}+"([^"]*)"{WS}+(\d{{3}}|-){WS}+(\d+|-)'
    rf'({WS}+"([^"]*)"{WS}+"([^"]*)")?{WS}*$'
)
WEB_GROUPS = 16

AUTH_LINE = (
    "(?dU)^"
    rf"([A-Z][a-z]{{2}}){WS}+([0-9]{{1,2}}){WS}+([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}}){WS}+"
    rf"({NOT_WS}+){WS}+([^\[\s\x1c-\x1f:]+)(?:\[(\d+)\])?:{WS}*(.*)$"
)
AUTH_GROUPS = 9

FROM_IP = rf"(?dU)\bfrom{WS}+(\d{{1,3}}(?:\.\d{{1,3}}){{3}})(?:{WS}+port{WS}+(\d+))?"
ANY_IP = r"(?dU)\b(\d{1,3}(?:\.\d{1,3}){3})\b"
ANY_PORT = rf"(?dU)\bport{WS}+(\d+)"
INVALID_USER = rf"(?iudU)invalid user{WS}+({NOT_WS}+)"
FAILED_PASSWORD = rf"(?iudU)Failed password for (?:invalid user{WS}+)?({NOT_WS}+){WS}+from"
ACCEPTED = rf"(?iudU)Accepted {NOT_WS}+ for ({NOT_WS}+){WS}+from"

# Reasons and prefixes of parse errors.
NOT_WEB = "does not match Combined log format"
NOT_AUTH = "does not match BSD syslog format"
TOO_LARGE = "number too large"
BAD_STAMP = "bad timestamp"


#: A code point that Unicode sets aside as no character; a line that holds it all the same is matched with it escaped.
SEPARATOR = "\uffff"
_ESCAPE = "\ufffe"


def escaped(text: str) -> str:
    """SQL: the text without the separator. The signs used instead are white space, digit or quote to no pattern, as it is itself."""
    return f"replace(replace({text}, '{_ESCAPE}', '{_ESCAPE}e'), '{SEPARATOR}', '{_ESCAPE}s')"


def restored(text: str) -> str:
    """SQL: undoes ``escaped``; every escape sign is followed by one of two letters, so no other pair looks like one."""
    return f"replace(replace({text}, '{_ESCAPE}s', '{SEPARATOR}'), '{_ESCAPE}e', '{_ESCAPE}')"


def group_list(count: int) -> str:
    """Replacement text that lists all groups, with a separator that is no character of any text between them."""
    return SEPARATOR.join(f"${i}" for i in range(1, count + 1))
