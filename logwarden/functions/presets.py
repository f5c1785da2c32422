"""The names a rule may use for what it matches, counts and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.fields import target_path, target_query


def auth_failure() -> Column:
    return F.expr("kind = 'auth' AND outcome IN ('failure', 'invalid_user')")


def web_login_failure() -> Column:
    return F.expr("kind = 'web' AND status IN (401, 403) AND contains(lower(path), 'login')")


def web_404() -> Column:
    return F.expr("kind = 'web' AND status = 404")


def normal_path(path: str) -> str:
    """Path without its trailing slashes, except for the root itself."""
    return f"CASE WHEN length({path}) > 1 THEN coalesce(nullif(rtrim('/', {path}), ''), '/') ELSE {path} END"


def distinct_path() -> Column:
    return F.expr(f"CASE WHEN kind = 'web' THEN {normal_path('path')} END")


def distinct_username() -> Column:
    return F.expr("CASE WHEN kind = 'auth' THEN username END")


# Preset names.
MATCHES = {"auth_failure": auth_failure, "web_login_failure": web_login_failure, "web_404": web_404}
DISTINCTS = {"path": distinct_path, "username": distinct_username}
TARGETS = {
    "request_target": lambda: F.col("target"),
    "path": lambda: F.expr(target_path("target")),
    "query": lambda: F.expr(target_query("target")),
    "user_agent": lambda: F.col("user_agent"),
    "referrer": lambda: F.col("referrer"),
    "auth_message": lambda: F.col("message"),
}
KINDS = {
    "match": ("match preset", MATCHES),
    "distinct_by": ("distinct_by field", DISTINCTS),
    "target": ("signature target", TARGETS),
}
