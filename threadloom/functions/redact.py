"""Secrets and home folders taken out of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import trimmed

MARK = "[REDACTED]"
#: White space and word limits of all scripts, and letters of either case in all of them.
UNICODE = "(?Uu)"
# The names that hold secrets and the forms that secrets and home folders have.
KEYS = r"(?:x-api-key|api[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|session[_-]?token|token|secret|password|passwd|cookie)"
SECRET_NAMES = ("api_key", "apikey", "access_token", "auth_token", "refresh_token", "session_token", "token", "secret", "password", "passwd", "cookie", "authorization", "bearer")
JWT = r"\b[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}\b"
BEARER = r"(?i)\b(Bearer\s+)([A-Za-z0-9._~+/\-=]{12,})"
QUOTED = r"(?i)(\b" + KEYS + r"\b\s*[:=]\s*)([\"'])([^\"'\r\n]{4,})[\"']"
BARE = r"(?i)(\b" + KEYS + r"\b\s*[:=]\s*)([A-Za-z0-9._~+/\-=]{8,})"
VENDOR = r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{16,}|rk-[A-Za-z0-9_-]{16,}|glpat-[A-Za-z0-9_-]{16,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{20,}|AKIA[0-9A-Z]{16})\b"  # noqa: E501
HOME = r"(^|[\s`\"'(])/(?:Users|home)/[^/\s`\"'()]+((?:/[^\s`\"'()]+)*)"


#: What a text with a secret holds, as far as plain ASCII tells: a token's prefix, or a long run before a full stop.
ANCHORS = r"gh[pousr]_|github_pat_|[sr]k-|glpat-|xox[baprs]-|AIza|AKIA|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+\."


def _suspect(text: Column) -> Column:
    """Whether a text can hold a secret at all: a name needs a colon or an equals sign after it, all other forms an anchor."""
    named = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    return named | F.contains(F.lower(text), F.lit("bearer")) | F.rlike(text, F.lit(ANCHORS))


def secrets(text: Column) -> Column:
    """Values that look like secrets replaced; names, prefixes and quotes stay.

    Only texts that one cheap look finds suspect are searched with the patterns of all scripts.
    """
    return F.when(_suspect(text), _without_secrets(text)).otherwise(text)


def _without_secrets(text: Column) -> Column:
    for pattern, put in ((JWT, MARK), (BEARER, "$1" + MARK), (QUOTED, "$1$2" + MARK + "$2"), (BARE, "$1" + MARK), (VENDOR, MARK)):
        text = F.regexp_replace(text, UNICODE + pattern, put)
    return text


def home_paths(text: Column, home: str | None = None) -> Column:
    """Home folders written as ``~``; ``home`` is a further one."""
    if home and home != "/":
        text = F.replace(text, F.lit(home), F.lit("~"))
    return F.regexp_replace(text, UNICODE + HOME, "$1~$2")


def human(text: Column, home: str | None = None) -> Column:
    """What a person is shown: without secrets and home folders."""
    return home_paths(secrets(text), home)


def is_secret_name(name: Column) -> Column:
    """Whether a field of this name holds a secret, whatever its value looks like."""
    plain = F.btrim(trimmed(name), F.lit("\"'"))
    return F.replace(F.lower(plain), F.lit("-"), F.lit("_")).isin(*SECRET_NAMES)


def json_values(fields: Column) -> Column:
    """A map of text fields with the values of secret names, and secrets in other values, replaced.

    Values are handled before the map is made JSON, so escapes cannot hide a secret.
    """
    return F.transform_values(fields, lambda k, v: F.when(v.isNull(), v).when(is_secret_name(k), F.lit(MARK)).otherwise(secrets(v)))
