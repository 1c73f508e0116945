"""Masking of secrets in text and attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# Keys whose values are secrets, lower case without separators.
KEYS = ("authorization", "auth", "cookie", "setcookie", "password", "passwd", "pwd", "secret", "token", "apikey", "accesskey", "privatekey", "credential", "session", "connectionstring", "dbconnectionstring", "xapikey")

# Patterns of secrets and what stands in for them.
PATTERNS = (
    (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{0,20000}(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", "[REDACTED PRIVATE KEY]"),
    (r"(?i)\b(Bearer)[ \t]{1,10}[A-Za-z0-9._~+/=-]{8,65536}", "$1 " + REDACTED),
    (r"\bBasic[ \t]{1,10}[A-Za-z0-9+/=]{8,65536}", "Basic " + REDACTED),
    (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{5,65536}\.[A-Za-z0-9_-]{5,65536}\.[A-Za-z0-9_-]{0,65536}", REDACTED),
    (r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", REDACTED),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,255}", REDACTED),
    (r"\bgithub_pat_[A-Za-z0-9_]{20,255}", REDACTED),
    (r"\bxox[abprs]-[A-Za-z0-9-]{10,255}", REDACTED),
    (r"\bsk-[A-Za-z0-9_-]{20,255}", REDACTED),
    (r"(?i)\b([a-z][a-z0-9+.-]{0,30}://[^\s:/?#@]{1,256}):[^\s/?#@]{1,256}@", "$1:" + REDACTED + "@"),
)


def _normal(key: str) -> str:
    return re.sub(r"[\s._-]", "", key.lower())


def _key_pattern(extra: tuple[str, ...]) -> str:
    """A key of 64 signs at most that holds one of the words, whatever separators stand in it; "tokens" is no "token"."""
    apart = r"[._-]*"
    words = [apart.join(map(re.escape, k)) + (r"(?!" + apart + "s)" if k == "token" else "") for k in dict.fromkeys((*KEYS, *map(_normal, extra))) if k]
    return rf"(?=[A-Za-z][\w.-]{{0,63}}[\"']?[ \t]{{0,3}}[=:])(?=[\w.-]{{0,63}}?(?:{'|'.join(words)}))[A-Za-z][\w.-]{{0,63}}"


def redact_text(text: Column, extra_keys: tuple[str, ...] = ()) -> Column:
    """Text with secrets masked: known formats first, then the values of key=value and key: value pairs."""
    for pattern, mask in PATTERNS:
        text = F.regexp_replace(text, pattern, mask)
    pair = rf"(?i)(^|[?&;,\s{{(\"'])({_key_pattern(extra_keys)})([\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?)[^\s;,&\"'}}]{{1,65536}}"
    return F.regexp_replace(text, pair, "$1$2$3" + REDACTED)


def is_sensitive_key(key: Column, extra_keys: tuple[str, ...] = ()) -> Column:
    normal = F.regexp_replace(F.lower(key), r"[\s._-]", "")
    words = [k for k in dict.fromkeys((*KEYS, *map(_normal, extra_keys))) if k and k != "token"]
    return normal.rlike("|".join(map(re.escape, words))) | F.replace(normal, F.lit("tokens"), F.lit("")).contains("token")


def redact_attrs(attrs: Column, extra_keys: tuple[str, ...] = ()) -> Column:
    """The map with the values of sensitive keys blanked and the other values masked like text."""
    return F.transform_values(attrs, lambda k, v: F.when(is_sensitive_key(k, extra_keys), F.lit(REDACTED)).otherwise(redact_text(v, extra_keys)))
