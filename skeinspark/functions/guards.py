"""What stands between untrusted text, addresses and paths and whoever reads them: text guards as column expressions, the others on the driver."""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How characters of markup are spelt, marks that a reader could take for its own, and hosts that serve credentials.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
SENTINELS = ("<|", "|>", "</", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CREDENTIAL_HOSTS = ("169.254.169.254", "169.254.170.2", "metadata.google.internal", "metadata")
CONTROL = r"[\x00-\x1F\x7F]"


class Refused(ValueError):
    """An address or a path that must not be used."""


def escaped(c: Column) -> Column:
    for mark, spelt in ESCAPES:
        c = F.replace(c, F.lit(mark), F.lit(spelt))
    return c


def _cut(c: Column, most: int) -> Column:
    return F.when(F.char_length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def sanitize_label(c: Column, most: int = 256) -> Column:
    """One line without control characters, cut, then escaped; null is empty."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), CONTROL, " "), r"(?U)\s+", " "))
    return escaped(_cut(line, most))


def sanitize_agent_text(c: Column, most: int = 2000) -> Column:
    """Line ends kept, other control characters as blanks, sentinels broken by an empty space, escaped, then cut."""
    text = F.regexp_replace(F.translate(F.coalesce(c.cast("string"), F.lit("")), "\r", "\n"), r"[\x00-\x09\x0B-\x1F\x7F]", " ")
    for mark in SENTINELS:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\u200b" + mark[1:]))
    return _cut(escaped(text), most)


def _addresses(host: str) -> list[str]:
    if host in ("localhost", "localhost.localdomain"):
        return ["127.0.0.1", "::1"]
    return sorted({found[4][0] for found in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)})


def validate_url(url: str, allow_loopback: bool = False, resolve: Callable[[str], list[str]] = _addresses) -> str:
    """The address if it is of the web and every host it stands for is public."""
    parts = urlsplit(url.strip())
    host = (parts.hostname or "").rstrip(".").casefold()
    if parts.scheme not in ("http", "https") or not host or host in CREDENTIAL_HOSTS:
        raise Refused(f"not an address that may be read: {url}")
    try:
        found = [ipaddress.ip_address(host)]
    except ValueError:
        try:
            found = [ipaddress.ip_address(a) for a in resolve(host)]
        except OSError as e:
            raise Refused(f"no such host: {host}") from e
    for a in found:
        local = a.is_loopback and allow_loopback
        if not local and (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified):
            raise Refused(f"{url} leads to {a}")
    if not found:
        raise Refused(f"no such host: {host}")
    return url


def validate_path(path: str, roots: list[str], must_exist: bool = False) -> Path:
    """The path, made absolute, if it is under one of the roots."""
    if not path.strip() or "\x00" in path or "://" in path:
        raise Refused(f"not a local path: {path!r}")
    whole = Path(path).expanduser().resolve()
    if must_exist and not whole.exists():
        raise Refused(f"no such path: {whole}")
    if not any(whole.is_relative_to(Path(root).expanduser().resolve()) for root in roots):
        raise Refused(f"{whole} is outside of what may be read")
    return whole
