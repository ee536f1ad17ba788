"""URL functions as column expressions; those that decode bytes are Arrow-batched."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNRESERVED = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~")
_RESERVED = set(b"!*'();:@&=+$,/?%#[]")


def protocol(url: Column) -> Column:
    """What stands before ://, else empty."""
    return F.regexp_extract(url, "(?s)^(.*?)://", 1)


def extension(url: Column, most: int = 16) -> Column:
    """After the last dot before the question mark, in upper case, at most so long, up to a comma; empty without a dot."""
    head = F.substring_index(url, "?", 1)
    ext = F.when(F.instr(head, ".") > 0, F.substring_index(head, ".", -1)).otherwise(F.lit(""))
    return F.substring_index(F.upper(F.substring(ext, 1, most)), ",", 1)


def short_name(url: Column) -> Column:
    """The file's name without its extension."""
    name = F.substring_index(F.substring_index(url, "?", 1), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def host(url: Column) -> Column:
    return F.substring_index(_authority(url), ":", 1)


def _rest(url: Column) -> Column:
    return F.regexp_replace(url, "^(http://|https://|rtmp://)", "")


def _authority(url: Column) -> Column:
    return F.substring_index(_rest(url), "/", 1)


def port(url: Column) -> Column:
    """The number after the host's colon (0 if it is none), else 443 for https and 80 for all others."""
    named = F.regexp_extract(_authority(url), r"^[^:]*:\s*([0-9]*)", 1)
    given = F.instr(_authority(url), ":") > 0
    return F.when(given, F.coalesce(F.expr("1") * F.when(named != "", named.cast("int")), F.lit(0))).otherwise(F.when(url.startswith("https://"), 443).otherwise(80)).cast("int")


def domain(url: Column) -> Column:
    """The value of the parameter domain, else empty."""
    return F.regexp_extract(url, r"[?&]domain=([^&]*)", 1)


def path(url: Column) -> Column:
    """What follows the first slash after the host, without that slash and without the parameter domain."""
    rest = _rest(url)
    at = F.instr(rest, "/")
    raw = F.when(at > 0, F.substring(rest, at + 1, F.length(rest))).otherwise(F.lit(""))
    first = F.regexp_replace(raw, r"\?domain=[^&]*&", "?")
    return F.regexp_replace(first, r"[?&]domain=[^&]*", "")


def fragment_free(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def split_url(url: Column) -> Column:
    """scheme, host, ipv6, port, path, query, fragment; null as a whole where the URL has no scheme, an unclosed IPv6
    host, or a port that is empty or no number. A missing path is /."""
    m = r"^([^:/?#]+)://(?:\[([^\]]*)\]|([^:/?#\[]*))(?::([0-9]+))?(?=[/?#]|$)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda i: F.regexp_extract(url, m, i)
    six = part(2)
    made = F.struct(part(1).alias("scheme"), F.when(six != "", six).otherwise(part(3)).alias("host"), (six != "").alias("ipv6"), F.when(part(4) != "", part(4).cast("int")).alias("port"), F.when(part(5) != "", part(5)).otherwise("/").alias("path"), part(6).alias("query"), part(7).alias("fragment"))
    return F.when(url.rlike(m), made)


def percent_encode(text: str) -> str:
    return "".join(chr(b) if b in _UNRESERVED else f"%{b:02X}" for b in text.encode())


def percent_decode_strict(text: str) -> str:
    """Decodes until the first bad escape or illegal byte, and leaves out the rest."""
    data, out, i = text.encode(), bytearray(), 0
    while i < len(data):
        b = data[i]
        if b == 0x25:
            pair = data[i + 1 : i + 3]
            if len(pair) < 2 or not re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
                break
            out.append(int(pair, 16))
            i += 3
        elif b in _UNRESERVED or b in _RESERVED:
            out.append(b)
            i += 1
        else:
            break
    return out.decode(errors="replace")


def percent_decode_lenient(text: str) -> str:
    """A bad escape stays as it is; + is a space."""
    data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.replace("+", " ").encode())
    return data.decode(errors="replace")


def _mapped(name: str, one):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    run.__name__ = name
    return run


escape = _mapped("escape", percent_encode)
unescape = _mapped("unescape", percent_decode_strict)
unescape_lenient = _mapped("unescape_lenient", percent_decode_lenient)


def resolve(base: Column, link: Column) -> Column:
    """The link itself if it has a scheme; after the host if it begins with a slash; else after the base's last slash."""
    root = F.regexp_extract(base, "^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^(.*/)[^/]*$", "$1")
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(protocol(base), F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(folder, link))


def is_ipv4(text: Column) -> Column:
    byte = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return text.rlike(rf"^{byte}(\.{byte}){{3}}$")


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).cast("long")
    return F.when(is_ipv4(text), number)


def escape_non_ascii(url: Column) -> Column:
    """Percent escapes for all that is not ASCII; the rest stays as it is."""
    pieces = F.regexp_extract_all(url, F.lit("([\\x00-\\x7F]+|[^\\x00-\\x7F]+)"), F.lit(1))
    escaped = lambda p: F.regexp_replace(F.hex(F.encode(p, "UTF-8")), "(..)", "%$1")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[\\x00-\\x7F]"), p).otherwise(escaped(p))), "")


def change_case(text: Column, n: int, upper: bool = False) -> Column:
    """The first n characters in the other case, letters of ASCII only."""
    small, large = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    head, tail = F.substring(text, 1, n), F.substring(text, F.lit(n + 1), F.length(text))
    return F.concat(F.translate(head, *((small, large) if upper else (large, small))), tail)
