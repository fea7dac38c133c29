"""URL functions as column expressions; Python only where hosts or references need it.

``origin`` covers ASCII names and IPv4 hosts inside the JVM; ``origin_any`` adds
international names and IPv6 by one Arrow UDF. Everything that can't be read is null.
"""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.vectorized import vectorized
#: Scheme, authority, path, query and fragment of a reference (the pattern of RFC 3986).
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Media types of scripts.
JS_TYPES = ("application/javascript", "text/javascript", "application/ecmascript", "text/ecmascript", "application/x-javascript", "text/x-javascript", "application/js", "text/js")


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def host_port(url: Column) -> Column:
    """Host and port as written, without user information."""
    return F.regexp_replace(part(url, 2), r"^.*@", "")


def origin(url: Column) -> Column:
    """Canonical origin of an http(s) URL with an ASCII or IPv4 host; null for any other."""
    url = F.trim(url)
    kind, authority = scheme(url), F.lower(host_port(url))
    host = F.regexp_extract(authority, r"^([a-z0-9._-]+)(?::[0-9]+)?$", 1)
    port = F.regexp_extract(authority, r":0*([0-9]+)$", 1)
    number = F.when(port != "", port.try_cast("int"))
    bad = (port != "") & (number.isNull() | (number < 1) | (number > 65535))
    plain = (port == "") | ((kind == "http") & (number == 80)) | ((kind == "https") & (number == 443))
    return F.when(~kind.isin("http", "https") | (host == "") | bad, None).when(plain, F.concat(kind, F.lit("://"), host)).otherwise(F.concat(kind, F.lit("://"), host, F.lit(":"), number.cast("string")))


def origin_of(url: str | None) -> str | None:
    """The general form of ``origin`` for one value."""
    try:
        split = urlsplit((url or "").strip())
        host, port = (split.hostname or "").lower(), split.port
    except ValueError:
        return None
    if split.scheme.lower() not in ("http", "https") or not host or split.netloc.endswith(":") or port == 0:
        return None
    try:
        ip = ipaddress.ip_address(host)
        if "%" in host:
            return None
        host = f"[{ip.compressed}]" if ip.version == 6 else str(ip)
    except ValueError:
        if ":" in host:
            return None
        try:
            host = host if host.isascii() else host.encode("idna").decode().lower()
        except UnicodeError:
            return None
        if not host or not all(c.isascii() and (c.isalnum() or c in "-_.") for c in host):
            return None
    usual = {"http": 80, "https": 443}[split.scheme.lower()]
    return f"{split.scheme.lower()}://{host}" + (f":{port}" if port and port != usual else "")


@vectorized("string")
def origin_any(url: pd.Series) -> pd.Series:
    return url.map(origin_of)


def same_origin(left: Column, right: Column) -> Column:
    """False where either side has no origin."""
    return F.coalesce(origin(left) == origin(right), F.lit(False))


def allowed_domain(url: Column, domains: list[str], entry: Column) -> Column:
    """Own origin, or a host that equals or lies under an allowed domain, whatever scheme and port (U4)."""
    host = F.regexp_extract(origin(url), r"^https?://([^:]+)", 1)
    names = [d for d in (domain_name(d) for d in domains) if d]
    listed = F.lit(False)
    for d in names:
        listed = listed | (host == d) | F.endswith(host, F.lit(f".{d}"))
    return F.coalesce(origin(url).isNotNull() & (F.coalesce(origin(url) == origin(entry), F.lit(False)) | listed), F.lit(False))


def domain_name(given: str) -> str:
    """Host of an allow-list entry that may carry scheme, port, brackets or outer dots."""
    d = given.strip().removesuffix("/")
    if "://" in d:
        d = urlsplit(d).hostname or ""
    elif d.count(":") == 1:
        d = d.partition(":")[0]
    found = origin_of(f"http://{d.strip('.').lower()}")
    return found.removeprefix("http://").strip("[]") if found else ""


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")  # U5


def is_js_path(url: Column) -> Column:
    """The path ends .js or .mjs, or the query speaks of a chunk or module."""
    q = F.lower(query(url))
    return F.lower(path(url)).rlike(r"\.m?js$") | q.contains("chunk") | q.contains("module")


def worth_fetching(url: Column, dynamic: Column) -> Column:
    """Static finds must look like scripts; dynamic ones only must not look like anything else."""
    low = F.lower(url)
    other = low.rlike(r"\.(css|html|htm|xml|svg|png|jpg|gif|woff|woff2)$") | low.contains(".css?") | (low.endswith(".json") & ~low.contains("chunk") & ~low.contains("module"))
    return F.when(dynamic, ~other).otherwise(is_js_path(url))


def is_js_type(content_type: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.split(content_type, ";")[0])).isin(*JS_TYPES), F.lit(False))  # U8


def unescaped(raw: Column) -> Column:
    """Trim, one quote pair off, JSON escapes undone, trailing punctuation and fragment cut (U9, before resolving)."""
    quoted = F.regexp_replace(F.trim(raw), r"^(?:\"(.*)\"|'(.*)'|`(.*)`)$", "$1$2$3")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\\/", "/"), r"\\\"", "\""), r"\\\\", r"\\")
    return F.regexp_replace(F.regexp_replace(plain, r"[`\")\]};,\\]+$", ""), r"#.*$", "")


def segments(raw_path: Column) -> Column:
    """Path segments without empty and dot segments; nothing is popped."""
    return F.filter(F.split(raw_path, "/"), lambda s: ~s.isin("", ".", ".."))


def static_segments(raw: Column) -> Column:
    """Segments of a reference's path: query, fragment and leading dot segments don't count."""
    return segments(path(F.trim(raw)))


def host_name_of_directory(url: Column) -> Column:
    """Sanitized host with its port after an underscore."""
    host = F.lower(host_port(url))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r":([0-9]+)$", "_$1"), r"[^a-z0-9_-]", "_"), r"^$", "unknown")


def artifact_name(url: Column, extension: str = ".js", stem: str = "index") -> Column:
    """Stem of at most 64 characters, the first 8 hex digits of the URL's SHA-256, own or given extension."""
    last = F.regexp_extract(F.regexp_replace(path(url), r"/+$", ""), r"([^/]*)$", 1)
    own = F.regexp_extract(last, r"(\.[^.]*)$", 1)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]", "_"), r"^[._]+|[._]+$", "")
    return F.concat(F.substring(F.when(name == "", stem).otherwise(name), 1, 64), F.lit("-"), F.substring(F.sha2(url, 256), 1, 8), F.when(own == "", extension).otherwise(own))


def file_name(url: Column) -> Column:
    """Path and query as one flat name of at most 200 characters."""
    whole = F.concat(F.when(path(url).isin("", "/"), "/index").otherwise(path(url)), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))
    return F.regexp_replace(F.substring(F.regexp_replace(whole, r"[/\\\\:?&= ]", "_"), 1, 200), "^_", "")


def entry_url(raw: Column) -> Column:
    """Entry line to URL: bare hosts get https; other schemes and protocol-relative lines are null (S3)."""
    t = F.trim(raw)
    given = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    port_like = t.rlike(r"^[^/?#]*:[0-9]")
    url = F.when(t.startswith("//") | (t == ""), None).when(F.lower(given).isin("http", "https") & t.rlike(r"^[A-Za-z]+://"), t).when((given == "") | port_like | given.contains("."), F.concat(F.lit("https://"), t))
    return F.when(origin(url).isNotNull(), url)


# ---------------------------------------------------------------- resolving (Python values)


def resolved(base: str | None, ref: str | None) -> str | None:
    """Script reference against a base: bare relative paths are ./-relative, no fragment."""
    if not ref:
        return None
    try:
        if ref.startswith(("http://", "https://")):
            whole = ref
        elif ref.startswith("//"):
            whole = f"{urlsplit(base or '').scheme}:{ref}"
        elif ref.startswith("/"):
            b, r = urlsplit(base or ""), urlsplit(ref)
            whole = urlunsplit((b.scheme, b.netloc, r.path, r.query, ""))
        else:
            whole = urljoin(base or "", ref if ref.startswith(("./", "../")) else f"./{ref}")
        return whole.partition("#")[0]
    except ValueError:
        return None


@vectorized("string")
def resolve_js(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([resolved(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


@vectorized("string")
def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 resolution without fragment; //x takes the base's scheme and keeps what follows."""

    def one(b: str | None, r: str | None) -> str | None:
        if not r:
            return None
        try:
            return f"{urlsplit(b or '').scheme}:{r}" if r.startswith("//") else urljoin(b or "", r).partition("#")[0]
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def clean_discovered(raw: Column, base: Column) -> Column:
    """Cleaned URL, absolute as it is or resolved against ``base``; null if neither is http(s)."""
    text = unescaped(raw)
    whole = F.when(text.rlike("^https?://"), text).when(text != "", resolve_js(base, text))
    return F.when(whole.rlike("^https?://"), whole)


# ---------------------------------------------------------------- resolving (column expressions)


def without_dots(raw_path: Column) -> Column:
    """Path with . and .. segments resolved, as RFC 3986 asks; folded over the segments inside the JVM."""
    steps = F.split(raw_path, "/", -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1))))).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.array_join(kept, "/"), F.when(raw_path.rlike(r"(^|/)\.\.?$") & ((F.size(kept) == 1) | (F.try_element_at(kept, F.lit(-1)) != "")), "/").otherwise(""))


def joined(base: Column, ref: Column) -> Column:
    """``ref`` against ``base`` without fragment, for http(s) references and paths (U2, no Python)."""
    home = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    asked = F.regexp_extract(ref, r"(\?[^#]*)", 1)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    below = F.concat(home, without_dots(F.concat(folder, path(ref))), asked)
    return (
        F.when(ref.isNull() | (ref == ""), None)
        .when(ref.rlike("^https?://"), without_fragment(ref))
        .when(ref.startswith("//"), F.concat(part(base, 1), F.lit(":"), without_fragment(ref)))
        .when(ref.startswith("/"), F.concat(home, path(ref), asked))
        .otherwise(below)
    )
