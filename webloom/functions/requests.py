"""Request data: query and form parameters, JSON, GraphQL and multipart bodies."""

from __future__ import annotations

import json
import re
from email.parser import BytesParser
from urllib.parse import parse_qsl

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.vectorized import vectorized
from webloom.functions import urls

VALUE_BYTES, SAMPLE_BYTES, BODY_BYTES, GRAPHQL_TOKENS = 128, 4096, 1 << 20, 15_000
PARAMETERS = "array<struct<name:string,value:string>>"
#: Verbs, and words that may follow one in a call's name.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
FOLLOWERS = ("request", "fetch", "with", "json", "form", "data", "http", "ajax", "xhr", "api", "call")
#: Extensions of assets that are no endpoints.
ASSETS = ("js", "mjs", "cjs", "css", "map", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "avif", "woff", "woff2", "ttf", "otf", "eot")
#: What a control that must not be clicked says.
DANGEROUS = ("log out", "logout", "sign out", "signout", "delete", "remove", "destroy", "submit", "save", "pay", "purchase", "buy", "download", "install", "unsubscribe", "deactivate", "disable", "cancel", "reject", "block", "ban", "approve", "accept", "confirm")


def pairs(encoded: Column) -> Column:
    """Decoded (name, value) pairs sorted by both, not deduplicated; + is a blank."""
    def pair(p: Column) -> Column:
        return F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"), F.try_url_decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("value"))

    return F.array_sort(F.filter(F.transform(F.filter(F.split(encoded, "&"), lambda p: (p != "") & ~p.contains(";")), pair), lambda x: x["name"].isNotNull() & x["value"].isNotNull()))


def query_parameters(url: Column) -> Column:
    return pairs(urls.query(url))


def media_type(headers: Column) -> Column:
    """Media type of a header map, names compared without case."""
    found = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == "content-type"))
    return F.lower(F.trim(F.split(F.try_element_at(found, F.lit(1)), ";")[0]))


def body_kind(kind: Column) -> Column:
    """json, form, multipart, or null where no body is kept."""
    return F.when(kind.rlike(r"^application/(.*\+)?json$"), "json").when(kind == "application/x-www-form-urlencoded", "form").when(kind == "multipart/form-data", "multipart")


def cut_bytes(value: str, limit: int) -> str:
    """At most ``limit`` UTF-8 bytes, cut between characters; what isn't UTF-8 becomes U+FFFD."""
    return value.encode("utf-8", "replace")[:limit].decode("utf-8", "ignore")


def cut_value(value: Column, limit: int = VALUE_BYTES) -> Column:
    """At most ``limit`` UTF-8 bytes, cut between characters (U18): of the four cuts up to ``limit``, the longest that is UTF-8."""
    cut = [F.try_validate_utf8(F.substring(F.encode(value, "utf-8"), 1, max(limit - k, 0)).cast("string")) for k in range(4)]
    return F.when(F.octet_length(value) <= limit, value).otherwise(F.coalesce(*cut))


class Verbatim(float):
    """A JSON number that keeps its text."""

    def __new__(cls, text: str) -> Verbatim:
        number = super().__new__(cls, text)
        number.text = text
        return number

    def __repr__(self) -> str:
        return self.text


def leaves(value: object, name: str = "") -> list[tuple[str, str]]:
    """Dotted names of all leaves; elements of an array share its name, a nameless scalar is dropped."""
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in leaves(value[k], f"{name}.{k}" if name else k)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v, name)]
    if not name:
        return []
    said = "" if value is None else str(value).lower() if isinstance(value, bool) else value.text if isinstance(value, Verbatim) else str(value)
    return [(name, cut_bytes(said, VALUE_BYTES))]


def graphql_roots(value: object) -> list[dict]:
    roots = value if isinstance(value, list) else [value]
    return roots if roots and all(isinstance(r, dict) and isinstance(r.get("query"), str) and is_graphql(r["query"]) for r in roots) else []


GRAPHQL_TOKEN = re.compile(r'"""(?:.|\n)*?"""|"(?:[^"\\\n]|\\.)*"|#[^\n]*|\.\.\.|[_A-Za-z]\w*|-?\d[\w.+-]*|[!$&():=@\[\]{|}]|[\s,﻿]+')


def is_graphql(text: str) -> bool:
    """One operation at least, balanced brackets, nothing that is no token."""
    at, tokens = 0, []
    while at < len(text):
        m = GRAPHQL_TOKEN.match(text, at)
        if not m or len(tokens) > GRAPHQL_TOKENS:
            return False
        at = m.end()
        if m[0][0] not in "#﻿," and not m[0].isspace() and m[0].strip(", \t\r\n﻿"):
            tokens.append(m[0])
    open_, starts = [], []
    for t in tokens:
        if not open_ and (t in ("query", "mutation", "subscription", "fragment") or (t == "{" and (not starts or starts[-1] is None))):
            starts.append(t)
        if t in "([{" and len(t) == 1:
            open_.append(")]}"["([{".index(t)])
        elif t in ")]}" and len(t) == 1:
            if not open_ or open_.pop() != t:
                return False
            if not open_ and t == "}":
                starts.append(None)
    return not open_ and "{" in tokens and any(s in ("query", "mutation", "subscription", "{") for s in starts)


def json_parameters(body: str | None) -> tuple[list[tuple[str, str]], str, str] | None:
    """(parameters, compact sample, GraphQL operation names) of a JSON body; null if it isn't one."""
    try:
        value = json.loads(body or "", parse_float=Verbatim)
    except (ValueError, RecursionError):
        return None
    roots = graphql_roots(value)
    found = leaves(value)
    names = ""
    if roots:
        found = []
        for r in roots:
            if isinstance(r.get("operationName"), str) and r["operationName"]:
                found.append(("operationName", cut_bytes(r["operationName"], VALUE_BYTES)))
            found += leaves(r.get("variables") or {}, "variables")
        names = ",".join(sorted({v for n, v in found if n == "operationName"}))
    return sorted(set(found)), cut_bytes(json.dumps(value, separators=(",", ":"), ensure_ascii=False, default=str), SAMPLE_BYTES), names


def multipart_parameters(content_type: str, body: bytes) -> list[tuple[str, str]]:
    """Part names; files have the value [FILE], other values stay empty."""
    message = BytesParser().parsebytes(b"Content-Type: " + content_type.encode("utf-8", "replace") + b"\r\n\r\n" + body)
    found = set()
    for p in message.get_payload() if message.is_multipart() else []:
        name = p.get_param("name", header="content-disposition")
        if name:
            found.add((str(name), "[FILE]" if p.get_filename() is not None else ""))
    return sorted(found)


@vectorized(f"params {PARAMETERS}, sample string, graphql string, truncated boolean")
def parsed_body(content_type: pd.Series, body: pd.Series) -> pd.DataFrame:
    """Parameters of a request body by its media type; others keep none."""
    rows = []
    for kind, text in zip(content_type, body, strict=True):
        text, media = text or "", (kind or "").partition(";")[0].strip().lower()
        raw = text.encode("utf-8", "replace")
        over = len(raw) > BODY_BYTES
        text = cut_bytes(text, BODY_BYTES) if over else text
        params, sample, names = [], None, ""
        if re.fullmatch(r"application/(.*\+)?json", media):
            found = json_parameters(text)
            if found:
                params, sample, names = found
        elif media == "application/x-www-form-urlencoded":
            params = sorted((n, cut_bytes(v, VALUE_BYTES)) for n, v in parse_qsl(text, keep_blank_values=True))
        elif media == "multipart/form-data":
            params = multipart_parameters(kind, raw[:BODY_BYTES])
        rows.append(([{"name": n, "value": v} for n, v in params], sample, names, over))
    return pd.DataFrame(rows, columns=["params", "sample", "graphql", "truncated"])


def http_method(explicit: Column, call: Column) -> Column:
    """Explicit method, else the verb that the last part of the call's name begins with."""
    last = F.regexp_extract(F.lower(call), r"([^.]*)$", 1)
    verb = F.regexp_extract(last, rf"^({'|'.join(VERBS)})(?:[_.-]*(?:{'|'.join(FOLLOWERS)}).*)?$", 1)
    return F.when(F.trim(explicit) != "", F.upper(F.trim(explicit))).otherwise(F.upper(verb))


def is_endpoint_candidate(raw: Column, kind: Column) -> Column:
    """No import, no blanks, controls or quotes, path-like, and no asset by extension."""
    clean = ~raw.rlike(r"[\s\x00-\x1f\x7f\"'`]") & (raw != "")
    path_like = raw.rlike(r"^(https?://|//|/|\./|\.\./)") | (raw.contains("/") & ~raw.contains(":"))
    extension = F.lower(F.regexp_extract(urls.path(raw), r"\.([^./]*)$", 1))
    return (kind != "import") & clean & path_like & ~extension.isin(*ASSETS)


def is_dangerous(text: Column, href: Column) -> Column:
    """Whether text or target says what must not be clicked."""
    said = F.lower(F.concat_ws(" ", text, href))
    out = F.lit(False)
    for word in DANGEROUS:
        out = out | said.contains(word)
    return out


def skip_href(href: Column, page: Column) -> Column:
    """Fragments, other schemes and other origins are not followed."""
    other = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~F.lower(href).rlike("^https?:")
    return href.startswith("#") | other | (href.rlike("^https?://") & ~urls.same_origin(href, page))


def header_map(line: Column) -> Column:
    """``H=V;H=V`` to a map."""
    return F.str_to_map(line, F.lit(";"), F.lit("="))
