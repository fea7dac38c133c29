"""A small JavaScript lexer, and what is read off its tokens without a parser.

Comments, strings, templates, regular expressions and brackets are told apart; a text
*parses* here if every literal ends and every bracket closes. This is laxer than a real
parser: some texts that a parser refuses are read as tokens all the same.
"""

from __future__ import annotations

import re

#: After these a slash begins a regular expression.
BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "+", "-", "*", "%", "<", ">", "~", "^", "return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "=>"}
NAME = re.compile(r"[A-Za-z_$À-￿][\w$À-￿]*")
NUMBER = re.compile(r"\d[\w.]*")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
BLANK = re.compile(r"\s+")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}
ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
DIRECTIVE = re.compile(r"^(?://|/\*)[#@]\s*sourceMappingURL\s*=\s*(\S+?)\s*(?:\*/)?$", re.DOTALL)


def unescaped(inner: str) -> str:
    def one(m: re.Match[str]) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            return chr(min(int(code, 16), 0x10FFFF))
        return "" if m[4] in ("\n", "\r\n") else ESCAPES.get(m[4], m[4])

    return ESCAPE.sub(one, inner) if "\\" in inner else inner


def tokens(text: str) -> tuple[list[tuple[str, str]], bool]:
    """((kind, text) of every token, whether everything closes). Kinds: name, number, string, template, regex, comment, mark."""
    out: list[tuple[str, str]] = []
    at, open_, last, ok = 0, [], "", True
    while at < len(text):
        c = text[at]
        if c.isspace():
            at = BLANK.match(text, at).end()
            continue
        if text.startswith("//", at):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out.append(("comment", text[at:end]))
            at = end
            continue
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            ok &= end >= 0
            end = len(text) if end < 0 else end + 2
            out.append(("comment", text[at:end]))
            at = end
            continue
        if c in "\"'`":
            end = at + 1
            while end < len(text) and text[end] != c and (c == "`" or text[end] != "\n"):
                end += 2 if text[end] == "\\" else 1
            ok &= end < len(text) and text[end] == c
            kind, end = "template" if c == "`" else "string", min(end + 1, len(text))
        elif m := NAME.match(text, at):
            kind, end = "name", m.end()
        elif m := NUMBER.match(text, at):
            kind, end = "number", m.end()
        elif c == "/" and last in BEFORE_REGEX | {""} and (m := REGEX.match(text, at)):
            kind, end = "regex", m.end()
        else:
            kind, end = "mark", at + (2 if text.startswith("=>", at) else 1)
            if c in "([{":
                open_.append(")]}"["([{".index(c)])
            elif c in ")]}":
                ok &= bool(open_) and open_.pop() == c
        last = text[at:end]
        out.append((kind, last))
        at = end
    return out, ok and not open_


def literal(token: tuple[str, str]) -> str | None:
    """Value of a string, or of a template without expressions."""
    if token[0] == "string" or (token[0] == "template" and "${" not in token[1]):
        return unescaped(token[1][1:-1])
    return None


def unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def read(text: str | None) -> dict[str, object]:
    """What the extractors need of one script, from one pass over its tokens."""
    every, ok = tokens(text or "")
    code = [t for t in every if t[0] != "comment"]
    imports: list[str] = []
    routes: list[str] = []
    chunks: list[str] = []
    calls: list[dict[str, object]] = []
    comments = [m[1] for t in every if t[0] == "comment" and (m := DIRECTIVE.match(t[1].strip()))]
    word = lambda k: code[k][1] if 0 <= k < len(code) else ""
    for k, (kind, said) in enumerate(code):
        if kind == "name" and said == "import" and word(k - 1) != ".":
            if word(k + 1) == "(" and k + 2 < len(code) and (v := literal(code[k + 2])) is not None:
                imports.append(v)
            elif k + 1 < len(code) and code[k + 1][0] == "string":
                imports.append(literal(code[k + 1]) or "")
        elif kind == "name" and said == "from" and k + 1 < len(code) and code[k + 1][0] == "string" and word(k - 1) not in (".", ":", ","):
            imports.append(literal(code[k + 1]) or "")
        elif said in ("path", "route", '"path"', "'path'", '"route"', "'route'") and word(k + 1) == ":" and k + 2 < len(code) and word(k - 1) in ("{", ","):
            v = literal(code[k + 2])
            if v and v.startswith("/"):
                routes.append(v)
        if said == "(" and word(k - 3) == "__webpack_require__" and word(k - 2) == "." and word(k - 1) == "e" and k + 1 < len(code):
            v = literal(code[k + 1]) if code[k + 1][0] == "string" else code[k + 1][1] if code[k + 1][0] == "number" else None
            if v:
                chunks.append(v)
        if kind in ("string", "template") and (call := called(code, k)):
            calls.append(call)
    return {"parse_ok": ok, "imports": unique(imports), "routes": unique(routes), "chunks": chunks, "map_reference": comments[-1] if comments else "", "calls": calls}


def called(code: list[tuple[str, str]], k: int) -> dict[str, object] | None:
    """A literal with a slash as (raw, call, method, names): first argument of a call, else a plain string."""
    kind, said = code[k]
    inner = said[1:-1]
    raw = re.sub(r"\$\{[^}]*\}", "EXPR", inner) if kind == "template" else unescaped(inner)
    if "/" not in raw or len(raw) > 2048 or (k > 1 and code[k - 1][1] == "+" and code[k - 2][0] in ("string", "name", "number", "template")):
        return None
    j = k + 1
    while j + 1 < len(code) and code[j][1] == "+":  # "/user/" + id + "/x": names and calls are one wildcard segment
        step = code[j + 1]
        raw += (unescaped(step[1][1:-1]) if step[0] == "string" else "EXPR") if step[0] in ("string", "name", "number") else ""
        j += 2
    name, p = "", k - 1
    if p >= 0 and code[p][1] == "(":
        parts = []
        p -= 1
        while p >= 0 and (code[p][0] == "name" or code[p][1] == "."):
            parts.append(code[p][1])
            p -= 1
        name = "".join(reversed(parts))
    method, names = "", []
    if name and j < len(code) and code[j][1] == ",":
        depth, q = 0, j + 1
        while q < len(code) and not (depth == 0 and code[q][1] == ")"):
            depth += code[q][1] in ("(", "[", "{")
            depth -= code[q][1] in (")", "]", "}")
            if code[q][0] == "name" and q + 1 < len(code) and code[q + 1][1] in (":", ",", "}") and depth:
                if code[q][1] == "method" and code[q + 1][1] == ":" and q + 2 < len(code):
                    method = (literal(code[q + 2]) or "").upper()
                elif depth == 1 and code[q][1] not in ("headers", "body", "credentials", "mode", "data", "params"):
                    names.append(code[q][1])
            q += 1
    return {"raw": raw, "call": name, "method": method, "names": sorted(set(names))}


def function_body(text: str | None, head: str) -> str:
    """Text between the braces that open after ``head``; quotes are respected; empty if they don't close."""
    start = (text or "").find(head)
    start = (text or "").find("{", start) if start >= 0 else -1
    if start < 0:
        return ""
    depth, quote, at = 0, "", start
    while at < len(text):
        c = text[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "\"'`":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start + 1 : at]
        at += 1
    return ""
