"""Glob patterns as regular expressions."""

from __future__ import annotations

import re


def glob_regex(pattern: str) -> str:
    """A whole-path regular expression (Java and Python): * and ? also match /, ** with slashes any folders, [a-z] and {a,b} as usual."""
    out, at, depth = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at) and (at == 0 or pattern[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
            continue
        if pattern[at:] == "/**":
            out.append("/.*")
            break
        if pattern.startswith("**", at):
            out.append(".*")
            at += 2
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", at + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            body = pattern[at + 1 : end]
            negated = body[0] in "!^"
            body = body[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^' * negated}{body}]")
            at = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append(re.escape(c))
        at += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {pattern!r}")
    return f"(?s)^{''.join(out)}$"
