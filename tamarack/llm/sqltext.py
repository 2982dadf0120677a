"""What a SQL statement says, apart from how it is typed: tokens without case, white space,
identifier quotes, end marks and parentheses that group nothing, and the outermost select
list as a multiset."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""'(?:[^']|'')*'?|"[^"]*"?|`[^`]*`?|[0-9]+(?:\.[0-9]*)?|[^\W\d]\w*|<=|>=|<>|!=|\|\||::|[^\s\w]|\w+""")
_CURLY = str.maketrans({"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "​": None, "﻿": None})
_BLANKS = re.compile(r"\s+")

_COMPARE = {"=", "<", ">", "<=", ">=", "<>", "!=", "is", "like", "ilike", "in", "between", "similar", "rlike", "regexp"}
_LEVEL = {"or": 1, "and": 2, "not": 3, "+": 5, "-": 5, "||": 5, "*": 6, "/": 6, "%": 6, "::": 8} | dict.fromkeys(_COMPARE, 4)
#: Words after which "(" opens a group rather than the arguments of a function.
_OPENERS = {"select", "distinct", "all", "where", "on", "having", "and", "or", "not", "by", "when", "then", "else", "case", "from", "join", "limit", "offset", "is", "like", "ilike", "between", "set", "return", "interval"}
#: Words that end an expression or start a clause: nothing binds across them.
_EDGES = _OPENERS | {"as", "asc", "desc", "group", "order", "union", "except", "intersect", "end", "using", "with", "over", "partition", "left", "right", "inner", "outer", "full", "cross", "nulls", "fetch", ",", "(", ")", ";"}
_CLAUSES = {"from", "where", "group", "having", "order", "limit", "offset", "union", "except", "intersect", "fetch", "window"}


def tokens(statement: str) -> list[str]:
    out = []
    for t in _TOKEN.findall(statement.translate(_CURLY) if not statement.isascii() else statement):
        c = t[0]
        if c == "'":
            out.append("'" + _BLANKS.sub(" ", t[1:-1] if len(t) > 1 and t[-1] == "'" else t[1:]).casefold() + "'")
        elif c in '"`':
            inner = _BLANKS.sub(" ", t.strip(c)).casefold()
            out.append(inner)
        else:
            out.append(t if t.islower() else t.casefold())
    while out and out[-1] == ";":
        out.pop()
    while out and out[0] == ";":
        out.pop(0)
    return out


def _needs_look(ts: list[str]) -> bool:
    for i, t in enumerate(ts):
        if t == "(":
            before = ts[i - 1] if i else ""
            after = ts[i + 1] if i + 1 < len(ts) else ""
            if after == "(":
                return True
            if (before in _OPENERS or not (before[:1].isalpha() or before[:1] == "_")) and after not in ("select", "with"):
                return True
    return False


def ungroup(ts: list[str]) -> list[str]:
    """Drop the parentheses without which the statement would be read the same."""
    if "(" not in ts or not _needs_look(ts):
        return ts
    n, match, stack = len(ts), {}, []
    level: list[int | None] = [None] * n
    pending = [0]
    for i, t in enumerate(ts):
        if t == "(":
            stack.append(i)
            pending.append(0)
        elif t == ")":
            if stack:
                match[stack[-1]] = i
                match[i] = stack.pop()
                pending.pop()
        elif t in _LEVEL:
            level[i] = _LEVEL[t]
            if t == "between":
                pending[-1] += 1
            elif t == "and" and pending[-1]:
                pending[-1] -= 1
                level[i] = 4
            elif t in "+-" and (i == 0 or level[i - 1] is not None or ts[i - 1] in _EDGES and ts[i - 1] != ")"):
                level[i] = 7
    gone = set()

    def at(i: int, step: int) -> int:
        i += step
        while i in gone:
            i += step
        return i

    def binds(i: int) -> int:
        return 0 if i < 0 or i >= n else level[i] if level[i] is not None else 0

    for j in [j for j, t in enumerate(ts) if t == ")" and j in match]:
        i = match[j]
        first, before, after = at(i, 1), at(i, -1), at(j, 1)
        if first == j:
            continue
        if ts[first] == "(" and match.get(first) == at(j, -1):  # ((x)): one of the two is enough
            gone |= {first, match[first]}
            first = at(i, 1)
        word = ts[before] if before >= 0 else ""
        if (word[:1].isalpha() or word[:1] == "_") and word not in _OPENERS or word == "in" or ts[first] in ("select", "with", "partition", "order"):
            continue
        lowest, k, listed = 9, first, False
        while k < j:
            if k not in gone:
                if ts[k] == "(":
                    k = match[k]
                elif ts[k] == ",":
                    listed = True
                    break
                elif level[k] is not None:
                    lowest = min(lowest, level[k])
                elif ts[k] in ("case", "when", "end"):
                    lowest = min(lowest, 1)
            k += 1
        left, right = binds(before), binds(after)
        if left == 4 and ts[before] == "not":
            left = 3
        same = lowest in (1, 2) and lowest >= left
        if not listed and (lowest > left or same or left == 0) and lowest >= right:
            gone |= {i, j}
    return [t for i, t in enumerate(ts) if i not in gone]


def statement_parts(statement: str | None) -> tuple[list[str], str] | None:
    """(columns of the outermost select list, all the rest), None for null.

    A statement with several outermost selects (set operations) or with none has no list.
    """
    if statement is None:
        return None
    ts = ungroup(tokens(statement))
    depth, start, end, columns, at = 0, -1, -1, [], 0
    for i, t in enumerate(ts):
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif depth == 0:
            if t == "select":
                if start >= 0:
                    return [], " ".join(ts)
                start = at = i + 1 + (i + 1 < len(ts) and ts[i + 1] in ("distinct", "all"))
            elif start >= 0 and end < 0:
                if t == "," and i >= start:
                    columns.append(" ".join(ts[at:i]))
                    at = i + 1
                elif t in _CLAUSES:
                    end = i
                    columns.append(" ".join(ts[at:i]))
    if start < 0:
        return [], " ".join(ts)
    if end < 0:
        end = len(ts)
        columns.append(" ".join(ts[at:]))
    return columns, " ".join(ts[:start] + ["\x00"] + ts[end:])
