"""Facts of Rust files at item level: a tokenizer that knows strings, comments and lifetimes, and a brace matcher.

There is no Rust parser here, so expression rules are limited to what tokens tell: functions with
parameters, spans and decisions; types and impls; mod and use; macros and calls that panic; attributes.
Rows have the shape of the Python facts.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from orelode.sources.python_facts import _COLUMNS, SCHEMA

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>b?r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\.[^']*|[^'\\])')|(?P<life>'\w+)|(?P<word>[A-Za-z_]\w*!?(?!=))|(?P<num>\d[\w.]*)|(?P<op>&&|\|\||=>|::|->|[^\s\w])""",
    re.S | re.X,
)


def tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of every token, comments included."""
    out, line, last = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", last, m.start())
        last = m.start()
        out.append((m.lastgroup if m.lastgroup != "h" else "string", m[0], line))
    return out


def rust_rows(rel: str, source: str) -> list[tuple]:
    rows = []

    def add(kind, name="", owner="", line=0, end=0, a=0, b=0, c=0, flags=(), text="", items=()):
        rows.append((rel, kind, name, owner, line, end or line, a, b, c, [f for f in flags if f], text, list(items)))

    every = tokens(source)
    for kind, text, line in every:
        if kind == "comment":
            add("comment", line=line, text=text)
            if m := re.match(r"[/*]+\s*[\w-]+: ignore(-file)? (\S+)\s*(.*)", text):
                for signal in m[2].split(","):
                    add("marker", signal.strip(), "file" if m[1] else "line", line, text=m[3].strip())
    t = [x for x in every if x[0] != "comment"]
    commented = {line for kind, _, line in every if kind == "comment"}
    close, stack = {}, []
    for i, (kind, text, _) in enumerate(t):
        if kind == "op" and text in "([{":
            stack.append(i)
        elif kind == "op" and text in ")]}" and stack:
            close[stack.pop()] = i
    types = fns = 0
    owners: list[tuple[int, str]] = []
    in_test_until = -1
    for i, (kind, text, line) in enumerate(t):
        owners = [o for o in owners if o[0] > i]
        owner = owners[-1][1] if owners else ""
        nxt = t[i + 1][1] if i + 1 < len(t) else ""
        if text == "#" and nxt == "[" and (e := close.get(i + 1)):
            body = "".join(x[1] for x in t[i + 2 : e])
            if body.startswith("cfg(test)"):
                j = next((k for k in range(e, len(t)) if t[k][1] == "{"), None)
                in_test_until = max(in_test_until, close.get(j, -1)) if j else in_test_until
            if re.match(r"(allow|expect)\(", body) and not {line, line - 1} & commented:
                add("bare_ignore", "allow-reason", owner, line, text=body)
            if body == "ignore":
                add("decorator", "ignore", owner, line, text=body)
        if kind == "word" and text in ("struct", "enum", "trait") and nxt[:1].isalpha():
            types += 1
            add("class", nxt, owner, line, flags=["abstract" if text == "trait" else "", "rust"])
        elif kind == "word" and text == "impl":
            j = next((k for k in range(i, len(t)) if t[k][1] == "{"), None)
            if j is not None and j in close:
                names = [x[1] for x in t[i + 1 : j] if x[0] == "word" and x[1][:1].isupper()]
                owners.append((close[j], names[-1] if names else ""))
        elif kind == "word" and text == "mod" and nxt:
            add("mod_decl", nxt, owner, line, flags=["inline" if i + 2 < len(t) and t[i + 2][1] == "{" else ""])
        elif kind == "word" and text == "use":
            j = next((k for k in range(i, len(t)) if t[k][1] == ";"), i)
            add("use", "".join(x[1] for x in t[i + 1 : j]), owner, line)
        elif kind == "word" and text == "fn" and nxt[:1].isalpha() or text == "fn" and nxt[:1] == "_":
            p = next((k for k in range(i, len(t)) if t[k][1] == "("), None)
            if p is None or p not in close:
                continue
            depth, params = 0, [[]]
            for x in t[p + 1 : close[p]]:
                depth += (x[1] in "([{<") - (x[1] in ")]}>") if x[0] == "op" and len(x[1]) == 1 else 0
                if x[1] == "," and depth == 0:
                    params.append([])
                else:
                    params[-1].append(x[1])
            params = [q for q in params if q]
            receiver = bool(params) and "self" in params[0]
            own = params[1:] if receiver else params
            j = next((k for k in range(close[p], len(t)) if t[k][1] in "{;"), None)
            body = (j, close[j]) if j is not None and t[j][1] == "{" and j in close else None
            inside = t[body[0] : body[1]] if body else []
            cc = 1 + sum(x[1] in ("if", "while", "for", "&&", "||", "assert!") for x in inside) + max(0, sum(x[1] == "=>" for x in inside) - sum(a[1] == "_" and b[1] == "=>" for a, b in zip(inside, inside[1:], strict=False)))
            fns += not owner
            test = i < in_test_until or any(x[1] == "test" for x in t[max(0, i - 6) : i])
            uses = any(x[1] == "self" for x in inside)
            add("function", nxt, owner, line, t[body[1]][2] if body else line, len(own), cc, sum(x[1] == "|" for x in inside) // 2, ["rust", "method" if receiver else "static" if owner else "", "uses_receiver" if uses else "", "stub" if not body or len(inside) <= 1 else "", "test" if test else "", "assertion" if any(x[1].startswith("assert") or x[1] == "panic!" for x in inside) else ""], items=["".join(q) for q in own])
        elif i >= in_test_until and kind == "word" and (text == "dbg!" or text in ("unwrap", "expect") and nxt == "(" and i and t[i - 1][1] == "."):
            add("call", "breakpoint" if text == "dbg!" else text, owner, line, flags=["rust", "panics"])
        elif i >= in_test_until and text == "let" and nxt == "_":
            add("handler", "let _", owner, line, flags=["bare"])
    add("module", rel.rsplit("/", 1)[-1].removesuffix(".rs"), line=0, a=fns, b=types, c=source.count("\n") + 1, flags=["rust"])
    return rows


def rust_facts(files: DataFrame) -> DataFrame:
    """Facts of files (rel, content)."""

    def run(batches):
        for batch in batches:
            rows = [r for rel, content in zip(batch["rel"], batch["content"], strict=True) for r in rust_rows(rel, content or "")]
            for i in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[i : i + 20_000], columns=_COLUMNS)

    return files.select("rel", "content").mapInPandas(run, SCHEMA)
