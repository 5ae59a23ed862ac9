"""Mechanical rewrites: text in, text out. Only changes that need no name and keep the other lines as they are."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("stale-suppression", "noop-statement", "unreachable", "duplicate-def", "restating-docstring", "loop-pipeline")


def _statements(tree: ast.AST):
    for node in ast.walk(tree):
        for name in ("body", "orelse", "finalbody"):
            if isinstance(body := getattr(node, name, None), list):
                yield node, body


def _without(lines: list[str], first: int, last: int, only: bool) -> list[str]:
    """Lines less first..last (from 1); a block's only statement becomes `pass`."""
    indent = re.match(r"\s*", lines[first - 1])[0]
    return [*lines[: first - 1], *([f"{indent}pass\n"] if only else []), *lines[last:]]


def rewrite(content: str, kind: str, line: int) -> str | None:
    """The text after the fix of `kind` at `line`; None where it can't be done safely."""
    lines = content.splitlines(keepends=True)
    if kind == "stale-suppression":
        if not 0 < line <= len(lines):
            return None
        rest = re.sub(r"\s*#\s*[\w-]+: ignore(-file)? .*(\n?)$", r"\2", lines[line - 1])
        return "".join([*lines[: line - 1], *([rest] if rest.strip() else []), *lines[line:]])
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return None
    for node, body in _statements(tree):
        for pos, s in enumerate(body):
            if s.lineno != line:
                continue
            alone = len(body) == 1
            shared = any(o is not s and (o.lineno <= s.end_lineno and s.lineno <= o.end_lineno) for o in body)
            if shared:
                return None
            if kind == "noop-statement" and isinstance(s, ast.Expr) and not isinstance(s.value, (ast.Call, ast.Await, ast.Yield, ast.YieldFrom)):
                out = _without(lines, s.lineno, s.end_lineno, alone)
            elif kind == "unreachable" and pos and isinstance(body[pos - 1], (ast.Return, ast.Raise, ast.Break, ast.Continue)):
                out = _without(lines, s.lineno, body[-1].end_lineno, False)
            elif kind == "duplicate-def" and isinstance(node, ast.Module) and isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                before = [o for o in body[:pos] if getattr(o, "name", None) == s.name]
                if not before:
                    return None
                first = min([before[-1].lineno, *(d.lineno for d in before[-1].decorator_list)])
                out = _without(lines, first, before[-1].end_lineno, False)
            elif kind == "restating-docstring" and isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(s, clean=False) is not None:
                d = s.body[0]
                if d.lineno == s.lineno:
                    return None
                out = _without(lines, d.lineno, d.end_lineno, len(s.body) == 1)
            elif kind == "loop-pipeline" and isinstance(s, ast.For) and pos and not s.orelse:
                out = _pipeline(lines, body[pos - 1], s)
            else:
                continue
            if out is None:
                return None
            text = "".join(out)
            try:
                ast.parse(text)
            except SyntaxError:
                return None
            return text
    return None


def _pipeline(lines: list[str], start: ast.stmt, loop: ast.For) -> list[str] | None:
    """`out = []` and a loop that only appends, as one comprehension."""
    inner, tests = loop.body[0] if len(loop.body) == 1 else None, []
    while isinstance(inner, ast.If) and len(inner.body) == 1 and not inner.orelse:
        tests.append(ast.unparse(inner.test))
        inner = inner.body[0]
    call = inner.value if isinstance(inner, ast.Expr) else None
    plain = isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr == "append" and isinstance(call.func.value, ast.Name) and len(call.args) == 1
    empty = isinstance(start, ast.Assign) and isinstance(start.targets[0], ast.Name) and isinstance(start.value, ast.List) and not start.value.elts
    if not (plain and empty and start.targets[0].id == call.func.value.id and start.targets[0].id not in ast.unparse(call.args[0]) + "".join(tests)):
        return None
    if any("#" in x for x in lines[start.lineno - 1 : loop.end_lineno]):
        return None
    indent = re.match(r"\s*", lines[start.lineno - 1])[0]
    text = f"{indent}{start.targets[0].id} = [{ast.unparse(call.args[0])} for {ast.unparse(loop.target)} in {ast.unparse(loop.iter)}{''.join(f' if {t}' for t in tests)}]\n"
    return [*lines[: start.lineno - 1], text, *lines[loop.end_lineno :]]


def rewritten(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(rel, content, done) of the files with fixes (rel, kind, line) applied from the last line up, one task a file."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        text, done = group["content"].iloc[0], 0
        for row in group.sort_values("line", ascending=False).itertuples():
            new = rewrite(text, row.kind, int(row.line))
            if new is not None and new != text:
                text, done = new, done + 1
        return pd.DataFrame({"rel": [group["rel"].iloc[0]], "content": [text], "done": [done]})

    wanted = fixes.select("rel", "kind", "line").distinct().filter(fixes["kind"].isin(*KINDS))
    return files.select("rel", "content").join(wanted, "rel").groupBy("rel").applyInPandas(run, "rel string, content string, done int")


def code_actions(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics that a mechanical rewrite settles, with the rewrite's kind."""
    return diagnostics.filter(diagnostics["signal"].isin(*KINDS)).withColumnRenamed("signal", "fix")
