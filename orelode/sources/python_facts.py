"""Facts of Python files: one row per function, class, call, literal, statement and so on.

The only Python code on the path of the rules: it parses each file once and emits narrow rows;
everything across rows (counts, joins, windows, similarity) is DataFrame code in plans/rules.py.

A row: rel, kind, name, owner, line, end, a, b, c (numbers by kind), flags, text, items.
A file that doesn't parse gives one `parse_error` row. Null contents count as empty files.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import io
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from orelode.sources import constants as C

SCHEMA = "rel string, kind string, name string, owner string, line int, end int, a int, b int, c int, flags array<string>, text string, items array<string>"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPE = (*_FUNCTION, ast.ClassDef, ast.Lambda)
_BUILTIN_NAMES = frozenset(x for x in dir(builtins) if x.islower() and not x.startswith("_")) - {"copyright", "credits", "exit", "license", "quit", "help"}
#: `# <tool>: ignore <signals> <why>` or `ignore-file`; any tool name is taken, signals are comma-separated.
_MARKER = re.compile(r"[#/]+\s*[\w-]+: ignore(-file)? (\S+)\s*(.*)")


def walk_scope(node: ast.AST) -> Iterator[ast.AST]:
    """Nodes below node, without those inside nested functions and classes (which are yielded themselves)."""
    todo = list(ast.iter_child_nodes(node))
    while todo:
        x = todo.pop()
        yield x
        if not isinstance(x, _SCOPE):
            todo += ast.iter_child_nodes(x)


def complexity(fn: ast.AST) -> int:
    """1 and one for each decision; nested functions and classes aren't counted."""
    total = 1
    for x in walk_scope(fn):
        if isinstance(x, (ast.If, ast.IfExp, ast.Assert, ast.ExceptHandler)):
            total += 1
        elif isinstance(x, (ast.For, ast.AsyncFor, ast.While)):
            total += 1 + bool(x.orelse)
        elif isinstance(x, ast.Try):
            total += bool(x.orelse)
        elif isinstance(x, ast.BoolOp):
            total += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            total += 1 + len(x.ifs)
        elif isinstance(x, ast.Match):
            total += sum(not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None) for c in x.cases)
    return total


def dotted(x: ast.AST | None) -> str:
    """a.b.c of names and attributes; '' where the head is neither."""
    parts = []
    while isinstance(x, ast.Attribute):
        parts.append(x.attr)
        x = x.value
    if isinstance(x, ast.Name):
        return ".".join([x.id, *reversed(parts)])
    return ".".join(["", *reversed(parts)]) if parts else ""


def skeleton(fn: ast.AST) -> list[str]:
    """Node kinds in breadth-first order; names, parameters and constants are collapsed."""
    out = []
    for x in ast.walk(fn):
        if x is fn or isinstance(x, ast.expr_context):
            continue
        out.append("N" if isinstance(x, ast.Name) else "C" if isinstance(x, ast.Constant) else "A" if isinstance(x, ast.arg) else type(x).__name__)
    return out


def expression_key(x: ast.AST) -> str:
    """The structure of an expression with its names and without its literals' values."""

    def part(n):
        if isinstance(n, ast.Constant):
            return type(n.value).__name__
        own = n.id if isinstance(n, ast.Name) else n.attr if isinstance(n, ast.Attribute) else ""
        return f"{type(n).__name__}:{own}({','.join(part(c) for c in ast.iter_child_nodes(n) if not isinstance(c, ast.expr_context))})"

    return part(x)


def bounded(key: str, most: int) -> str:
    """The key, or for a longer one its start with the length and a digest of the whole: keys are equal only where the structures are."""
    if len(key) <= most:
        return key
    return f"{key[:most]}#{len(key)}:{hashlib.blake2b(key.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


class Facts:
    def __init__(self, rel: str, source: str):
        self.rel, self.source, self.rows = rel, source, []
        self.lists = 0

    def add(self, kind, name="", owner="", line=0, end=0, a=0, b=0, c=0, flags=(), text="", items=()):
        self.rows.append((self.rel, kind, name, owner, line, end or line, a, b, c, [f for f in flags if f], text, list(items)))

    def file(self) -> list[tuple]:
        self.comments()
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError) as e:
            self.add("parse_error", text=str(e)[:200])
            return self.rows
        lines = self.source.splitlines()
        head = "\n".join(lines[:20]).lower()
        functions = [x for x in tree.body if isinstance(x, _FUNCTION)]
        classes = [x for x in tree.body if isinstance(x, ast.ClassDef)]
        self.add("module", self.rel.rsplit("/", 1)[-1].removesuffix(".py"), line=0, a=len(functions), b=len(classes), c=len(lines), flags=["generated" if any(m in head for m in C.GENERATED_MARKS) else ""])
        self.module_names = {x.name for x in functions}
        self.class_names = {x.name for x in classes}
        self.parents = {c: p for p in ast.walk(tree) for c in ast.iter_child_nodes(p)}
        self.block(tree.body, "", "module")
        self.scopes(tree, "", None)
        self.names(tree)
        return self.rows

    # -- comments and markers ------------------------------------------------

    def comments(self) -> None:
        try:
            tokens = list(tokenize.generate_tokens(io.StringIO(self.source).readline))
        except (tokenize.TokenError, SyntaxError, IndentationError, ValueError):
            return
        start = None
        for t in tokens:
            if t.type == tokenize.COMMENT:
                text, line = t.string, t.start[0]
                self.add("comment", line=line, text=text)
                if m := _MARKER.match(text):
                    for signal in m[2].split(","):
                        self.add("marker", signal.strip(), "file" if m[1] else "line", line, text=m[3].strip())
                if re.search(r"#\s*type:\s*ignore", text) and not re.search(r"#\s*type:\s*ignore(\[[^\]]*\])?\s*(#|--|-|:)\s*\S", text):
                    self.add("bare_ignore", "type-ignore", line=line)
                if re.search(r"#\s*(noqa|pragma:\s*no cover)\b", text, re.I) and not re.search(r"(noqa(:\s*[A-Z0-9, ]+)?|no cover)\s*(#|--|-|:)\s*\S", text, re.I):
                    self.add("bare_ignore", "noqa", line=line)
            elif t.type == tokenize.NEWLINE:
                if start is not None and t.start[0] > start:
                    for n in range(start, t.start[0] + 1):
                        self.add("logical_line", line=n, a=start)
                start = None
            elif start is None and t.type not in (tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENCODING, tokenize.ENDMARKER):
                start = t.start[0]

    # -- scopes ----------------------------------------------------------------

    def scopes(self, node: ast.AST, owner: str, cls: ast.ClassDef | None, depth: int = 0) -> None:
        for x in walk_scope(node):
            if isinstance(x, _FUNCTION):
                self.function(x, owner, cls if node is cls else None, depth)
                self.scopes(x, f"{owner}.{x.name}".strip("."), cls, depth + 1)
            elif isinstance(x, ast.ClassDef):
                self.klass(x, owner, depth)
                self.scopes(x, f"{owner}.{x.name}".strip("."), x, depth)
            elif isinstance(x, ast.Lambda):
                self.scopes(x, owner, cls, depth + 1)
            else:
                self.node(x, owner, depth)

    def function(self, x, owner: str, cls: ast.ClassDef | None, depth: int) -> None:
        args = [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs, *filter(None, [x.args.vararg, x.args.kwarg])]
        decorators = [dotted(d.func if isinstance(d, ast.Call) else d) for d in x.decorator_list]
        static, classmethod_ = "staticmethod" in decorators, "classmethod" in decorators
        receiver = bool(cls) and not static and bool(args)
        params = args[1:] if receiver else args
        body = x.body[1:] if ast.get_docstring(x, clean=False) is not None else x.body
        stub = all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) or isinstance(s, ast.Raise) and "NotImplemented" in ast.dump(s) for s in body)
        own = args[0].arg if receiver else ""
        used = any(isinstance(n, ast.Name) and n.id == own for s in body for n in ast.walk(s)) if own else False
        inner = [n for n in walk_scope(x) if isinstance(n, (*_FUNCTION, ast.Lambda))]
        local = {n.id for n in walk_scope(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {a.arg for a in args}
        captured = any(isinstance(n, ast.Nonlocal) or isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store) and isinstance(n.value, ast.Name) and n.value.id in local for f in inner for n in ast.walk(f))
        qual = f"{owner}.{x.name}".strip(".")
        flags = [
            "method" if cls else "", "nested" if depth and not cls else "", "decorated" if decorators else "", "stub" if stub else "", "static" if static else "", "classmethod" if classmethod_ else "",
            "uses_receiver" if used else "", "super" if any(isinstance(n, ast.Name) and n.id == "super" for n in ast.walk(x)) else "", "captures" if captured else "", "property" if any(d in ("property", "cached_property") or d.endswith(".setter") for d in decorators) else "",
            "setter" if any(d.endswith(".setter") for d in decorators) or cls and x.name.startswith("set_") else "", "abstract" if any(d.rsplit(".", 1)[-1] in C.ABSTRACT_DECORATORS for d in decorators) else "", "override" if any(d.rsplit(".", 1)[-1] == "override" for d in decorators) else "",
            "assertion" if any(isinstance(n, ast.Assert) or isinstance(n, ast.Call) and re.search(r"(^|\.)(assert\w*|raises|warns|fail)$", dotted(n.func)) for n in ast.walk(x)) else "",
        ]
        self.add("function", x.name, owner, x.lineno, x.end_lineno, len(params), complexity(x), len(inner), flags, cls.name if cls else "", [f"{a.arg}:{ast.unparse(a.annotation) if a.annotation else ''}" for a in params])
        for d, node in zip(decorators, x.decorator_list, strict=True):
            self.add("decorator", d, qual, node.lineno, text=ast.unparse(node))
        for a in args:
            self.add("binding", a.arg, qual, a.lineno, text="param")
            if a.annotation:
                self.annotation(a.annotation, qual, a.arg)
        if x.returns:
            self.annotation(x.returns, qual, "return")
        if len(body) >= 2 and x.name != "__init__":
            tokens = skeleton(x)
            if len(tokens) >= 12:
                self.add("skeleton", x.name, owner, x.lineno, x.end_lineno, len(tokens), items=tokens)
        doc = ast.get_docstring(x)
        if doc:
            words = [w.lower() for w in re.split(r"[^0-9A-Za-z]+", doc) if len(w) >= 3 and w not in C.STOP_WORDS]
            said = {t for s in body for n in ast.walk(s) for t in self.said(n)}
            self.add("docstring", x.name, owner, x.lineno, a=len(words), b=sum(w in said for w in words))
        if cls and not static and len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Call):
            call = body[0].value
            passed = [n.id for n in call.args if isinstance(n, ast.Name)]
            whole = len(passed) == len(call.args) and not call.keywords and passed == [p.arg for p in params]
            self.add("forward", x.name, cls.name, x.lineno, a=len(params), flags=["whole" if whole else ""], text=dotted(call.func))
        if not cls and not depth and len(body) == 1 and isinstance(body[0], ast.Return) and isinstance(body[0].value, ast.Call):
            self.add("forward", x.name, "", x.lineno, a=len(params), text=dotted(body[0].value.func))
        if cls and own:
            for n in (m for s in body for m in ast.walk(s)):
                if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == own:
                    store = isinstance(n.ctx, ast.Store)
                    self.add("self_attr", n.attr, cls.name, n.lineno, flags=["store" if store else "load", "init" if x.name in ("__init__", "__new__", "__post_init__") else ""], text=x.name)
            aliases = {t.id: n.value.attr for n in walk_scope(x) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Attribute) and isinstance(n.value.value, ast.Name) and n.value.value.id == own for t in n.targets if isinstance(t, ast.Name)}
            for n in walk_scope(x):
                if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id in aliases:
                    self.add("alias_read", n.attr, cls.name, x.lineno, text=x.name, items=[n.value.id, aliases[n.value.id]])
        self.block(x.body, qual, "function")

    @staticmethod
    def said(n: ast.AST) -> list[str]:
        if isinstance(n, ast.Name):
            return [n.id.lower()]
        if isinstance(n, ast.Attribute):
            return [n.attr.lower()]
        if isinstance(n, ast.keyword) and n.arg:
            return [n.arg.lower()]
        return [n.value.lower()] if isinstance(n, ast.Constant) and isinstance(n.value, str) else []

    def klass(self, x: ast.ClassDef, owner: str, depth: int) -> None:
        methods = [m for m in x.body if isinstance(m, _FUNCTION)]
        bases = [dotted(b.value if isinstance(b, ast.Subscript) else b) for b in x.bases]
        names = {b.rsplit(".", 1)[-1] for b in bases}
        abstract = any("abstract" in ast.dump(d).lower() for m in methods for d in m.decorator_list)
        only_static = bool(methods) and all(any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in m.decorator_list) for m in methods)
        fields = [s for s in x.body if isinstance(s, (ast.AnnAssign, ast.Assign))]
        flags = ["abstract" if abstract or names & {"ABC", "Protocol"} else "", "protocol" if "Protocol" in names else "", "decorated" if x.decorator_list else "", "static_only" if only_static and not fields and not bases else "", "nested" if owner else ""]
        self.add("class", x.name, owner, x.lineno, x.end_lineno, len(methods), len(fields), flags=flags, items=bases)
        for s in fields:
            for t in [s.target] if isinstance(s, ast.AnnAssign) else s.targets:
                if isinstance(t, ast.Name):
                    self.add("field", t.id, x.name, s.lineno, flags=["annotated" if isinstance(s, ast.AnnAssign) else ""], text=ast.unparse(s.annotation) if isinstance(s, ast.AnnAssign) else "")
        for m in methods:
            self.add("method", m.name, x.name, m.lineno, m.end_lineno, items=skeleton(m))
        self.block(x.body, f"{owner}.{x.name}".strip("."), "class")

    def annotation(self, x: ast.AST, owner: str, name: str) -> None:
        for n in ast.walk(x):
            if isinstance(n, ast.Subscript) and dotted(n.value).rsplit(".", 1)[-1] in ("tuple", "Tuple"):
                parts = n.slice.elts if isinstance(n.slice, ast.Tuple) else [n.slice]
                open_ = any(isinstance(p, ast.Constant) and p.value is ... for p in parts)
                self.add("tuple_type", name, owner, n.lineno, a=0 if open_ else len(parts))
            elif isinstance(n, ast.Subscript) and dotted(n.value).rsplit(".", 1)[-1] in ("dict", "Dict") and isinstance(n.slice, ast.Tuple) and len(n.slice.elts) == 2:
                key, value = n.slice.elts
                scalar = dotted(value) in ("str", "int", "float", "bool", "bytes", "None")
                if dotted(key) in ("str", "Any") and not scalar:
                    self.add("record_type", name, owner, n.lineno, text="dict")
        if dotted(x) in ("dict", "Dict"):
            self.add("record_type", name, owner, x.lineno, text="bare dict")

    # -- statements ------------------------------------------------------------

    def block(self, body: list[ast.stmt], owner: str, role: str) -> None:
        self.lists += 1
        place = f"{owner}#{self.lists}"
        for pos, s in enumerate(body):
            leaves = isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and dotted(s.value.func) in ("sys.exit", "exit", "quit")
            noop = isinstance(s, ast.Expr) and not isinstance(s.value, (ast.Call, ast.Await, ast.Yield, ast.YieldFrom, ast.Constant, ast.Lambda, ast.NamedExpr))
            plain = not isinstance(s, (*_FUNCTION, ast.ClassDef, ast.Import, ast.ImportFrom)) and not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))
            self.add("stmt", place, owner, s.lineno, s.end_lineno, pos, flags=["exit" if leaves else "", "noop" if noop else "", "plain" if plain else ""], text=bounded(expression_key(s), 4000) if plain else "", items=[role])
            if not isinstance(s, (*_FUNCTION, ast.ClassDef)):
                for name in ("body", "orelse", "finalbody"):
                    if getattr(s, name, None):
                        self.block(getattr(s, name), owner, "inner")
                for h in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]:
                    self.block(h.body, owner, "inner")
            if role == "module" and isinstance(s, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                self.module_binding(s)
            if role == "module" and isinstance(s, (*_FUNCTION, ast.ClassDef)):
                overload = any(dotted(d).rsplit(".", 1)[-1] in ("overload", "setter", "register") for d in s.decorator_list)
                self.add("module_name", s.name, "", s.lineno, flags=["def", "overload" if overload else ""])

    def module_binding(self, s) -> None:
        value = s.value
        alias = isinstance(value, ast.Subscript) or isinstance(value, ast.BinOp) and isinstance(value.op, ast.BitOr) or isinstance(value, (ast.Name, ast.Attribute))
        for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
            if isinstance(t, ast.Name):
                camel = t.id[:1].isupper() and not t.id.isupper()
                flags = ["dunder" if t.id.startswith("__") and t.id.endswith("__") else "", "called" if isinstance(value, ast.Call) else "", "alias" if camel and alias else ""]
                self.add("module_name", t.id, "", s.lineno, flags=flags)
                self.add("global", t.id, "", s.lineno, flags=flags, text="container" if isinstance(value, (ast.List, ast.Dict, ast.Set)) else "constant" if t.id.isupper() else "other")

    # -- expressions -----------------------------------------------------------

    def node(self, x: ast.AST, owner: str, depth: int) -> None:
        if isinstance(x, ast.Call):
            self.call(x, owner)
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            module = ("." * x.level + (x.module or "")) if isinstance(x, ast.ImportFrom) else ""
            for n in x.names:
                whole = module or n.name
                private = whole != "__future__" and any(p.startswith("_") and p != "__future__" for p in [*whole.split("."), n.name] if p)
                self.add("import", n.asname or n.name, owner, x.lineno, flags=["in_function" if depth else "", "private" if private else ""], text=whole, items=[n.name if module else ""])
        elif isinstance(x, ast.Global):
            for n in x.names:
                self.add("global", n, owner, x.lineno, text="statement", flags=["statement"])
        elif isinstance(x, ast.ExceptHandler):
            surfaced = any(isinstance(n, (ast.Return, ast.Raise, ast.Break, ast.Continue)) or isinstance(n, ast.Call) and dotted(n.func) in ("sys.exit", "exit", "quit") for s in x.body for n in [s, *walk_scope(s)]) or self.mutates_returned(x)
            self.add("handler", dotted(x.type).rsplit(".", 1)[-1] if x.type else "", owner, x.lineno, flags=["bare" if x.type is None else "", "exits" if surfaced else ""])
            if x.name:
                self.add("binding", x.name, owner, x.lineno, text="except")
        elif isinstance(x, ast.Constant) and type(x.value) in (int, float) and depth >= 0:
            self.number(x, owner)
        elif isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store) and depth:
            self.add("binding", x.id, owner, x.lineno, text="local")
        elif isinstance(x, ast.If):
            self.conditional(x, owner)
        elif isinstance(x, (ast.For, ast.AsyncFor)):
            self.loop(x, owner)
        elif isinstance(x, ast.BoolOp) and not isinstance(self.parents.get(x), (ast.BoolOp, ast.UnaryOp)):
            operands = self.operands(x)
            nouns = {dotted(n).split(".")[0] for o in operands for n in ast.walk(o) if isinstance(n, (ast.Name, ast.Attribute))} - {""}
            nouns = {n for n in nouns if n[:1].islower() and n not in _BUILTIN_NAMES}
            whole = isinstance(self.parents.get(x), ast.Return)
            self.add("condition", "", owner, x.lineno, a=len(operands), flags=["return" if whole else ""], items=sorted(nouns - {"self"}))
        elif isinstance(x, ast.Match):
            arms = [c for c in x.cases if len(c.body) == 1 and isinstance(c.body[0], ast.Return) and isinstance(c.body[0].value, ast.Constant)]
            self.add("classify", dotted(x.subject), owner, x.lineno, a=len(x.cases), flags=["constants" if len(arms) == len(x.cases) else "", "match"])
        elif isinstance(x, ast.Dict):
            keys = [k for k in x.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)]
            scalar = all(isinstance(v, ast.Constant) for v in x.values)
            if None not in x.keys and len(x.keys) >= 2 and keys and len(keys) == len(x.keys) and not scalar:
                self.add("record_literal", "", owner, x.lineno, a=len(x.keys), items=[k.value for k in keys])
            arity = {len(v.elts) for v in x.values if isinstance(v, ast.Tuple)}
            if len(x.values) >= 2 and len(arity) == 1 and min(arity) >= 2 and all(isinstance(v, ast.Tuple) for v in x.values):
                target = self.parents.get(x)
                if isinstance(target, (ast.Assign, ast.AnnAssign)):
                    for t in target.targets if isinstance(target, ast.Assign) else [target.target]:
                        self.add("tuple_dict", dotted(t), owner, x.lineno, a=min(arity))
        elif isinstance(x, ast.Subscript) and isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, int) and isinstance(x.value, (ast.Subscript, ast.Name)):
            base = x.value.value if isinstance(x.value, ast.Subscript) else x.value
            self.add("index_read", dotted(base), owner, x.lineno, a=x.slice.value)
        if isinstance(x, ast.expr) and not isinstance(self.parents.get(x), ast.expr):
            nodes = sum(not isinstance(n, ast.expr_context) for n in ast.walk(x))
            steps = sum(isinstance(n, (ast.Call, ast.BinOp, ast.Compare, ast.BoolOp, ast.Subscript, ast.comprehension, ast.IfExp)) for n in ast.walk(x))
            if nodes >= 15 and steps >= 2:
                self.add("expression", owner=owner, line=x.lineno, end=x.end_lineno, a=nodes, b=x.col_offset, text=bounded(expression_key(x), 8000))
        if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Div) and not (isinstance(self.parents.get(x), ast.BinOp) and isinstance(self.parents[x].op, ast.Div)):
            segments = self.segments(x)
            if len(segments) >= 2 and any(s.startswith("'") for s in segments):
                self.add("path", owner=owner, line=x.lineno, items=segments)

    def mutates_returned(self, handler: ast.ExceptHandler) -> bool:
        fn = handler
        while fn in self.parents and not isinstance(fn, _FUNCTION):
            fn = self.parents[fn]
        returned = {n.value.id for n in walk_scope(fn) if isinstance(n, ast.Return) and isinstance(n.value, ast.Name)}
        for n in (n for s in handler.body for n in [s, *walk_scope(s)]):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store) and n.id in returned:
                return True
            if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id in returned:
                return True
        return False

    def segments(self, x: ast.AST) -> list[str]:
        if isinstance(x, ast.BinOp) and isinstance(x.op, ast.Div):
            return [*self.segments(x.left), *self.segments(x.right)]
        if isinstance(x, ast.Constant) and isinstance(x.value, str):
            return [f"'{x.value}'"]
        return [dotted(x) or "?"]

    def operands(self, x: ast.AST) -> list[ast.AST]:
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not):
            return self.operands(x.operand)
        return [o for v in x.values for o in self.operands(v)] if isinstance(x, ast.BoolOp) else [x]

    def call(self, x: ast.Call, owner: str) -> None:
        literal = sum(isinstance(a, ast.Constant) and type(a.value) in (int, float, str) for a in x.args)
        flags = [n for a in x.args for n in (["bool"] if isinstance(a, ast.Constant) and isinstance(a.value, bool) else [])]
        name = dotted(x.func)
        last = name.rsplit(".", 1)[-1]
        tail_bool = bool(x.args) and isinstance(x.args[-1], ast.Constant) and isinstance(x.args[-1].value, bool)
        booleans = len(flags) - (1 if tail_bool and last in C.LOOKUP_CALLS and len(x.args) > 1 else 0)
        args = [f"self.{a.attr}" if isinstance(a, ast.Attribute) and isinstance(a.value, ast.Name) and a.value.id == "self" else a.id if isinstance(a, ast.Name) else "?" for a in x.args]
        target = self.parents.get(x)
        result = target.targets[0].id if isinstance(target, ast.Assign) and isinstance(target.targets[0], ast.Name) else ""
        top = not owner
        self.add("call", name, owner, x.lineno, a=len(x.args), b=literal, c=booleans, flags=["plain" if isinstance(x.func, ast.Name) else "", "builtin" if name in _BUILTIN_NAMES else "", "module_level" if top else ""], text=result, items=args)

    def number(self, x: ast.Constant, owner: str) -> None:
        if isinstance(x.value, bool) or x.value in (0, 1, 2):
            return
        source = ast.get_source_segment(self.source, x) or ""
        parent, reason = self.parents.get(x), ""
        holder = parent
        if not isinstance(parent, (ast.BinOp, ast.Compare, ast.UnaryOp, ast.Call)):
            return
        if source[:2].lower() in ("0x", "0o", "0b"):
            reason = "radix"
        chain = [x]
        while chain[-1] in self.parents:
            chain.append(self.parents[chain[-1]])
        for n in chain:
            if isinstance(n, (ast.List, ast.Tuple, ast.Set)) and sum(isinstance(e, ast.Constant) and type(e.value) in (int, float) for e in n.elts) >= 3:
                reason = reason or "table"
            if isinstance(n, ast.keyword) and n.arg and set(re.split(r"[^a-z]+", n.arg.lower().rstrip("s"))) & set(C.UNIT_WORDS):
                reason = reason or "unit"
            if isinstance(n, ast.Call) and dotted(n.func).rsplit(".", 1)[-1] in C.UNIT_CALLS:
                reason = reason or "unit"
            if isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and (not owner or t.id.isupper() or set(t.id.lower().split("_")) & set(C.UNIT_WORDS)):
                        reason = reason or "named"
                break
        if isinstance(holder, ast.Compare) and any(isinstance(n, ast.Call) and dotted(n.func) == "len" for n in ast.walk(holder)):
            reason = reason or "len"
        self.add("number", str(x.value), owner, x.lineno, b=x.col_offset, text=reason)

    def conditional(self, x: ast.If, owner: str) -> None:
        parent = self.parents.get(x)
        if not (isinstance(parent, ast.If) and len(parent.body) == 1 and parent.body[0] is x and not parent.orelse):
            depth, at = 1, x
            while len(at.body) == 1 and isinstance(at.body[0], ast.If) and not at.orelse:
                depth, at = depth + 1, at.body[0]
            self.add("if_chain", "", owner, x.lineno, a=depth)
        if not (isinstance(parent, ast.If) and parent.orelse == [x]):
            arms, subjects, constants, types, at = 0, set(), 0, [], x
            while True:
                arms += 1
                t = at.test
                if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], (ast.Eq, ast.In, ast.Is)):
                    subjects.add(dotted(t.left) or "?")
                elif isinstance(t, ast.Call) and dotted(t.func) == "isinstance" and len(t.args) == 2:
                    subjects.add(dotted(t.args[0]) or "?")
                    types.append(ast.unparse(t.args[1]))
                else:
                    subjects.add("?")
                constants += len(at.body) == 1 and isinstance(at.body[0], (ast.Return, ast.Assign)) and isinstance(at.body[0].value, ast.Constant)
                if len(at.orelse) == 1 and isinstance(at.orelse[0], ast.If):
                    at = at.orelse[0]
                else:
                    break
            subject = next(iter(subjects)) if len(subjects) == 1 else "?"
            if subject != "?" and arms >= 2:
                self.add("chain", subject, owner, x.lineno, a=arms, b=constants, text=",".join(sorted(types)), flags=["types" if len(types) == arms else ""])
            t = x.test
            name = dotted(t.operand) if isinstance(t, ast.UnaryOp) and isinstance(t.op, ast.Not) else dotted(t.left) if isinstance(t, ast.Compare) and isinstance(t.comparators[0], ast.Constant) and t.comparators[0].value in (None, "") else ""
            guard = len(x.body) == 1 and isinstance(x.body[0], ast.Raise)
            if name:
                self.add("none_check", name, owner, x.lineno, flags=["guard" if guard else ""])

    def loop(self, x, owner: str) -> None:
        body = x.body[0] if len(x.body) == 1 else None
        while isinstance(body, ast.If) and len(body.body) == 1 and not body.orelse:
            body = body.body[0]
        if isinstance(body, ast.Expr) and isinstance(body.value, ast.Call) and isinstance(body.value.func, ast.Attribute) and body.value.func.attr in ("append", "add") and isinstance(body.value.func.value, ast.Name):
            self.add("loop_build", body.value.func.value.id, owner, x.lineno, text=body.value.func.attr)
        elif isinstance(body, ast.Assign) and isinstance(body.targets[0], ast.Subscript) and isinstance(body.targets[0].value, ast.Name):
            self.add("loop_build", body.targets[0].value.id, owner, x.lineno, text="item")
        for n in ast.walk(x.target):
            if isinstance(n, ast.Name):
                self.add("binding", n.id, owner, x.lineno, text="loop")

    def names(self, tree: ast.AST) -> None:
        """Distinct references and string literals of the file."""
        refs, strings = set(), set()
        for x in ast.walk(tree):
            if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Store):
                refs.add(x.id)
            elif isinstance(x, ast.Attribute):
                refs.add(x.attr)
            elif isinstance(x, ast.Constant) and isinstance(x.value, str) and 2 < len(x.value) < 200:
                strings.add(x.value)
            elif isinstance(x, ast.ImportFrom):
                refs.update(n.name for n in x.names)
        for n in sorted(refs):
            self.add("ref", n)
        for n in sorted(strings):
            self.add("string", n)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of files (rel, content). Batches of files in, rows out; a task holds one batch."""

    def run(batches):
        for batch in batches:
            rows = [r for rel, content in zip(batch["rel"], batch["content"], strict=True) for r in Facts(rel, content or "").file()]
            for i in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[i : i + 20_000], columns=_COLUMNS)

    return files.select("rel", "content").mapInPandas(run, SCHEMA)
