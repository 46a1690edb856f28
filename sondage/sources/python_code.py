"""Python sources as tables: elements, imports, calls, symbol uses and events inside functions.

Text is parsed where it is read, batch by batch; everything after that is joins.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ELEMENTS = (
    "file string, category string, name string, qualified string, line int, line_end int, line_count int, signature string, decorators array<string>,"
    " bases array<string>, complexity int, depth int, calls array<string>, n_args int, typed boolean, body_hash string"
)
IMPORTS = "file string, line int, module string, names array<string>, alias string, level int, in_function boolean, type_checking boolean"
EVENTS = "file string, function string, kind string, line int, text string"

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.Match)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def own(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a function without those of functions and classes inside it."""
    stack = list(ast.iter_child_nodes(node))
    while stack:
        n = stack.pop(0)
        yield n
        if not isinstance(n, (*_DEF, ast.ClassDef, ast.Lambda)):
            stack[:0] = list(ast.iter_child_nodes(n))


def cyclomatic(node: ast.AST) -> int:
    n = 1
    for x in own(node):
        n += isinstance(x, _BRANCH) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
        n += len(x.ifs) if isinstance(x, ast.comprehension) else 0
    return n


def nesting(node: ast.AST) -> int:
    def go(n: ast.AST, d: int) -> int:
        best = d
        for c in ast.iter_child_nodes(n):
            if not isinstance(c, (*_DEF, ast.ClassDef)):
                best = max(best, go(c, d + isinstance(c, _NEST)))
        return best

    return go(node, 0)


def dotted(n: ast.AST) -> str | None:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        left = dotted(n.value)
        return f"{left}.{n.attr}" if left else n.attr
    if isinstance(n, ast.Call):
        return dotted(n.func)
    return None


def _hash(node: ast.AST) -> str | None:
    """Of the body without docstring, names of things kept; short bodies have none."""
    body = list(node.body)
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    text = "\n".join(map(ast.unparse, body))
    return hashlib.sha256(text.encode()).hexdigest()[:16] if len(text) >= 10 else None


def elements(file: str, text: str | None) -> list[tuple]:
    tree = parse(text)
    if tree is None:
        return []
    out: list[tuple] = []

    def visit(node: ast.AST, scope: str, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, _DEF):
                args = n.args.posonlyargs + n.args.args + n.args.kwonlyargs
                named = [a for a in args if a.arg not in ("self", "cls")]
                typed = all(a.annotation for a in named) and n.returns is not None
                calls = list(dict.fromkeys(c for x in own(n) if isinstance(x, ast.Call) and (c := dotted(x.func))))
                ret = f" -> {ast.unparse(n.returns)}" if n.returns else ""
                out.append((file, "methods" if in_class else "functions", n.name, f"{scope}{n.name}", n.lineno, n.end_lineno, n.end_lineno - n.lineno + 1, f"({ast.unparse(n.args)}){ret}",
                            [ast.unparse(d) for d in n.decorator_list], [], cyclomatic(n), nesting(n), calls, len(named), typed, _hash(n)))
                visit(n, f"{scope}{n.name}.", False)
            elif isinstance(n, ast.ClassDef):
                out.append((file, "classes", n.name, f"{scope}{n.name}", n.lineno, n.end_lineno, n.end_lineno - n.lineno + 1, "", [ast.unparse(d) for d in n.decorator_list], [ast.unparse(b) for b in n.bases], None, None, [], None, None, None))
                visit(n, f"{scope}{n.name}.", True)
            else:
                visit(n, scope, in_class)

    visit(tree, "", False)
    return out


def imports(file: str, text: str | None) -> list[tuple]:
    tree = parse(text)
    if tree is None:
        return []
    out = []

    def visit(node: ast.AST, inside: bool, checking: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Import):
                out.extend((file, n.lineno, a.name, [], a.asname, 0, inside, checking) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                out.extend((file, n.lineno, n.module or "", [a.name], a.asname, n.level, inside, checking) for a in n.names)
            else:
                visit(n, inside or isinstance(n, _DEF), checking or (isinstance(n, ast.If) and "TYPE_CHECKING" in ast.unparse(n.test)))

    visit(tree, False, False)
    return out


def used_symbols(file: str, text: str | None) -> list[tuple]:
    """Names used anywhere but in import statements, and those that ``__all__`` exports."""
    tree = parse(text)
    names: set[str] = set()
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Name):
            names.add(n.id)
        elif isinstance(n, ast.Attribute) and (d := dotted(n)):
            names.add(d.split(".")[0])
        elif isinstance(n, ast.Assign) and any(isinstance(x, ast.Name) and x.id == "__all__" for x in n.targets):
            names |= {c.value for c in ast.walk(n.value) if isinstance(c, ast.Constant) and isinstance(c.value, str)}
    return [(file, s) for s in sorted(names)]


#: What a call reaches, by the words in its name (fixed value; the first that matches counts).
EFFECTS = {
    "http": ("requests", "urlopen", "urllib", "httpx", "aiohttp", "fetch", "http"),
    "db": ("execute", "executemany", "cursor", "commit", "rollback", "query", "session", "fetchall", "fetchone"),
    "fs": ("open", "write_text", "read_text", "write_bytes", "read_bytes", "unlink", "mkdir", "rmtree", "makedirs", "listdir", "rename", "remove", "copyfile"),
    "process": ("subprocess", "popen", "system", "check_output", "check_call"),
    "env": ("environ", "getenv"),
    "log": ("logging", "logger", "log", "print", "warn", "warning", "info", "debug", "error"),
    "time": ("sleep", "now", "time", "utcnow"),
    "random": ("random", "randint", "choice", "shuffle", "uuid4"),
}


def effect(call: str) -> str | None:
    words = [w.lower() for w in call.split(".")]
    return next((k for k, names in EFFECTS.items() if any(w in names for w in words)), None)


def events(file: str, text: str | None) -> list[tuple]:
    """What happens in each function, by line: READ, WRITE, CALL, EFFECT:*, EXIT, LOOP, CALL_IN_LOOP, GATE, KEY, STATE, NARROW."""
    tree = parse(text)
    out: list[tuple] = []

    def gates(n: ast.AST, name: str, chain: tuple[str, ...], loop: bool) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (*_DEF, ast.ClassDef)):
                continue
            emit = lambda kind, what: out.append((file, name, kind, getattr(c, "lineno", 0), what))  # noqa: E731, B023
            inner, looping = chain, loop
            if isinstance(c, ast.If):
                inner = (*chain, ast.unparse(c.test))
                emit("GATE", " and ".join(inner))
            if isinstance(c, (ast.For, ast.AsyncFor, ast.While)):
                emit("LOOP", ast.unparse(c.iter if not isinstance(c, ast.While) else c.test))
                looping = True
            if isinstance(c, (ast.Return, ast.Raise, ast.Yield, ast.YieldFrom, ast.Break, ast.Continue)):
                emit("EXIT", ast.unparse(c).split("\n")[0])
            if isinstance(c, ast.Name):
                emit("WRITE" if isinstance(c.ctx, (ast.Store, ast.Del)) else "READ", c.id)
            if isinstance(c, ast.AugAssign) and isinstance(c.target, ast.Name):
                emit("READ", c.target.id)
            if isinstance(c, ast.Call) and (d := dotted(c.func)):
                emit("CALL", d)
                if loop:
                    emit("CALL_IN_LOOP", d)
                if k := effect(d):
                    emit(f"EFFECT:{k}", d)
                if d == "isinstance" and c.args:
                    emit("NARROW", ast.unparse(c))
            if isinstance(c, ast.Subscript) and isinstance(c.slice, ast.Constant) and isinstance(c.slice.value, str) and (d := dotted(c.value)):
                emit("KEY", f"{d}[{c.slice.value}]")
            if isinstance(c, ast.Attribute) and isinstance(c.ctx, ast.Store) and (d := dotted(c)):
                emit("STATE", d)
            if isinstance(c, (ast.Global, ast.Nonlocal)):
                out.extend((file, name, "STATE", c.lineno, x) for x in c.names)
            if isinstance(c, ast.If):
                for part, ch in (([c.test], chain), (c.body, inner), (c.orelse, (*chain, f"not ({ast.unparse(c.test)})"))):
                    gates(ast.Tuple(elts=part, ctx=ast.Load()), name, ch, loop)
            else:
                gates(c, name, inner, looping)

    def visit(node: ast.AST, scope: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, _DEF):
                for a in n.args.posonlyargs + n.args.args + n.args.kwonlyargs:
                    out.append((file, f"{scope}{n.name}", "WRITE", n.lineno, a.arg))
                body = ast.Module(body=n.body, type_ignores=[])
                gates(body, f"{scope}{n.name}", (), False)
                visit(n, f"{scope}{n.name}.")
            else:
                visit(n, f"{scope}{n.name}." if isinstance(n, ast.ClassDef) else scope)

    if tree is not None:
        visit(tree, "")
    return out


FACTS = "file string, kind string, function string, line int, name string, detail string, n int"
#: Calls that make a failure visible, by the last part of their name (fixed values).
VISIBLE_CALLS = frozenset("error warning warn exception critical fatal print fail exit abort write print_exc add_error".split())
BROAD = frozenset(("Exception", "BaseException"))


def facts(file: str, text: str | None) -> list[tuple]:
    """What rules ask about a file: handlers, properties without a value, literal lists, versions, patches of tests."""
    tree = parse(text)
    out: list[tuple] = []

    def patch_target(call: ast.Call) -> tuple[str, str] | None:
        name = dotted(call.func) or ""
        tail = name.split(".")
        strings = [a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else None for a in call.args]
        if tail[-1] == "patch" and strings[:1] and strings[0]:
            return "patch", strings[0]
        if tail[-2:] in (["patch", "object"], ["monkeypatch", "setattr"], ["monkeypatch", "delattr"], ["monkeypatch", "setitem"], ["monkeypatch", "delitem"]):
            if len(call.args) > 1 and strings[1] and (d := dotted(call.args[0])):
                return ".".join(tail[-2:]), f"{d}.{strings[1]}"
            return (".".join(tail[-2:]), strings[0]) if strings[:1] and strings[0] else None
        if tail[-2:] == ["patch", "dict"] and call.args:
            target = strings[0] or dotted(call.args[0])
            return ("patch.dict", target) if target else None
        if tail[-2:] in (["monkeypatch", "setenv"], ["monkeypatch", "delenv"]) and strings[:1] and strings[0]:
            return ".".join(tail[-2:]), f"os.environ.{strings[0]}"
        return None

    def handler(h: ast.ExceptHandler, scope: str) -> None:
        types = [dotted(t) or "" for t in (h.type.elts if isinstance(h.type, ast.Tuple) else [h.type])] if h.type is not None else []
        body = [n for b in h.body for n in ast.walk(b)]
        told = any(
            isinstance(n, ast.Raise) or (isinstance(n, ast.Name) and n.id == h.name) or (isinstance(n, ast.Call) and (dotted(n.func) or "").split(".")[-1] in VISIBLE_CALLS)
            for n in body
        )
        kind = "bare" if h.type is None else "broad" if BROAD & {t.split(".")[-1] for t in types} else "narrow"
        out.append((file, "HANDLER", scope, h.lineno, kind, "told" if told else "silent", len(h.body)))

    def visit(node: ast.AST, scope: str) -> None:
        for n in ast.iter_child_nodes(node):
            here = scope
            if isinstance(n, (*_DEF, ast.ClassDef)):
                here = f"{scope}.{n.name}" if scope else n.name
            if isinstance(n, _DEF):
                names = {dotted(d) for d in n.decorator_list}
                gives = any(isinstance(x, (ast.Raise, ast.Yield, ast.YieldFrom)) or (isinstance(x, ast.Return) and x.value is not None) for x in own(n))
                if "property" in names and not gives and not any((d or "").endswith("abstractmethod") for d in names):
                    out.append((file, "NO_VALUE", here, n.lineno, n.name, None, None))
                decorators = [d for d in n.decorator_list if isinstance(d, ast.Call)]
                for d in decorators:
                    if hit := patch_target(d):
                        out.append((file, "PATCH", here, d.lineno, hit[0], hit[1], None))
            elif isinstance(n, ast.ExceptHandler):
                handler(n, scope)
            elif isinstance(n, ast.Call) and (hit := patch_target(n)) and not (isinstance(node, _DEF) and n in node.decorator_list):
                out.append((file, "PATCH", scope, n.lineno, hit[0], hit[1], None))
            elif isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                name = n.targets[0].id
                if isinstance(n.value, (ast.List, ast.Set, ast.Tuple)) and n.value.elts and all(isinstance(e, ast.Constant) and isinstance(e.value, str) for e in n.value.elts):
                    out.append((file, "LITERALS", scope, n.lineno, name, None, len(n.value.elts)))
                if name == "__version__" and isinstance(n.value, ast.Constant):
                    out.append((file, "VERSION", scope, n.lineno, name, str(n.value.value), None))
            visit(n, here)

    if tree is not None:
        visit(tree, "")
    return out


def fact_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(facts, FACTS), FACTS)


def _table(fn: Callable[[str, str | None], list[tuple]], schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += fn(p, t)
                except RecursionError:
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return run


def element_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(elements, ELEMENTS), ELEMENTS)


def import_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(imports, IMPORTS), IMPORTS)


def symbol_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(used_symbols, "file string, symbol string"), "file string, symbol string")


def event_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(events, EVENTS), EVENTS)


EVIDENCE = "file string, function string, variable string, line int, kind string, detail string"


def shape(v: ast.AST | None) -> str:
    """What an assigned value looks like."""
    if isinstance(v, ast.Dict):
        return "dict(" + ", ".join(repr(k.value) for k in v.keys if isinstance(k, ast.Constant)) + ")"
    if isinstance(v, (ast.List, ast.Set, ast.Tuple, ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Lambda, ast.JoinedStr)):
        return type(v).__name__.lower()
    if isinstance(v, ast.Constant):
        return type(v.value).__name__
    if isinstance(v, ast.Call):
        return f"call {dotted(v.func) or ''}"
    return dotted(v) or type(v).__name__.lower() if v is not None else "none"


def type_evidence(file: str, text: str | None) -> list[tuple]:
    """What tells the type of a variable: annotations, shapes of assigned values, narrowing tests."""
    tree = parse(text)
    out: list[tuple] = []

    def visit(node: ast.AST, scope: str) -> None:
        for n in ast.iter_child_nodes(node):
            here = f"{scope}.{n.name}" if scope and isinstance(n, (*_DEF, ast.ClassDef)) else n.name if isinstance(n, (*_DEF, ast.ClassDef)) else scope
            if isinstance(n, _DEF):
                for a in n.args.posonlyargs + n.args.args + n.args.kwonlyargs:
                    if a.annotation is not None:
                        out.append((file, here, a.arg, n.lineno, "parameter", ast.unparse(a.annotation)))
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                out.append((file, here, n.target.id, n.lineno, "annotation", ast.unparse(n.annotation)))
            elif isinstance(n, ast.Assign):
                out.extend((file, here, t.id, n.lineno, "assigned", shape(n.value)) for t in n.targets if isinstance(t, ast.Name))
            elif isinstance(n, ast.Call) and dotted(n.func) == "isinstance" and len(n.args) == 2 and isinstance(n.args[0], ast.Name):
                out.append((file, here, n.args[0].id, n.lineno, "narrowed", ast.unparse(n.args[1])))
            visit(n, here)

    if tree is not None:
        visit(tree, "")
    return out


def evidence_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(type_evidence, EVIDENCE), EVIDENCE)


SIMILAR = "file string, name string, line int, other string, other_line int, similarity double"


def similar_functions(file: str, text: str | None, least: float = 0.5, lines: int = 8, top: int = 5) -> list[tuple]:
    """Pairs of longer functions of one file with alike token counts, the most telling first."""
    import io
    import math
    import tokenize
    from collections import Counter

    tree = parse(text)
    if tree is None:
        return []
    source = (text or "").split("\n")
    found = []
    for n in ast.walk(tree):
        if isinstance(n, _DEF) and n.end_lineno - n.lineno + 1 >= lines:
            body = "\n".join(source[n.body[0].lineno - 1 : n.end_lineno])
            words: Counter = Counter()
            try:
                for t in tokenize.generate_tokens(io.StringIO(body).readline):
                    if t.type in (tokenize.NAME, tokenize.OP):
                        words[t.string] += 1
            except (tokenize.TokenError, IndentationError, SyntaxError):
                pass
            found.append((n, words, math.sqrt(sum(v * v for v in words.values())) or 1.0))
    pairs = []
    for i, (a, u, x) in enumerate(found):
        for b, v, y in found[i + 1 :]:
            s = sum(c * v[w] for w, c in u.items()) / (x * y)
            if s >= least:
                size = (a.end_lineno - a.lineno + 1) + (b.end_lineno - b.lineno + 1)
                pairs.append((-s * math.sqrt(size), (file, a.name, a.lineno, b.name, b.lineno, s)))
    return [p for _, p in sorted(pairs)[:top]]


def similar_table(files: DataFrame) -> DataFrame:
    return files.select("path", "text").mapInArrow(_table(similar_functions, SIMILAR), SIMILAR)
