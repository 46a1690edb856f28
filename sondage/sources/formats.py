"""Structure of files as one table: path, format, category, name, line, level, detail.

One reader per format, chosen by file extension; readers run where the text is
read. A file that its reader cannot parse gives one row of category ``error``.
"""

from __future__ import annotations

import ast
import configparser
import csv
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

STRUCTURE = "path string, format string, category string, name string, line int, level int, detail string"
Row = tuple  # category, name, line, level, detail
Reader = Callable[[str], Iterator[Row]]
READERS: dict[str, tuple[str, Reader]] = {}


def extensions() -> dict[str, str]:
    """Every known ending with its format."""
    return {e: name for e, (name, _) in READERS.items()}


def reader(name: str, *extensions: str):
    """Register a reader for extensions; a later one replaces an earlier one."""

    def register(fn: Reader) -> Reader:
        for e in extensions:
            READERS[e] = (name, fn)
        return fn

    return register


def _kind(v) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "float", type(None): "null"}.get(type(v), "value")


@reader("markdown", "md", "markdown", "mdx")
def markdown(text: str) -> Iterator[Row]:
    lines = text.split("\n")
    start = 0
    if lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        if end is None:
            yield "frontmatter", "malformed", 1, None, None
        else:
            key = None
            for i, x in enumerate(lines[1:end], 2):
                if m := re.match(r"([\w-]+):\s*(.*)$", x):
                    key = m.group(1)
                    yield "frontmatter", key, i, None, m.group(2).strip().strip("'\"")
                elif key and (m := re.match(r"\s*-\s+(.*)$", x)):
                    yield "frontmatter_item", key, i, None, m.group(1).strip()
            start = end + 1
    fence = None
    for i, x in enumerate(lines[start:], start + 1):
        if m := re.match(r"\s*(```|~~~)\s*(\w*)", x):
            if fence is None:
                fence = (i, m.group(2))
            else:
                yield "code_block", fence[1] or "text", fence[0], None, str(i - fence[0] - 1)
                fence = None
            continue
        if fence:
            continue
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", x):
            yield "heading", m.group(2), i, len(m.group(1)), None
        for m in re.finditer(r"(!?)\[([^\]]*)\]\(([^)\s]+)[^)]*\)", x):
            yield "image" if m.group(1) else "link", m.group(2), i, None, m.group(3)
        for m in re.finditer(r"(?<!`)`([^`\n]+)`(?!`)", x):
            yield "inline_code", m.group(1), i, None, None
    if fence:
        yield "code_block", fence[1] or "text", fence[0], None, "open"


class _Html(HTMLParser):
    SEMANTIC = {"nav": "navigation", "header": "navigation", "main": "content", "article": "content", "section": "content", "footer": "content", "form": "forms", "input": "forms", "img": "media", "video": "media", "audio": "media", "table": "content"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[Row] = []
        self.text_of: str | None = None

    def handle_starttag(self, tag, attrs):
        a, line = dict(attrs), self.getpos()[0]
        self.text_of = tag if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6") else self.text_of
        if tag == "a":
            self.rows.append(("link", link_type(a.get("href")), line, None, a.get("href")))
        elif tag == "script":
            self.rows.append(("script", "external" if a.get("src") else "inline", line, None, a.get("src")))
        elif tag == "style" or (tag == "link" and a.get("rel") == "stylesheet"):
            self.rows.append(("style", "external" if tag == "link" else "inline", line, None, a.get("href")))
        elif tag == "meta":
            self.rows.append(("meta", a.get("name") or a.get("property") or "", line, None, a.get("content")))
        elif tag == "link":
            self.rows.append(("meta", a.get("rel") or "", line, None, a.get("href")))
        if tag in self.SEMANTIC:
            self.rows.append((self.SEMANTIC[tag], tag, line, None, a.get("id")))

    def handle_data(self, data):
        if self.text_of and data.strip():
            level = int(self.text_of[1]) if self.text_of[0] == "h" and self.text_of[1:].isdigit() else None
            self.rows.append(("heading" if level else "title", data.strip(), self.getpos()[0], level, None))

    def handle_endtag(self, tag):
        if tag == self.text_of:
            self.text_of = None


def link_type(href: str | None) -> str:
    h = (href or "").strip().lower()
    for start, kind in (("#", "anchor"), ("mailto:", "mailto"), ("tel:", "tel"), ("http:", "external"), ("https:", "external"), ("//", "external"), ("/", "internal")):
        if h.startswith(start):
            return kind
    return "relative" if h else "empty"


@reader("html", "html", "htm", "xhtml")
def html(text: str) -> Iterator[Row]:
    p = _Html()
    p.feed(text)
    yield from p.rows
    for m in re.finditer(r"\{\{\s*([\w.]+)", text):
        yield "template_variable", m.group(1), text.count("\n", 0, m.start()) + 1, None, None


@reader("json", "json")
def json_file(text: str) -> Iterator[Row]:
    v = json.loads(text)
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield "key", str(k), None, 1, _kind(x)


@reader("jsonl", "jsonl", "ndjson")
def jsonl(text: str) -> Iterator[Row]:
    kinds: Counter = Counter()
    for i, x in enumerate(text.split("\n"), 1):
        if x.strip():
            try:
                v = json.loads(x)
                kinds[v.get("type", "unknown") if isinstance(v, dict) else _kind(v)] += 1
            except ValueError:
                yield "invalid", x[:80], i, None, None
    for k, n in kinds.items():
        yield "record_type", str(k), None, None, str(n)


@reader("yaml", "yaml", "yml")
def yaml(text: str) -> Iterator[Row]:
    for i, x in enumerate(text.split("\n"), 1):
        if m := re.match(r"( *)(?:- )?([\w.$/-]+):(?:\s+(.*))?$", x):
            yield "key", m.group(2), i, len(m.group(1)) // 2 + 1, (m.group(3) or "").strip() or None


@reader("toml", "toml")
def toml(text: str) -> Iterator[Row]:
    tomllib.loads(text)
    for i, x in enumerate(text.split("\n"), 1):
        if m := re.match(r"\s*\[{1,2}([^\]]+)\]{1,2}", x):
            yield "table", m.group(1).strip(), i, m.group(1).count(".") + 1, None
        elif m := re.match(r"\s*([\w.\"-]+)\s*=\s*(.*)$", x):
            yield "key", m.group(1).strip('"'), i, None, m.group(2)


@reader("ini", "ini", "cfg", "conf_ini", "properties", "service", "timer", "socket")
def ini(text: str) -> Iterator[Row]:
    p = configparser.ConfigParser(strict=False, allow_no_value=True, interpolation=None)
    p.optionxform = str
    p.read_string(text if re.search(r"^\s*\[", text, re.M) else "[DEFAULT]\n" + text)
    for s in ["DEFAULT", *p.sections()]:
        items = p.defaults().items() if s == "DEFAULT" else p._sections[s].items()
        if s != "DEFAULT" or items:
            yield "section", s, None, 1, str(len(items))
        for k, v in items:
            yield "key", f"{s}.{k}", None, 2, v


@reader("xml", "xml", "svg", "xsd", "pom")
def xml(text: str) -> Iterator[Row]:
    def go(e, depth):
        yield "element", e.tag.rpartition("}")[2], None, depth, json.dumps(e.attrib) if e.attrib else None
        for c in e:
            yield from go(c, depth + 1)

    yield from go(ET.fromstring(text), 1)


@reader("csv", "csv", "tsv")
def table(text: str) -> Iterator[Row]:
    lines = text.splitlines()
    try:
        delimiter = csv.Sniffer().sniff("\n".join(lines[:5]), delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = "\t" if "\t" in text[:1000] else ","
    rows = list(csv.reader(lines, delimiter=delimiter))
    for i, c in enumerate(rows[0] if rows else []):
        values = [r[i] if i < len(r) else "" for r in rows[1:]]
        blank = sum(not v.strip() for v in values)
        yield "column", c, 1, i, json.dumps({"missing": blank, "distinct": len(set(values)), "rows": len(values)})


@reader("notebook", "ipynb")
def notebook(text: str) -> Iterator[Row]:
    for i, c in enumerate(json.loads(text).get("cells", [])):
        src = "".join(c.get("source", []))
        yield "cell", c.get("cell_type", ""), None, i, src.split("\n")[0]


@reader("sql", "sql", "ddl")
def sql(text: str) -> Iterator[Row]:
    for m in re.finditer(r"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(table|view|index|function|procedure|trigger|type|schema)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", text, re.I):
        yield m.group(1).lower(), m.group(2).strip('"`[]'), text.count("\n", 0, m.start()) + 1, None, None


@reader("graphql", "graphql", "gql")
def graphql(text: str) -> Iterator[Row]:
    for m in re.finditer(r"^\s*(?:extend\s+)?(type|interface|enum|union|input|scalar|directive|query|mutation|subscription|fragment)\s+@?(\w+)", text, re.M):
        yield m.group(1), m.group(2), text.count("\n", 0, m.start(1)) + 1, None, None


@reader("protobuf", "proto")
def protobuf(text: str) -> Iterator[Row]:
    for m in re.finditer(r"^(\s*)(message|enum|service|rpc|package|import)\s+\"?([\w./]+)", text, re.M):
        yield m.group(2), m.group(3), text.count("\n", 0, m.start(2)) + 1, len(m.group(1)) // 2 + 1, None


@reader("nginx", "conf", "nginx", "vhost")
def nginx(text: str) -> Iterator[Row]:
    """Blocks and directives with their depth; a directive's detail is its arguments."""
    stack: list[str] = []
    for i, raw in enumerate(text.split("\n"), 1):
        line = re.sub(r"(^|\s)#.*$", "", raw).strip()
        while line:
            if line.startswith("}"):
                stack = stack[:-1]
                line = line[1:].strip()
            elif m := re.match(r"(\w+)\s*([^{;]*)\{", line):
                yield "block", m.group(1), i, len(stack), m.group(2).strip() or None
                stack.append(m.group(1))
                line = line[m.end() :].strip()
            elif m := re.match(r"([\w-]+)\s*([^;{}]*);", line):
                yield "directive", m.group(1), i, len(stack), m.group(2).strip() or None
                line = line[m.end() :].strip()
            else:
                break


@reader("dockerfile", "dockerfile")
def dockerfile(text: str) -> Iterator[Row]:
    for i, x in enumerate(text.split("\n"), 1):
        if m := re.match(r"([A-Z]+)\s+(.*)$", x):
            yield "instruction", m.group(1), i, None, m.group(2)


@reader("python", "py", "pyi")
def python(text: str) -> Iterator[Row]:
    from .python_code import elements

    ast.parse(text)
    for e in elements("", text):
        yield e[1], e[3], e[4], None, e[7] or None


#: Definitions and imports of other languages by line (fixed patterns): what, and how its name is written.
_C_LIKE = [("classes", r"^\s*(?:public |private |protected |abstract |final |static |sealed |export |default )*(?:class|interface|enum|record|struct|trait|object) (\w+)")]
LANGUAGES: dict[str, tuple[tuple[str, ...], list[tuple[str, str]]]] = {
    "javascript": (("js", "jsx", "ts", "tsx", "mjs", "cjs"), [*_C_LIKE, ("functions", r"^\s*(?:export )?(?:default )?(?:async )?function\*? (\w+)"), ("functions", r"^\s*(?:export )?(?:const|let|var) (\w+) = (?:async )?(?:\([^)]*\)|\w+) =>"), ("imports", r"""^\s*import .*?from ['"]([^'"]+)"""), ("imports", r"""require\(['"]([^'"]+)""")]),
    "go": (("go",), [("functions", r"^func (?:\([^)]*\) )?(\w+)"), ("classes", r"^type (\w+) (?:struct|interface)"), ("imports", r'^\s*(?:import )?(?:\w+ )?"([\w./-]+)"$')]),
    "rust": (("rs",), [("functions", r"^\s*(?:pub(?:\([^)]*\))? )?(?:async |const |unsafe )*fn (\w+)"), ("classes", r"^\s*(?:pub(?:\([^)]*\))? )?(?:struct|enum|trait|union) (\w+)"), ("imports", r"^\s*(?:pub )?use ([\w:]+)")]),
    "java": (("java", "kt", "scala", "groovy"), [*_C_LIKE, ("functions", r"^\s*(?:public |private |protected |static |final |abstract |override |suspend |synchronized )*(?:fun |def |[\w<>\[\], ?]+ )(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?[{=:]"), ("imports", r"^\s*import (?:static )?([\w.*]+)")]),
    "csharp": (("cs",), [*_C_LIKE, ("functions", r"^\s*(?:public |private |protected |internal |static |async |override |virtual )+[\w<>\[\], ?]+ (\w+)\s*\([^;]*\)\s*[{=]?$"), ("imports", r"^\s*using ([\w.]+);")]),
    "c": (("c", "h", "cc", "cpp", "hpp", "cxx"), [("classes", r"^\s*(?:class|struct|enum|union) (\w+)\s*[:{]"), ("functions", r"^[\w:*&<> ]+?[ *&](\w+)\([^;]*\)\s*(?:const )?\{?$"), ("imports", r'^\s*#include [<"]([\w./]+)[>"]')]),
    "ruby": (("rb", "rake"), [("classes", r"^\s*(?:class|module) ([\w:]+)"), ("functions", r"^\s*def (?:self\.)?(\w+[?!]?)"), ("imports", r"""^\s*require(?:_relative)? ['"]([^'"]+)""")]),
    "php": (("php",), [*_C_LIKE, ("functions", r"^\s*(?:public |private |protected |static )*function (\w+)"), ("imports", r"^\s*use ([\w\\]+)")]),
    "shell": (("sh", "bash", "zsh"), [("functions", r"^\s*(?:function )?(\w+)\s*\(\)\s*\{"), ("imports", r"^\s*(?:source|\.) (\S+)")]),
    "lua": (("lua",), [("functions", r"^\s*(?:local )?function ([\w.:]+)"), ("imports", r"""require\s*\(?['"]([^'"]+)""")]),
    "swift": (("swift",), [*_C_LIKE, ("functions", r"^\s*(?:public |private |static |override )*func (\w+)"), ("imports", r"^import (\w+)")]),
}


def _by_line(patterns: list[tuple[str, str]]) -> Reader:
    compiled = [(c, re.compile(p)) for c, p in patterns]

    def read(text: str) -> Iterator[Row]:
        for i, x in enumerate(text.split("\n"), 1):
            for c, p in compiled:
                for m in p.finditer(x):
                    yield c, m.group(1), i, (len(x) - len(x.lstrip())) // 2, x.strip()

    return read


for _language, (_extensions, _patterns) in LANGUAGES.items():
    reader(_language, *_extensions)(_by_line(_patterns))


def read_structure(path: str, text: str | None) -> list[tuple]:
    name = path.rsplit("/", 1)[-1].lower()
    ext = "dockerfile" if name.startswith("dockerfile") else name.rsplit(".", 1)[-1] if "." in name else ""
    if ext not in READERS and (m := re.match(r"#!.*?(python|bash|sh|ruby|node)\b", text or "")):
        ext = {"python": "py", "bash": "sh", "sh": "sh", "ruby": "rb", "node": "js"}[m.group(1)]
    if ext not in READERS:
        return []
    fmt, fn = READERS[ext]
    try:
        return [(path, fmt, *r) for r in fn(text or "")]
    except Exception as e:  # what a parser makes of broken input is a finding, not a failure
        return [(path, fmt, "error", type(e).__name__, None, None, str(e)[:200])]


def structure(files: DataFrame) -> DataFrame:
    """The structure table of files (path, text)."""
    kinds = [pa.int32() if c.endswith(" int") else pa.string() for c in STRUCTURE.split(", ")]
    names = [c.split()[0] for c in STRUCTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in read_structure(p, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, STRUCTURE)
