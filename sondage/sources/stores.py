"""Stores that Spark has no reader for: SQLite, office files, version history, the running system.

Each is a Python data source; SQLite tables and histories are split into
partitions, so that no one task reads all of a large one.
"""

from __future__ import annotations

import io
import os
import re
import sqlite3
import subprocess
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = (("INT", "bigint"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"))


class Range(InputPartition):
    def __init__(self, lo, hi):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", 4)), schema

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            kind = con.execute("select type from sqlite_master where name = ?", (self.table,)).fetchone()
            try:
                if kind and kind[0] == "view":
                    return [Range(None, None)]
                lo, hi = con.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a table without row ids
                return [Range(None, None)]
        if lo is None:
            return [Range(0, -1)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [Range(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        cols = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        where = "" if partition.lo is None else f" where rowid between {partition.lo} and {partition.hi}"
        cast = {"bigint": int, "double": float, "boolean": bool}
        kinds = [cast.get(f.dataType.simpleString(), str) for f in self.schema.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for row in con.execute(f'select {cols} from "{self.table}"{where}'):
                yield tuple(None if v is None else v.hex() if isinstance(v, bytes) else k(v) for v, k in zip(row, kinds))


class SqliteSource(DataSource):
    """``spark.read.format("sondage_sqlite").option("path", ...).option("table", ...)``"""

    @classmethod
    def name(cls):
        return "sondage_sqlite"

    def schema(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            cols = con.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        kind = lambda t: next((s for k, s in _TYPES if k in (t or "").upper()), "string")
        return ", ".join(f"`{c[1]}` {kind(c[2])}" for c in cols)

    def reader(self, schema):
        return SqliteReader(self.options, schema)


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sondage_sqlite").option("path", path).option("table", table).option("partitions", partitions).load()


def sqlite_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per column, index and foreign key: kind, table_name, name, type, nullable, is_key, target."""
    rows = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        for kind, table in con.execute("select type, name from sqlite_master where type in ('table', 'view') and name not like 'sqlite_%' order by name").fetchall():
            for c in con.execute(f'pragma table_info("{table}")'):
                rows.append(("column", table, c[1], c[2], not (c[3] or c[5]), bool(c[5]), c[4]))
            for i in con.execute(f'pragma index_list("{table}")').fetchall():
                cols = ",".join(str(x[2]) for x in con.execute(f'pragma index_info("{i[1]}")'))
                rows.append(("index", table, i[1], "unique" if i[2] else "", None, None, cols))
            for k in con.execute(f'pragma foreign_key_list("{table}")'):
                rows.append(("foreign_key", table, k[3], k[6], None, None, f"{k[2]}.{k[4]}"))
            rows.append((kind, table, table, "", None, None, None))
    return spark.createDataFrame(rows, "kind string, table_name string, name string, type string, nullable boolean, is_key boolean, target string")


# --- office files ------------------------------------------------------------------------------------------------

_NS = re.compile(r"^\{.*\}")


def column_index(letters: str) -> int:
    """``A`` is 0, ``AA`` is 26."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _tag(e) -> str:
    return _NS.sub("", e.tag)


def workbook_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of every cell of a workbook that holds something; rows and columns from 0."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for s in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
        target = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        for c in (e for e in ET.fromstring(z.read(part)).iter() if _tag(e) == "c"):
            m = re.match(r"([A-Z]+)(\d+)$", c.get("r", ""))
            v = next((x.text for x in c.iter() if _tag(x) in ("v", "t")), None)
            if m and v is not None:
                yield s.get("name"), int(m.group(2)) - 1, column_index(m.group(1)), shared[int(v)] if c.get("t") == "s" else v


def workbook_parts(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(kind, sheet, name, value): formulas, defined names, external connections, query code and model tables of a workbook."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    book = ET.fromstring(z.read("xl/workbook.xml"))
    for e in book.iter():
        if _tag(e) == "definedName":
            yield "name", "", e.get("name", ""), e.text or ""
        if _tag(e) == "sheet":
            target = rels[next(v for k, v in e.attrib.items() if k.endswith("}id"))].lstrip("/")
            for c in (x for x in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if _tag(x) == "c"):
                f = next((x.text for x in c if _tag(x) == "f"), None)
                if f:
                    yield "formula", e.get("name", ""), c.get("r", ""), f"={f}"
    if "xl/connections.xml" in names:
        for c in (x for x in ET.fromstring(z.read("xl/connections.xml")).iter() if _tag(x) == "connection"):
            inner = next((x.get("connection") for x in c if x.get("connection")), None)
            yield "connection", "", c.get("name", ""), inner or c.get("description", "") or ""
    for n in sorted(names):
        if re.fullmatch(r"customXml/item\d+\.xml", n) and b"DataMashup" in (raw := z.read(n)):
            yield from _query_code(raw)
        if re.fullmatch(r"xl/model/.*", n):
            yield "model", "", n, str(z.getinfo(n).file_size)
        if re.fullmatch(r"xl/tables/table\d+\.xml", n):
            t = ET.fromstring(z.read(n))
            yield "table", "", t.get("displayName", t.get("name", "")), t.get("ref", "")


def _query_code(raw: bytes) -> Iterator[tuple[str, str, str, str]]:
    """The queries in a mashup part: a package inside base64, after its length."""
    import base64

    text = "".join(ET.fromstring(raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8").encode("utf-8") if raw[:2] not in (b"\xff\xfe", b"\xfe\xff") else raw).itertext())
    data = base64.b64decode(text)
    size = int.from_bytes(data[4:8], "little")
    inner = zipfile.ZipFile(io.BytesIO(data[8 : 8 + size]))
    for n in inner.namelist():
        if n.endswith(".m"):
            code = inner.read(n).decode("utf-8", "replace")
            for m in re.finditer(r'shared\s+(#"[^"]+"|\w+)\s*=\s*(.*?);\s*(?=shared\s|\Z)', code, re.S):
                yield "query", "", m.group(1).strip('#"'), m.group(2).strip()


def book_parts(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, kind string, sheet string, name string, value string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_office(workbook_parts, schema), schema)


def paragraphs(data: bytes) -> Iterator[tuple[str, int, str]]:
    """(part, number, text) of the paragraphs of a text document, slides or an open document."""
    z = zipfile.ZipFile(io.BytesIO(data))
    parts = [n for n in z.namelist() if re.fullmatch(r"word/document\.xml|ppt/slides/slide\d+\.xml|content\.xml", n)]
    for part in sorted(parts, key=lambda n: (len(n), n)):
        for i, p in enumerate(e for e in ET.fromstring(z.read(part)).iter() if _tag(e) in ("p", "h")):
            text = "".join(p.itertext()) if part == "content.xml" else "".join(t.text or "" for t in p.iter() if _tag(t) == "t")
            if text.strip():
                yield part, i, text


def _office(fn, schema):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            rows = []
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(p, *r) for r in fn(data)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return run


def cells(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, sheet string, row int, col int, value string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_office(workbook_cells, schema), schema)


def cell_range(df: DataFrame, ref: str) -> DataFrame:
    """``A1:C10`` of the cells."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)(?::([A-Za-z]+)(\d+))?", ref.strip())
    if not m:
        raise ValueError(f"no cell range: {ref}")
    a, lo, b, hi = m.group(1), int(m.group(2)), m.group(3) or m.group(1), int(m.group(4) or m.group(2))
    return df.where(F.col("row").between(lo - 1, hi - 1) & F.col("col").between(column_index(a), column_index(b)))


def document_text(spark: SparkSession, path: str) -> DataFrame:
    schema = "path string, part string, number int, text string"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_office(paragraphs, schema), schema)


# --- version history ---------------------------------------------------------------------------------------------


def git(repo: str, *args: str, given: str | None = None) -> str:
    run = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, timeout=600, input=None if given is None else given.encode())
    if run.returncode:
        raise RuntimeError(run.stderr.decode("utf-8", "replace")[-500:])
    return run.stdout.decode("utf-8", "replace")


def is_repository(path: str) -> bool:
    try:
        return bool(git(path, "rev-parse", "--verify", "-q", "HEAD"))
    except (RuntimeError, OSError):
        return False


class Commits(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class HistoryReader(DataSourceReader):
    """Commits in slices of the list of commits."""

    def __init__(self, options):
        self.repo, self.ref, self.files, self.slice = options["path"], options.get("ref", "HEAD"), options.get("files", "false") == "true", int(options.get("slice", 2000))
        self.pickaxe = options.get("pickaxe")

    def _git(self, *args, given: str | None = None) -> str:
        return git(self.repo, *args, given=given)

    def partitions(self):
        """The list of commits is walked once; each slice holds its own commits by name."""
        names = self._git("rev-list", self.ref).split()
        return [Commits(names[lo : lo + self.slice]) for lo in range(0, len(names), self.slice)] or [Commits([])]

    def read(self, partition):
        fmt = "%x01%H%x00%P%x00%an%x00%ae%x00%at%x00%s"
        if not partition.names:
            return
        search = ["-G", self.pickaxe] if self.pickaxe else []
        out = self._git("log", "--no-walk=unsorted", "--stdin", f"--format={fmt}", *search, *(["--numstat"] if self.files else []), given="\n".join(partition.names))
        for entry in out.split("\x01")[1:]:
            head, _, rest = entry.partition("\n")
            h, parents, author, email, ts, subject = head.split("\x00")
            base = (h, parents.split(), author, email, int(ts), subject)
            if not self.files:
                yield base
                continue
            for line in rest.strip().split("\n"):
                if line.count("\t") == 2:
                    a, d, p = line.split("\t")
                    yield (*base, p, int(a) if a.isdigit() else None, int(d) if d.isdigit() else None)


class HistorySource(DataSource):
    @classmethod
    def name(cls):
        return "sondage_history"

    def schema(self):
        base = "hash string, parents array<string>, author string, email string, ts bigint, subject string"
        return base + (", path string, added int, removed int" if self.options.get("files", "false") == "true" else "")

    def reader(self, schema):
        return HistoryReader(self.options)


def history(spark: SparkSession, repo: str, ref: str = "HEAD", files: bool = False, pickaxe: str | None = None) -> DataFrame:
    """Commits, or with ``files`` one row per commit and file it touches; ``pickaxe``: only those whose changed lines match.

    The repository must be reachable by its path on every executor.
    """
    spark.dataSource.register(HistorySource)
    return spark.read.format("sondage_history").option("path", repo).option("ref", ref).option("files", str(files).lower()).options(**({"pickaxe": pickaxe} if pickaxe else {})).load()


def blame(spark: SparkSession, repo: str, path: str, ref: str = "HEAD", ignore: list[str] | None = None, lines: str | None = None) -> DataFrame:
    """Who last changed each line of a file: line, hash, author, email, ts, subject, text. ``ignore``: commits to look through; ``lines``: ``10,20``."""
    args = [x for h in ignore or [] for x in ("--ignore-rev", h)] + (["-L", lines] if lines else [])
    out, seen, here = [], {}, None
    for x in git(repo, "blame", "--line-porcelain", *args, ref, "--", path).split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", x):
            here = seen.setdefault(m.group(1), {"hash": m.group(1)})
            at = int(m.group(2))
        elif x.startswith("\t"):
            out.append((at, here["hash"], here.get("author"), (here.get("author-mail") or "").strip("<>"), int(here.get("author-time", 0)), here.get("summary"), x[1:]))
        elif here is not None and " " in x:
            k, _, v = x.partition(" ")
            here[k] = v
    return spark.createDataFrame(out, "line int, hash string, author string, email string, ts bigint, subject string, text string")


def file_at(spark: SparkSession, repo: str, path: str, ref: str) -> DataFrame:
    return spark.createDataFrame([(path, git(repo, "show", f"{ref}:{path}"))], "path string, text string")


def file_diff(spark: SparkSession, repo: str, path: str, old: str, new: str = "HEAD", context: int = 3) -> DataFrame:
    """Lines of the difference of a file between two refs: hunk, kind (+, -, space), line_old, line_new, text."""
    out, hunk, a, b = [], 0, 0, 0
    for x in git(repo, "diff", f"-U{context}", old, new, "--", path).split("\n"):
        if m := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)", x):
            hunk, a, b = hunk + 1, int(m.group(1)), int(m.group(2))
        elif hunk and x[:1] in ("+", "-", " "):
            out.append((hunk, x[0], a if x[0] != "+" else None, b if x[0] != "-" else None, x[1:]))
            a, b = a + (x[0] != "+"), b + (x[0] != "-")
    return spark.createDataFrame(out, "hunk int, kind string, line_old int, line_new int, text string")


def refs(spark: SparkSession, repo: str) -> DataFrame:
    """Branches and tags: kind, name, hash, ts, subject."""
    out = []
    for x in git(repo, "for-each-ref", "--format=%(refname)%00%(objectname)%00%(creatordate:unix)%00%(subject)", "refs/heads", "refs/tags").split("\n"):
        if x:
            name, h, ts, subject = x.split("\x00")
            out.append(("branch" if name.startswith("refs/heads/") else "tag", name.split("/", 2)[2], h, int(ts or 0), subject))
    return spark.createDataFrame(out, "kind string, name string, hash string, ts bigint, subject string")


def noise(commits: DataFrame) -> DataFrame:
    """Commits that change looks only, by their subject: formatting, renaming, license heads."""
    return commits.where(F.lower("subject").rlike(r"\b(reformat|format(ting)?|prettier|black|isort|gofmt|rustfmt|lint(ing)?|whitespace|line endings|license headers?|mass rename)\b"))


# --- the running system ------------------------------------------------------------------------------------------


def environment(spark: SparkSession) -> DataFrame:
    from ..functions.text import categorize, redact

    rows = spark.createDataFrame(sorted(os.environ.items()), "name string, value string")
    return rows.select("name", categorize(F.col("name")).alias("category"), redact(F.col("name"), F.col("value")).alias("value"))


def packages(spark: SparkSession) -> DataFrame:
    from importlib.metadata import distributions

    rows = sorted({(d.metadata["Name"] or "", d.version or "") for d in distributions()})
    return spark.createDataFrame(rows or [("", "")], "package string, version string")


def importable() -> list[str]:
    """Names of installed packages as they are imported."""
    from importlib import metadata

    return sorted(metadata.packages_distributions())


def project_version(texts: DataFrame) -> str | None:
    """The version that a project file states, where one does."""
    one = texts.where(F.col("path").rlike(r"(^|/)pyproject\.toml$")).orderBy(F.length("path"), "path").select(F.regexp_extract("text", r'(?m)^version\s*=\s*"([^"]+)"', 1).alias("v")).first()
    return one.v if one and one.v else None


def interpreter_facts(what: str, root: str = ".") -> list[tuple[str, str, str]]:
    """(name, value, state) about the interpreter: version, env, venv, syspath, imports, module/<name>, doctor, debug/bytecode."""
    import importlib.util
    import platform
    import sys
    from pathlib import Path

    text = lambda v: "" if v is None else str(v)
    in_venv = sys.prefix != sys.base_prefix
    twice = [p for i, p in enumerate(sys.path) if p in sys.path[:i]]

    def stale() -> list[tuple[str, str, str]]:
        out = []
        for pyc in Path(root).rglob("__pycache__/*.pyc"):
            source = pyc.parent.parent / (pyc.name.split(".")[0] + ".py")
            state = "warning" if not source.exists() else "failure" if source.stat().st_mtime > pyc.stat().st_mtime else "pass"
            if state != "pass":
                out.append((str(pyc), "no source" if state == "warning" else "older than its source", state))
        return out

    if what == "version":
        return [("version", platform.python_version(), "pass"), ("implementation", platform.python_implementation(), "pass"), ("compiler", platform.python_compiler(), "pass"), ("build", " ".join(platform.python_build()), "pass"), ("executable", sys.executable, "pass"), ("platform", platform.platform(), "pass")]
    if what == "env":
        flags = [(f"flag {n}", text(getattr(sys.flags, n)), "pass") for n in ("dont_write_bytecode", "optimize", "utf8_mode", "isolated", "dev_mode")]
        return [("encoding", sys.getdefaultencoding(), "pass"), ("filesystem encoding", sys.getfilesystemencoding(), "pass"), ("prefix", sys.prefix, "pass"), *flags]
    if what == "venv":
        return [("active", text(in_venv).lower(), "pass" if in_venv else "warning"), ("prefix", sys.prefix, "pass"), ("base", sys.base_prefix, "pass"), ("VIRTUAL_ENV", text(os.environ.get("VIRTUAL_ENV")), "pass")]
    if what == "syspath":
        return [(str(i), p or os.getcwd(), "warning" if p in twice or (p and not os.path.exists(p)) else "pass") for i, p in enumerate(sys.path)]
    if what == "imports":
        return sorted((n, text(getattr(m, "__file__", None)), "pass") for n, m in list(sys.modules.items()) if "." not in n)
    if what.startswith("module/"):
        name = what[7:]
        try:
            spec = importlib.util.find_spec(name)
        except (ImportError, ValueError):
            spec = None
        here = [p for p in sys.path if p and (os.path.exists(os.path.join(p, *name.split("."), "__init__.py")) or os.path.exists(os.path.join(p, *name.split(".")) + ".py"))]
        return [(name, text(spec.origin if spec else None), "pass" if spec else "failure"), *(("candidate", p, "warning" if len(here) > 1 else "pass") for p in here)]
    if what == "debug/bytecode":
        return stale()
    if what == "doctor":
        old = stale()
        return [
            ("venv", text(in_venv).lower(), "pass" if in_venv else "warning"), ("path entries twice", text(len(twice)), "warning" if twice else "pass"),
            ("path entries missing", text(sum(bool(p) and not os.path.exists(p) for p in sys.path)), "pass"), ("stale bytecode", text(len(old)), "warning" if old else "pass"),
            ("version", platform.python_version(), "pass" if sys.version_info >= (3, 10) else "warning"),
        ]
    raise ValueError(f"nothing known of {what!r}")
