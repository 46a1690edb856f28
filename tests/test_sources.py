import json
import sqlite3
import subprocess
import zipfile

import pytest

from sondage.operators import checks
from sondage.operators import code as K
from sondage.operators import infra as I
from sondage.plans import api, facts
from sondage.sources import files as FS
from sondage.sources import formats as FM
from sondage.sources import python_code as P
from sondage.sources import stores

CORE = '''import os
import sys as system
from typing import Optional
from . import util
from .util import helper, unused_name


class Base(ABC):
    @property
    def size(self):
        return 1

    @staticmethod
    def bad(self):
        pass


class Child(Base):
    pass


def process(items, limit=None, a=1, b=2, c=3, d=4):
    total = 0
    for x in items:
        if x > limit and x or a:
            total += helper(x)
            open("f")
    system.exit(total)
    return total


def process_twin(items):
    rows = [i for i in items if i]
    return sorted(rows)


def process_copy(items):
    rows = [i for i in items if i]
    return sorted(rows)
'''
UTIL = '''import core
import requests


def helper(x):
    return requests.get(x)


def lonely():
    import json
    return data["k"]
'''
NGINX = """http {
  upstream a { server 10.0.0.1:80; server 10.0.0.1:80; }
  server {
    listen 443 ssl;
    server_name a.example;
    include common.conf;
    location / { proxy_pass http://a; }
  }
  server { listen 80; server_name b.example; ssl_certificate x; add_header Strict-Transport-Security 1; limit_req zone=z; }
}
"""
GUIDE = "---\ntitle: Guide\ntags:\n  - x\n  - y\n---\n# One\n[b](b.md) [w](https://w.example/) ![i](i.png)\n## Two\n```py\n# no heading\n```\nThe parser reads. TODO later \n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    for path, text in {
        "app/core.py": CORE, "app/util.py": UTIL, "app/__init__.py": "", "app/broken.py": "def (", "docs/a.md": GUIDE, "docs/b.md": "# B\n[a](a.md)\nhttp://plain.example/x\n", "conf/site.conf": NGINX,
        "web/i.html": '<html><head><title>T</title><script src="a.js"></script></head><body><nav></nav><a href="#x">x</a><a href="/y">y</a><a href="mailto:z@z.example">z</a>{{ user.name }}</body></html>',
        "d/x.json": '{"a": {"b": [1, {"c": null}]}, "n": 2}', "d/bad.json": "{", "d/l.jsonl": '{"type": "a"}\n{"type": "b"}\n{"type": "a"}\n', "d/t.csv": "id,name\n1,x\n2,\n3,x\n", "d/x.toml": "[a.b]\nk = 1\n",
        "d/x.ini": "[s]\nk = v\n", "d/x.xml": "<r><c a='1'/></r>", "d/x.sql": "CREATE TABLE IF NOT EXISTS t (id int);\ncreate unique index i on t(id);", "d/x.proto": "message M {\n  rpc X\n}", "d/x.graphql": "type Q { a: Int }",
        "d/Dockerfile": "FROM base:latest\nRUN x\n", "d/n.ipynb": '{"cells": [{"cell_type": "code", "source": ["x = 1"]}]}', "s/m.go": 'package m\n\nimport "fmt"\n\nfunc (s *S) Run() {\n}\n\ntype S struct {\n', "s/m.rs": "pub fn run() {}\nstruct T;\nuse std::io;\n", "s/m.ts": "export async function go() {}\nimport { a } from './b'\nclass C {}\n",
        "s/M.java": "import java.util.List;\npublic class M {\n  public static int run(int x) {\n", "s/tool": "#!/bin/bash\nf() {\n", "node_modules/x/y.py": "x = 1\n", "y.yaml": "a:\n  b: 1\n",
    }.items():
        f = d / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(d)


@pytest.fixture(scope="module")
def texts(spark, root):
    return FS.read_texts(spark, root).cache()


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_discovery(spark, root):
    found = rows(FS.discover(spark, root, ignore=["d/", "*.md", "!b.md"]), "path", "family")
    paths = {p for p, _ in found}
    assert "app/core.py" in paths and "docs/b.md" in paths and not any(p.startswith(("d/", "node_modules")) or p == "docs/a.md" for p in paths)
    assert ("app/core.py", "python") in found
    assert {r.family for r in FS.tally(FS.discover(spark, root)).collect()} >= {"python", "go", "rust"}


def test_python_elements_and_calls(spark, texts):
    e = P.element_table(texts.where("path like '%.py'")).cache()
    by = {r.qualified: r for r in e.collect()}
    assert by["process"].complexity == 5 and by["process"].depth == 2 and by["process"].n_args == 6 and by["process"].calls == ["helper", "open", "system.exit"]
    assert by["Base.size"].category == "methods" and by["Child"].bases == ["Base"]
    assert rows(K.callers(e, "helper"), "file", "caller") == {("app/core.py", "process")}
    assert {"lonely", "process", "bad"} <= rows(K.uncalled(e), "name") and "helper" not in rows(K.uncalled(e), "name")
    assert rows(K.call_closure(e, "helper", 3, True), "node") == {"process"}
    assert rows(K.implementations(e).where("child is not null"), "contract", "child") == {("Base", "Child")}


def test_imports(spark, texts):
    py = texts.where("path like '%.py'")
    imports, symbols = P.import_table(py).cache(), P.symbol_table(py)
    assert rows(K.unused_imports(imports, symbols), "file", "bound") == {("app/core.py", "os"), ("app/core.py", "Optional"), ("app/core.py", "util"), ("app/core.py", "unused_name"), ("app/util.py", "core"), ("app/util.py", "json")}
    edges = K.dependency_edges(imports, py.selectExpr("path as file"))
    assert {("app/core.py", "app/util.py"), ("app/util.py", "app/core.py")} <= rows(edges, "src", "dst")
    assert rows(K.package_counts(imports).where("kind = 'external'"), "package") == {"core", "requests"}
    codes = rows(K.element_findings(P.element_table(py), imports, symbols), "rule_code")
    assert {"R913", "B002", "D001", "I001", "I006"} <= codes and "T005" not in codes  # only what is annotated in part


def test_flow(spark, texts):
    e = P.event_table(texts.where("path = 'app/core.py'")).where("function = 'process'").cache()
    assert rows(K.inputs(e, 23, 27), "variable", "read_at", "written_at") == {("items", 24, 22), ("limit", 25, 22), ("a", 25, 22)}
    assert rows(K.outputs(e, 23, 27), "variable", "written_at", "used_at") == {("total", 26, 28)}
    assert rows(K.effects(e), "function") == {"process"} and {"EXIT", "LOOP", "GATE", "CALL_IN_LOOP"} <= rows(e, "kind")
    all_e = P.event_table(texts.where("path like '%.py'"))
    assert ("lonely", "data", 1) in rows(K.key_heatmap(all_e), "function", "variable", "keys")
    assert ("process", "http") in rows(K.effects_through_calls(all_e, P.element_table(texts.where("path like '%.py'"))), "node", "effect")


def test_structure_of_every_format(spark, texts):
    s = FM.structure(texts).cache()
    got = rows(s, "path", "category", "name")
    for want in [
        ("docs/a.md", "heading", "Two"), ("docs/a.md", "link", "b"), ("docs/a.md", "code_block", "py"), ("docs/a.md", "frontmatter", "title"), ("docs/a.md", "frontmatter_item", "tags"), ("web/i.html", "title", "T"),
        ("web/i.html", "link", "anchor"), ("web/i.html", "link", "internal"), ("web/i.html", "link", "mailto"), ("web/i.html", "template_variable", "user.name"), ("d/x.json", "key", "a"), ("d/bad.json", "error", "JSONDecodeError"),
        ("d/l.jsonl", "record_type", "a"), ("d/t.csv", "column", "name"), ("d/x.toml", "table", "a.b"), ("d/x.ini", "key", "s.k"), ("d/x.xml", "element", "c"), ("d/x.sql", "table", "t"), ("d/x.sql", "index", "i"),
        ("d/x.proto", "message", "M"), ("d/x.graphql", "type", "Q"), ("d/Dockerfile", "instruction", "FROM"), ("d/n.ipynb", "cell", "code"), ("s/m.go", "functions", "Run"), ("s/m.go", "classes", "S"), ("s/m.rs", "functions", "run"),
        ("s/m.ts", "functions", "go"), ("s/m.ts", "classes", "C"), ("s/M.java", "functions", "run"), ("s/tool", "functions", "f"), ("conf/site.conf", "directive", "listen"), ("app/broken.py", "error", "SyntaxError"), ("y.yaml", "key", "b"),
    ]:
        assert want in got, want
    assert "no heading" not in rows(s.where("category = 'heading'"), "name")


def test_web_server_findings(spark, texts):
    s = FM.structure(texts.where("path = 'conf/site.conf'"))
    hosts = {r.names: r for r in I.virtual_hosts(s).collect()}
    assert hosts["a.example"].secure and hosts["a.example"].forwards_to == "http://a" and not hosts["b.example"].secure and hosts["b.example"].hsts
    assert rows(I.server_findings(s), "rule_code") == {"N001", "N002", "N003", "N008", "N009", "N011", "N012"}


def test_facts_to_states(spark):
    import datetime as dt

    now = dt.date(2024, 1, 1)
    facts = spark.createDataFrame([("a.x.example", ["*.x.example"], now + dt.timedelta(90), now, False), ("b.y.example", ["*.x.example"], now + dt.timedelta(3), now, True), ("n.example", None, None, now, None)], "host string, names array<string>, not_after date, checked_at date, self_signed boolean")
    got = {(r.host, r.check): r.state for r in I.certificate_checks(facts).collect()}
    assert [got["a.x.example", k] for k in ("expiry", "hostname", "chain")] == ["pass"] * 3 and [got["b.y.example", k] for k in ("expiry", "hostname", "chain")] == ["failure"] * 3
    txt = spark.createDataFrame([("d", "d", "v=spf1 -all"), ("d", "_dmarc.d", "v=DMARC1; p=reject"), ("e", "e", "v=spf1 +all")], "domain string, name string, value string")
    assert {tuple(r) for r in I.mail_policy(txt).collect()} == {("d", "pass", "pass"), ("e", "failure", "warning")}
    log = spark.createDataFrame([(1, 'Checking the user "ann" now', 0), (2, "a.example", 1), (3, "ok", 2), (4, 'Checking the user "bob" now', 0), (5, "x", 2)], "n int, contents string, indent int").selectExpr("*", "'f' as file")
    assert [(r.n, r.user, r.domain) for r in I.run_log(log, ["n"]).orderBy("n").collect()] == [(1, "ann", None), (2, "ann", "a.example"), (3, "ann", "a.example"), (4, "bob", None), (5, "bob", None)]
    m = spark.createDataFrame([("s", 96, 100, 1, 1000, 0, 10, 0, 0)], "server string, connections int, max_connections int, buffer_reads int, buffer_requests int, full_scans int, queries int, disk_tmp int, tmp int")
    assert {(r.check, r.state) for r in I.database_health(m).collect()} == {("connections", "failure"), ("buffer_hit", "pass"), ("full_scans", "pass"), ("disk_tables", "warning")}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.executescript("create table users (id integer primary key, name text not null unique, score real); create table posts (id integer primary key, user_id integer not null references users(id), body blob); create view v as select * from users;")
        con.executemany("insert into users values (?, ?, ?)", [(i, f"u{i}", i / 2) for i in range(1, 101)])
    assert {tuple(r) for r in stores.sqlite_table(spark, path, "users", 3).collect()} == {(i, f"u{i}", i / 2) for i in range(1, 101)}
    assert stores.sqlite_table(spark, path, "posts").count() == 0 and stores.sqlite_table(spark, path, "v").count() == 100
    c = rows(stores.sqlite_catalog(spark, path), "kind", "table_name", "name", "target")
    assert ("foreign_key", "posts", "user_id", "users.id") in c and ("view", "v", "v", None) in c
    assert api.query(spark, f"sqlite://{path}#users?score>=49&sort=-id&limit=2").collect()[0].id == 100


def test_workbook_and_document(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="First" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>hello</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB2"><v>7</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "bad.xlsx").write_text("no zip")
    assert rows(stores.cells(spark, str(tmp_path / "*.xlsx")), "sheet", "row", "col", "value") == {("First", 0, 0, "hello"), ("First", 1, 27, "7")}
    assert rows(api.query(spark, f"xlsx://{tmp_path}/b.xlsx?range=A1:C9"), "value") == {"hello"}
    assert rows(stores.document_text(spark, str(tmp_path / "d.docx")), "text") == {"one two"}
    assert [stores.column_index(x) for x in ("A", "Z", "AA", "AB")] == [0, 25, 26, 27]


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x.example", *a], check=True, capture_output=True)
    git("init", "-q")
    for i, name in enumerate(["a", "b", "a"]):
        (tmp_path / name).write_text(f"{i}\n")
        git("add", "."), git("commit", "-qm", f"change {i}")
    assert rows(api.query(spark, f"git://{tmp_path}?subject~=change"), "subject") == {"change 0", "change 1", "change 2"}
    assert rows(api.query(spark, f"git://{tmp_path}?churn"), "path", "commits") == {("a", 2), ("b", 1)}
    assert rows(api.query(spark, f"git://{tmp_path}?ownership"), "path", "author", "share") == {("a", "Ann", 1.0), ("b", "Ann", 1.0)}
    assert api.query(spark, f"git://{tmp_path}?timeline=week").count() == 2


def test_addresses(spark, root):
    ask = lambda uri, *cols: rows(api.query(spark, uri), *cols)
    assert ask(f"code://{root}?type=functions&complexity>3&fields=name", "name") == {"process"}
    assert ask(f"code://{root}#helper", "file") == {"app/util.py"}
    assert ask(f"calls://{root}?target=helper", "caller") == {"process"} and ask(f"calls://{root}?callees=process&depth=2", "node") == {"helper", "get"}
    assert "lonely" in {q.split(".")[-1] for q in ask(f"calls://{root}?uncalled", "qualified")}
    assert ask(f"imports://{root}?circular", "node") == {"app/core.py", "app/util.py"}
    assert ("app/util.py", 1) in ask(f"depends://{root}", "dst", "dependents")
    assert ask(f"stats://{root}?functions>=2&sort=-functions&limit=1&fields=file", "file") == {"app/core.py"}
    assert ask(f"markdown://{root}?links", "src", "dst") == {("docs/a.md", "b.md"), ("docs/b.md", "a.md")}
    assert ask(f"markdown://{root}?aggregate=tags", "value", "n") == {("x", 1), ("y", 1)} and ask(f"markdown://{root}?missing=title", "path") == {"docs/b.md"}
    assert ask(f"markdown://{root}?search=parser", "path", "score") == {("docs/a.md", 1)}
    assert ask(f"json://{root}/d/x.json?gron", "path", "value") == {("json.a.b[0]", "1"), ("json.a.b[1].c", "null"), ("json.n", "2")}
    assert ask(f"json://{root}/d/x.json?keys", "key") == {"a", "n"} and ask(f"json://{root}/d/x.json#/a/b/0", "v") == {"1"} and ask(f"json://{root}/d/x.json?length&path=/a/b", "length") == {2}
    assert ask(f"jsonl://{root}/d/l.jsonl?types", "type", "n") == {("a", 2), ("b", 1)}
    assert ask(f"csv://{root}/d/t.csv?profile", "column_name", "missing", "inferred_type") == {("id", 0, "integer"), ("name", 1, "string")}
    assert {"M501", "X106", "S701", "N002", "I001", "X108"} <= ask(f"check://{root}", "rule_code")
    assert ask(f"check://{root}?select=N&severity=critical", "rule_code") == {"N002"}
    assert ask(f"grep://{root}?pattern=^class", "path") >= {"app/core.py", "s/m.ts"}
    assert ask(f"surface://{root}?surface=http", "function") == {"helper"} == ask(f"surface://{root}?type=http&source_only", "function")
    assert api.query(spark, f"pack://{root}?budget=50-lines").selectExpr("sum(cost) as c").first().c <= 50
    assert ask("help://", "scheme") >= {"code", "git", "sqlite"} and ask("env://?name=PATH", "name") == {"PATH"} and api.query(spark, "python://?package=pyspark").count() == 1
    for name in ("deps", "flow", "contracts", "trace", "testability", "hotspots", "overview", "architecture", "structure", "nginx", "patches", "files", "rules"):
        api.query(spark, f"{name}://{root}").collect()
    with pytest.raises(ValueError):
        api.query(spark, "nothing://x")


def test_meaning_of_rules(spark):
    from sondage.operators import code, documents
    from sondage.operators.rules import BUILTIN

    hits = lambda c, t, **kw: {(r.rule_code, r.severity) for r in checks.run_rules(spark.createDataFrame([(1, kw.get("path", "a.py"), t)], "id int, path string, text string"), "id", "text", BUILTIN.chosen(select=c), "path").collect()}
    assert hits("U501", "see http://github.com/a/b") == {("U501", "low")} and hits("U501", "http://other.example/a") == set()
    assert hits("M101", "x\n" * 499) == set() and hits("M101", "x\n" * 500) == {("M101", "medium")} and hits("M101", "x\n" * 1000) == {("M101", "high")}
    assert hits("E501", "x" * 101) == {("E501", "low")} and hits("E501", "x" * 101 + " https://a") == set()
    assert hits("S001", "password = 'k3yWith9digits'") == {("S001", "high")} and hits("S001", "password = 'placeholder1'") == set()
    assert hits("S701", "FROM ubuntu", path="Dockerfile") == {("S701", "medium")} and hits("S701", "FROM ubuntu:22.04", path="Dockerfile") == set() == hits("S701", "FROM ubuntu", path="a.py")
    body = "\n".join(f"    x{i} = {i}" for i in range(80))
    text = (
        f"def long():\n{body}\n\nclass A:\n    @property\n    def none(self):\n        self.x = 1\n    @property\n    def good(self):\n        return 1\n"
        "def f():\n    try:\n        g()\n    except Exception:\n        x = 1\n    try:\n        g()\n    except Exception as e:\n        log.error(e)\n    try:\n        g()\n    except (ValueError, BaseException):\n        logger.debug('x')\n"
        "NAMES = ['a', 'b', 'c', 'd', 'e']\nFEW = ['a']\n__version__ = '1.0'\n"
    )
    files = spark.createDataFrame([("pkg/a.py", text), ("pkg/json.py", "import os, nowhere\nfrom pkg import a\ndef k(): pass\n"), ("pkg/deep/er/logging.py", "x = 1\n")], "path string, text string")
    facts = P.fact_table(files)
    got = {(r.rule_code, r.severity, r.line) for r in code.element_findings(P.element_table(files), P.import_table(files), P.symbol_table(files)).where("file = 'pkg/a.py'").collect()}
    assert ("C902", "medium", 1) in got and not any(c == "B003" for c, _, _ in got)
    assert {(r.rule_code, r.line) for r in code.fact_findings(facts).collect()} == {("B004", 85), ("B006", 93), ("B006", 101), ("M104", 103)}
    found = {(r.file, r.rule_code) for r in code.module_findings(files, P.import_table(files), P.element_table(files), facts, ["numpy"], "2.0").collect()}
    assert found == {("pkg/json.py", "I004"), ("pkg/json.py", "M102"), ("pkg/json.py", "B005"), ("pkg/a.py", "M103")}
    docs = spark.createDataFrame([("docs/a.md", "[x](b.md) [y](../docs/./c.md#z) [w](https://a) [u](#here) [v](sub/) [t](../gone.md)"), ("docs/b.md", "[a](a.md) [c](c.md)"), ("docs/c.md", None), ("docs/sub/README.md", "")], "path string, text string")
    assert {(r.path, r.target) for r in documents.broken_links(docs).collect()} == {("docs/a.md", "../gone.md")}
    assert {(r.file, r.rule_code) for r in documents.findings(docs).collect()} == {("docs/a.md", "L001"), ("docs/a.md", "L004"), ("docs/c.md", "L005")}
    probes = spark.createDataFrame([("https://a", 404)], "url string, status int")
    assert documents.external_failures(docs, probes).count() == 1


def test_patches_by_target(spark):
    from sondage.operators import code

    text = (
        "@patch('app.core._load')\n@patch.object(core, 'save')\ndef test_a(x, y):\n    with patch('app.core._load'), mock.patch('sys.stdout'):\n        pass\n"
        "def test_b(monkeypatch):\n    monkeypatch.setattr(core, '_load', 1)\n    monkeypatch.setattr('app.core._load', 1)\n    monkeypatch.setenv('HOME', 'x')\n    patch(f())\n"
    )
    uses = code.patch_uses(P.fact_table(spark.createDataFrame([("tests/t.py", text)], "path string, text string")))
    got = {(r.group, r.n, r.tests, r.n_private, r.most, r.score) for r in code.patch_groups(uses).collect()}
    assert got == {("app.core._load", 3, 2, 3, 2, 4.5), ("core.save", 1, 1, 0, 1, 1.0), ("core._load", 1, 1, 1, 1, 1.5), ("os.environ.HOME", 1, 1, 0, 1, 1.0)}
    assert {r.group for r in code.patch_groups(uses, private=True, target="core._*").collect()} == {"core._load"} and code.patch_groups(uses, suppress=False).count() == 5
    assert {(r.group, r.n) for r in code.patch_groups(uses, "test", least=3).collect()} == {("tests/t.py::test_a", 3), ("tests/t.py::test_b", 3)}


def test_server_ranges(spark):
    from sondage.operators import infra

    text = (
        "http {\n  client_max_body_size 100m;\n  proxy_read_timeout 30s;\n  keepalive_timeout 500;\n  server {\n    listen 80;\n    return 301 https://x;\n  }\n"
        "  server {\n    listen 443 ssl;\n    ssl_certificate /c/a.pem;\n    ssl_stapling on;\n    location /.well-known/acme-challenge/ {\n      root /a;\n    }\n    location /api {\n      proxy_pass http://up;\n      auth_basic on;\n    }\n  }\n"
        "  server {\n    listen 80;\n    location /.well-known/acme-challenge/ { root /b; }\n  }\n  server {\n    listen 8080;\n    location /.well-known/acme-challenge/ { root /a; }\n  }\n}\n"
    )
    s = FM.structure(spark.createDataFrame([("n.conf", text)], "path string, text string"))
    assert {(r.rule_code, r.line) for r in infra.range_findings(s).collect()} == {("N005", 4), ("N006", 3), ("N004", 23)}
    certs = spark.createDataFrame([("/c/a.pem", None)], "path string, responder string")
    assert [r.line for r in infra.stapling_findings(s, certs).collect()] == [12]
    assert {(r.location, r.target) for r in infra.locations(s).collect()} == {("/.well-known/acme-challenge/", "/a"), ("/api", "http://up"), ("/.well-known/acme-challenge/", "/b")}
    assert {(r.port, r.secure, r.redirects) for r in infra.ports(s).collect()} == {(80, False, True), (443, True, False), (80, False, False), (8080, False, False)}
    assert [r.location for r in infra.access_control(s).collect()] == ["/api"]


def test_parameters(spark, root):
    ask = lambda uri, *cols: rows(api.query(spark, uri), *cols)
    assert "process" in ask(f"code://{root}?callers=0&fields=name", "name") and ask(f"code://{root}?callee_of=process&fields=name", "name") <= {"helper"}
    assert ask(f"code://{root}?callers>0&fields=name", "name") and ask(f"code://{root}?show=calls", "caller")
    for extra in ("decorator=*", "param_type=Optional*", "return_type=*", "has_annotations=false", "type_evidence=x", "show=dict-heatmap"):
        api.query(spark, f"code://{root}?{extra}").collect()
    assert ask(f"calls://{root}?modules", "src", "dst") >= {("app/core.py", "app/util.py")} and any("requests" in r.dst for r in api.query(spark, f"calls://{root}?modules&external").collect())
    assert any("->" in r.line for r in api.query(spark, f"calls://{root}?modules&format=dot").collect())
    assert "open" not in ask(f"calls://{root}?root=process", "node") and "open" in ask(f"calls://{root}?root=process&builtins", "node")
    assert ask(f"calls://{root}?uncalled&type=method", "category") <= {"methods"}
    assert api.query(spark, f"imports://{root}?rank=fan-in&top=1").count() == 1 and api.query(spark, f"depends://{root}?top=1").count() == 1
    assert {"package", "circular"} <= ask(f"deps://{root}", "section") and ask(f"deps://{root}?no_unused&no_circular&top=1", "section") == {"package"}
    assert ask(f"stats://{root}?min_functions=2&fields=file", "file") == {"app/core.py", "app/util.py"} and api.query(spark, f"stats://{root}?summary_only").count() == 1
    assert ask(f"stats://{root}?max_lines=1", "file") <= {"app/__init__.py", "app/broken.py"} and api.query(spark, f"hotspots://{root}?functions_only&min_complexity=1&top=2").count() == 2
    assert ask(f"json://{root}/d/x.json?type&path=/a/b", "type", "n") == {("array", 2)} and ask(f"json://{root}/d/x.json?flatten", "path")
    assert ask(f"markdown://{root}?link-graph", "path", "fan_in") >= {("docs/a.md", 1)} and ask(f"markdown://{root}?lint&lint-fields=title", "problem") >= {"missing title"}
    assert ask(f"markdown://{root}?body-contains=parser&explain", "path") == {"docs/a.md"} and ask(f"markdown://{root}?!title", "path") == {"docs/b.md"}
    assert "language" in ask(f"overview://{root}?no_git", "section") and "imported" not in ask(f"overview://{root}?no_imports&exclude=app/", "section")
    assert api.query(spark, f"architecture://{root}?top=1").count() == 1 and "rank" in api.query(spark, f"architecture://{root}?no_imports").columns
    assert api.query(spark, f"pack://{root}?budget=50-lines&content&architecture").where("tier = 'full'").count() >= 1
    for uri in ("testability://{}?top=3&min_categories=1&include_unresolved&tests=tests", "trace://{}?from=process", "contracts://{}?abstract_only&implementations=false", "patches://{}?group=file"):
        api.query(spark, uri.format(root)).collect()
    for element in ("ports", "locations", "auth", "config", "upstream"):
        api.query(spark, f"nginx://{root}#{element}").collect()
    for element in ("version", "env", "venv", "syspath", "imports", "module/json", "doctor", "packages/pyspark"):
        assert api.query(spark, f"python://{root}#{element}").count() > 0
    assert api.query(spark, f"python://{root}#module/no_such_thing").where("state = 'failure'").count() == 1
    assert ask("help://#analyzers", "extension") >= {"md", "py"} and ask("help://#rules", "rule_code") >= {"M101"} and ask("help://#adapters", "scheme") >= {"ssl", "transcripts"} and api.query(spark, "help://#config").count()


def test_budget_is_greedy(spark):
    from sondage.operators import scoring

    costs = [5, 30, 4, 9, 1, 8, 2, 100, 3]
    df = spark.createDataFrame(list(enumerate(costs)), "rank int, cost bigint")
    for most in (0, 3, 10, 20, 33, 200):
        kept, used = [], 0
        for i, c in enumerate(costs):
            if used + c <= most:
                kept, used = [*kept, i], used + c
        assert sorted(r["rank"] for r in scoring.fit_budget(df, "rank", "cost", most).collect()) == kept


def test_facts(spark, tmp_path):
    import datetime as dt

    ask = lambda uri, *cols: rows(api.query(spark, uri), *cols)
    at = dt.datetime(2024, 1, 1)
    certs = [("a.example", "CN=a", "CA", ["a.example", "*.a.example"], at, at + dt.timedelta(days=5), at, ["r1", "r2"], False, None, "/c/a.pem"), ("b.example", "CN=b", "b", ["c.example"], at, at + dt.timedelta(days=300), at, [], True, "http://o", "/c/b.pem")]
    df = spark.createDataFrame(certs, facts.CERTIFICATES)
    df.write.parquet(f"{tmp_path}/certificates.parquet")
    c = f"{tmp_path}/certificates.parquet"
    assert ask(f"ssl://{c}#dates", "host", "days_left", "state") == {("a.example", 5, "failure"), ("b.example", 300, "pass")} and ask(f"ssl://{c}#san", "name") == {"a.example", "*.a.example", "c.example"}
    assert ask(f"ssl://{c}?expiring-within=30", "host") == {"a.example"} and ask(f"ssl://{c}?summary", "check", "n_failure") == {("expiry", 1), ("hostname", 1), ("chain", 1)}
    for e in ("subject", "issuer", "chain", "full"):
        assert api.query(spark, f"ssl://{c}#{e}").count() == 2
    spark.createDataFrame([("a.example", "TXT", "a.example", "v=spf1 -all"), ("a.example", "MX", "a.example", "10 m"), ("a.example", "NS", "a.example", "ns1.x."), ("a.example", "NS", "a.example", "NS2.x")], facts.RECORDS).write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([("a.example", "ns1.x", "1.2.3.4"), ("a.example", "ns9.x", "1.2.3.4")], "domain string, server string, value string").write.parquet(f"{tmp_path}/answers.parquet")
    assert ask(f"domain://{tmp_path}#ns-audit", "server", "state") == {("ns1.x", "agrees"), ("ns2.x", "silent"), ("ns9.x", "orphaned")} and ask(f"domain://{tmp_path}#mail", "spf", "dmarc") == {("pass", "warning")}
    assert ask(f"domain://{tmp_path}", "check") == {"spf", "dmarc", "propagation", "expiry", "hostname", "chain"} and "pass" not in ask(f"domain://{tmp_path}?only-failures", "state")
    for e in ("dns", "registrar", "whois", "http", "ssl"):
        api.query(spark, f"domain://{tmp_path}#{e}").collect()
    status = [("s", k, v) for k, v in {"Threads_connected": "90", "Max_connections": "100", "Innodb_buffer_pool_reads": "1", "Innodb_buffer_pool_read_requests": "1000", "Slow_queries": "9", "Questions": "100"}.items()]
    spark.createDataFrame(status, "server string, name string, value string").write.parquet(f"{tmp_path}/status.parquet")
    spark.createDataFrame([("s", "replica", "Yes", "Yes", 400, ""), ("t", "source", None, None, None, None)], "server string, role string, io_running string, sql_running string, seconds_behind bigint, last_error string").write.parquet(f"{tmp_path}/replication.parquet")
    assert ask(f"mysql://{tmp_path}", "check", "state") == {("connections", "warning"), ("buffer_hit", "pass"), ("slow_share", "failure")} and ask(f"mysql://{tmp_path}#replication", "server", "state") == {("s", "failure"), ("t", "pass")}
    for e in ("connections", "innodb", "performance", "variables", "databases", "storage", "tables", "indexes", "slow-queries", "errors"):
        api.query(spark, f"mysql://{tmp_path}#{e}").collect()
    spark.createDataFrame([("u", "a.example", "main_domain", "/a", True), ("u", "z.example", "parked", "/z", False)], "user string, domain string, type string, docroot string, resolves boolean").write.parquet(f"{tmp_path}/domains.parquet")
    assert ask(f"cpanel://{tmp_path}", "user", "domains", "failing") == {("u", 2, 2)} and ask(f"cpanel://{tmp_path}#ssl?dns-verified", "domain") == {"a.example"}
    assert ask(f"cpanel://{tmp_path}#full-audit", "check") == {"ssl", "acl"} and api.query(spark, f"cpanel://{tmp_path}#help/api").count() == 4 and ask(f"cpanel://{tmp_path}#domains?domain_type=parked", "domain") == {"z.example"}
    (tmp_path / "n").mkdir()
    (tmp_path / "n/x.conf").write_text("server {\n  ssl_certificate /c/a.pem;\n}\n")
    assert ask(f"letsencrypt://{c}?check-orphans&nginx={tmp_path}/n", "path") == {"/c/b.pem"} and ask(f"letsencrypt://{c}?check-duplicates", "n") == set()
    log = [("start for user “ann”", 0, "info"), ("x.example: fine", 1, "info"), ("boom", 2, "error"), ("start for user “bob”", 0, "info"), ("bad", 2, "error")]
    (tmp_path / "run.log").write_text("\n".join(json.dumps({"contents": a, "indent": b, "type": k, "timestamp": ""}) for a, b, k in log))
    assert ask(f"runlog://{tmp_path}/run.log?only-failures", "user", "domain", "contents") == {("ann", "x.example", "boom"), ("bob", None, "bad")} and ask(f"autossl://{tmp_path}/run.log?user=bob", "user") == {"bob"}
    assert ask(f"runlog://{tmp_path}/run.log?summary", "users", "errors") == {(1, 1)}


def test_transcript_views(spark, tmp_path):
    ask = lambda tail, *cols: rows(api.query(spark, f"transcripts://{tmp_path}/t.jsonl{tail}"), *cols)
    at = lambda i: f"2024-01-01T00:{i:02}:00Z"
    block = lambda t, **kw: {"type": t, **kw}
    recs = [
        ("user", "m0", {"role": "user", "content": "please look"}), ("assistant", "m1", {"role": "assistant", "stop_reason": "end", "usage": {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 30}, "content": [block("thinking", thinking="hm"), block("tool_use", id="1", name="Bash", input={"command": "ls"})]}),
        ("user", "m2", {"role": "user", "content": [block("tool_result", tool_use_id="1", content="Error: x", is_error=True)]}), ("assistant", "m3", {"role": "assistant", "stop_reason": "end", "usage": {"input_tokens": 7}, "content": [block("text", text="done")]}),
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"type": k, "uuid": u, "sessionId": "s", "timestamp": at(i), "cwd": "/p", "message": m}) for i, (k, u, m) in enumerate(recs)))
    assert ask("#prompts", "text") == {"please look"} and ask("#messages", "text") == {"done"} and ask("#errors", "tool", "input_preview") == {("bash", "ls")}
    assert ask("#tokens", "message_index", "cumulative_input") == {(1, 40), (3, 47)} and ask("#message/-1", "uuid") == {"m3"} and ask("?last", "text") == {"done"}
    assert ask("?errors", "uuid") == {"m2"} and ask("?tools=bash", "uuid") == {"m1"} and ask("?contains=LOOK", "uuid") == {"m0"} and ask("?search=ls&word", "block_type") == {"tool_use"}
    assert ask("?since=2024-01-02", "session_id") == set() and ask("?project=/p&filter=S", "n_messages") == {4} and ask("?range=2-3", "uuid") == {"m1", "m2"} and ask("?role=user", "uuid") == {"m0", "m2"}
    for e in ("digest", "exchanges", "thinking", "tools", "workflow", "timeline", "context", "summary", "files", "agents"):
        api.query(spark, f"transcripts://{tmp_path}/t.jsonl#{e}").collect()


def test_history_views(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x.example", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    for i, text in enumerate(["def f():\n    return 1\n", "def f():\n    return 2\n", "def f():\n    return 2\n\n\ndef g():\n    return f()\n"]):
        (tmp_path / "a.py").write_text(text)
        git("add", "."), git("commit", "-qm", ["start", "reformat all", "add g"][i])
    git("tag", "v1")
    ask = lambda tail, *cols: rows(api.query(spark, f"git://{tmp_path}{tail}"), *cols)
    assert ask("?content~=return 2", "subject") == {"reformat all"} and ask("?message=START", "subject") == {"start"} and ask("?author=ann&no_merges&since=2000-01-01", "subject") == {"start", "reformat all", "add g"}
    assert ask("#a.py?type=blame&detail", "line", "subject") == {(1, "start"), (2, "reformat all"), (3, "add g"), (4, "add g"), (5, "add g"), (6, "add g")}
    assert ask("#a.py?type=blame&element=f", "subject", "lines") == {("start", 1), ("reformat all", 1)}
    assert ask("#a.py?type=diff&old=HEAD~1&context=0", "kind", "text") == {("+", ""), ("+", "def g():"), ("+", "    return f()")}
    assert "return 1" in api.query(spark, f"git://{tmp_path}#a.py?ref=HEAD~2&raw").first().text and ask("#a.py?type=file", "name") == {"f", "g"}
    assert ask("?branches", "name") == {"main"} and ask("?tags", "name") == {"v1"} and ask("?noise", "subject") == {"reformat all"} and ask("#a.py?type=history", "added") == {2, 1, 4}


def test_workbook_parts(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="rId1"/></sheets><definedNames><definedName name="Rate">One!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>2</v></c><c r="B1"><f>A1*2</f><v>4</v></c></row></sheetData></worksheet>')
        z.writestr("xl/connections.xml", f'<connections {ns}><connection name="Q" id="1"><dbPr connection="Provider=x"/></connection></connections>')
    ask = lambda tail, *cols: rows(api.query(spark, f"xlsx://{tmp_path}/b.xlsx{tail}"), *cols)
    assert ask("?formulas", "name", "value") == {("B1", "=A1*2")} and ask("?names", "name", "value") == {("Rate", "One!$A$1")} and ask("?connections", "value") == {"Provider=x"}
    assert ask("?format=csv", "line") == {"2,4"} and ask("?sheet=1", "value") == {"2", "4"} and ask("?powerquery", "name") == ask("?powerpivot", "name") == set()


def test_tree_diff(spark, root, tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app/util.py").write_text(UTIL.replace("def helper(x)", "def helper(x, y)").replace("lonely", "renamed"))
    got = {tuple(r) for r in api.query(spark, f"diff://{root}/app:{tmp_path}/app").where("file = 'util.py'").select("qualified", "change").collect()}
    assert got == {("helper", "modified"), ("lonely", "removed"), ("renamed", "added")}


def test_transcripts(spark, tmp_path):
    lines = [{"type": "assistant", "uuid": "u", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "1", "name": "Read", "input": {"a": 1}}]}}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert rows(api.query(spark, f"sessions://{tmp_path}/t.jsonl"), "path", "block_name", "block_input") == {("0", "Read", '{"a": 1}')}


def test_front_matter_schema(spark, texts):
    from sondage.operators import frontmatter

    s = FM.structure(texts)
    got = rows(frontmatter.check(s, ["title", "status"], {"title": "integer", "tags": "list"}, {"tags": "value=x"}), "path", "rule_code", "field")
    assert got == {("docs/a.md", "F003", "status"), ("docs/a.md", "F004", "title"), ("docs/a.md", "F005", "tags")}
    assert frontmatter.check(s).count() == 0


def test_front_matter_address(spark, root):
    assert rows(api.query(spark, f"frontmatter://{root}?required=status&types=title:integer"), "rule_code") == {"F003", "F004"}


def test_similar_functions():
    body = "".join(f"    x{i} = f(a, b)\n" for i in range(8))
    text = f"def one(a, b):\n{body}\n\ndef two(a, b):\n{body}\n\ndef three():\n" + "".join(f"    print('{i}')\n" for i in range(9))
    got = P.similar_functions("f", text)
    assert [(g[1], g[3]) for g in got] == [("one", "two")] and got[0][5] > 0.99
    assert P.similar_functions("f", "def (") == P.similar_functions("f", None) == []
