"""Extraction, analysers and import resolution on snippets."""

import pytest

from codeatlas.operators import analyse as N, extract_lines as E, extract_trace as X, resolve as P
from tests.conftest import rows


def told(df, kind, *cols):
    return rows(df.filter(f"record_type = '{kind}'"), *cols)


TS = """import { processData, type Result as R } from './processor.js';
import chalk, { a as b } from 'chalk';
import * as ns from "n";
import {
  multi,
} from './multi';
export async function main(input: string): Promise<Result> {
  const x = processData("hello (world)");
  console.log(x);
  return db.users.find(x).map(toRow);
}
export const handler = (req: Request) => { fetch(url); other(req); };
export class UserService {
  private async getUser(id: number): User { return db.query(id); }
  other() {
    const z = new Thing(bar());
    // commented(1)
    setTimeout(go, 1);
  }
}
top(1);
"""


def test_trace_ts(files):
    got = X.extract_trace_ts(files({"a.ts": TS}))
    assert told(got, "symbol", "name", "kind", "line", "signature", "return_type") == [
        ("UserService", "class", 13, None, None), ("getUser", "method", 14, "(id: number)", "User"),
        ("handler", "function", 12, "(req: Request)", None), ("main", "function", 7, "(input: string)", "Promise<Result>"),
        ("other", "method", 15, "()", None)]
    assert told(got, "call", "caller", "name", "line") == [
        ("<module>", "top", 21), ("getUser", "query", 14), ("handler", "other", 12), ("main", "find", 10), ("main", "map", 10),
        ("main", "processData", 8), ("other", "bar", 16)]
    assert told(got, "import", "name", "source_module", "alias") == [
        ("*", "n", "ns"), ("a", "chalk", "b"), ("chalk", "chalk", None), ("multi", "./multi", None), ("processData", "./processor.js", None)]


def test_trace_py(files):
    text = """from .foo import a as b, c
import os.path as p, sys
from x import *
from y import (q,
   r)
@app.route("/x")
@dec
def handler(a, b=f(1)):
    return helper(a).save(b)

class Foo(Base):
    def m(self):
        self.go(1)  # call(2)
x = main()
"""
    got = X.extract_trace_py(files({"a.py": text}))
    assert told(got, "symbol", "name", "kind", "line") == [("Foo", "class", 11), ("handler", "function", 6), ("m", "function", 12)]
    assert told(got, "call", "caller", "name", "line") == [
        ("<module>", "main", 14), ("handler", "helper", 9), ("handler", "route", 6), ("handler", "save", 9), ("m", "go", 13)]
    assert told(got, "import", "name", "source_module", "alias") == [
        ("*", "x", None), ("a", ".foo", "b"), ("c", ".foo", None), ("os.path", "os.path", "p"), ("q", "y", None), ("r", "y", None), ("sys", "sys", None)]


def test_trace_java_and_sql_bind_across_languages(files):
    java = """package a.b;
import com.example.Foo;
public class Pay extends Base {
  public Pay(int x) { this.init(x); }
  @Procedure("MY_PROC")
  public List<String> run(int a, String b) throws IOException {
    Math.abs(a);
    jdbcTemplate.execute("CALL update_balance(?)");
    return foo.bar(a).baz();
  }
}
interface I { }
"""
    sql = """
CREATE OR REPLACE PROCEDURE update_balance(p int) AS
BEGIN
  UPDATE customer SET balance = balance - 1, `x` = 2 WHERE id = p;
END;
CREATE VIEW v AS
SELECT c.balance AS b,
  name
FROM customer;
SELECT * FROM u;
INSERT INTO t (a, "b") VALUES (1, 2);
DELETE FROM t;
"""
    got = X.extract_trace(files({"Pay.java": java, "p.sql": sql}))
    assert told(got.filter("language = 'java'"), "symbol", "name", "kind", "line") == [("I", "interface", 12), ("Pay", "class", 3), ("Pay", "method", 4), ("run", "method", 5)]
    assert told(got, "call", "caller", "name", "kind") == [
        ("Pay", "init", "direct"), ("run", "MY_PROC", "cross-language"), ("run", "bar", "direct"), ("run", "baz", "direct"),
        ("run", "execute", "direct"), ("run", "update_balance", "cross-language")]
    assert told(got, "column", "caller", "table_name", "column_name", "operation") == [
        ("update_balance", "customer", "balance", "UPDATE"), ("update_balance", "customer", "x", "UPDATE"), ("v", "customer", "balance", "SELECT"),
        ("v", "customer", "name", "SELECT"), ("v", "t", "*", "DELETE"), ("v", "t", "a", "INSERT"), ("v", "t", "b", "INSERT"), ("v", "u", "*", "SELECT")]
    tables = X.split_records(got)
    assert tables["calls"].filter("callee_name = 'update_balance'").count() == 1 and tables["columns"].count() == 8
    assert tables["symbols"].select("id").distinct().count() == tables["symbols"].count()


def test_line_symbols(files):
    text = "export async function a() {}\nexport abstract class B {}\nexport interface C {}\nexport type D = 1\nexport enum E {}\nexport const f = 1\nclass G {}\n  class H {}"
    assert rows(E.extract_symbols_ts(files({"a.ts": text})), "name", "kind", "line") == [
        ("B", "class", 2), ("C", "interface", 3), ("D", "type", 4), ("E", "enum", 5), ("G", "class", 7), ("a", "function", 1), ("f", "const", 6)]
    assert rows(E.extract_symbols_py(files({"a.py": "async def a():\n    def b():\nclass C:"})), "name") == [("C",), ("a",)]


def test_definition_priorities(spark, files):
    f = files({"a.ts": "const x = 1\nfunction x() {}\n", "b.ts": "export function x(a) {}", "c.ts": "export class x {}", "d.ts": "  y(a) {\n  y(b);"})
    names = spark.createDataFrame([("r", "x"), ("r", "y")], "repo string, name string")
    assert rows(E.find_definitions(f, names), "name", "kind", "file", "line", "priority") == [("x", "function", "b.ts", 1, 10), ("y", "method", "d.ts", 1, 6)]


def test_references_skip_comments_and_the_definition(spark, files):
    f = files({"d.ts": "export function go(a) {\n  go(1)\n}", "u.ts": "import { go } from './d'\n// go(9)\nconst x = go(a, b) + new go( c )\ngoing(1)"})
    names = spark.createDataFrame([("r", "go", "d.ts")], "repo string, name string, def_file string")
    assert rows(E.find_references(f, names), "file", "line", "kind", "args") == [("d.ts", 2, "call", "1"), ("u.ts", 1, "import", None), ("u.ts", 3, "call", "a, b")]


def test_enclosing_and_outgoing(spark, files):
    text = "top()\nexport async function a() {\n  x()\n}\nconst b = async (q) => {\n  y()\n}\nclass C {\n  m(z) {\n    w()\n  }\n}"
    got = {r["line"]: r["enclosing"] for r in E.enclosing_function(files({"a.ts": text})).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 6, 9, 10)] == [None, "a", "a", "b", "b", "m", "m"]
    bodies = spark.createDataFrame([("r", "me", "me(1)\n// no()\nif (ok(1)) foo(bar(2))\nfoo(3)\nawait a.b.last(4)")], "repo string, caller string, body string")
    known = spark.createDataFrame([("r", "foo")], "repo string, name string")
    assert rows(E.outgoing_calls(bodies, known), "name", "line", "args", "known") == [
        ("bar", 3, "2", False), ("foo", 3, "bar(2", True), ("last", 5, "4", False), ("ok", 3, "1", False)]


def test_resolution_order(files):
    f = files({p: "" for p in ["src/a.ts", "src/lib/b.ts", "src/c/index.tsx", "src/d.js", "src/d.ts", "e.mjs"]})
    imports = f.sparkSession.createDataFrame(
        [("r", "src/a.ts", raw) for raw in ["./lib/b", "./lib/b.js", "./c", "./d.js", "./d", "../e", "./nope", "././lib/../lib/b"]],
        "repo string, file string, raw string")
    assert rows(P.resolve_imports(imports, f), "raw", "resolved") == [
        ("../e", "e.mjs"), ("././lib/../lib/b", "src/lib/b.ts"), ("./c", "src/c/index.tsx"), ("./d", "src/d.ts"), ("./d.js", "src/d.js"),
        ("./lib/b", "src/lib/b.ts"), ("./lib/b.js", "src/lib/b.ts")]


def test_import_lines(files):
    text = "import a from './a'\nexport { b } from \"../b\"\nconst c = require('./c')\nconst d = await import('./d')\nimport e from 'pkg'\nimport {\n f\n} from './f'"
    f = files({"x.ts": text})
    assert [r["raw"] for r in P.extract_imports(f).collect()] == ["./a", "../b", "./d", "./c"]
    assert "./f" in {r["raw"] for r in P.extract_imports(f, multiline=True).collect()}


def test_package_usage(files):
    f = files({"x.ts": "import a from '@s/p/deep'\nimport b from 'lib/x'\nconst c = require('./c'); require('d')"})
    assert rows(P.package_usage(f), "name") == [("@s/p",), ("d",), ("lib",), ("typescript",)]


@pytest.fixture
def graph(files):
    def make(fn, path, text, **kw):
        nodes, edges = N.split_graph(fn(files({path: text}).select("repo", "path", "content"), **kw))
        return {r["id"]: r for r in nodes.collect()}, {(r["src"], r["type"], r["dst"]) for r in edges.collect()}

    return make


def test_analyze_ts(graph):
    nodes, edges = graph(N.analyze_ts, "src/a/b.tsx", "import x from './foo.js';\nimport e from 'express';\nexport class A {}\nexport async function go() {}\n"
                         "app.get('/users', h); router.post(\"/x\", h)\nprocess.env.DB_URL; process.env.DB_URL", merged=True)
    assert set(nodes) == {"file:src/a/b.tsx", "class:A", "function:go", "endpoint:GET /users", "endpoint:POST /x", "config:DB_URL"}
    assert nodes["function:go"]["framework"] == "react" and nodes["class:A"]["framework"] is None
    assert edges == {("file:src/a/b.tsx", "contains", "class:A"), ("file:src/a/b.tsx", "contains", "function:go"), ("file:src/a/b.tsx", "imports", "file:src/a/foo.ts")}


def test_analyze_py(graph):
    text = ("from .foo import bar\nclass User(db.Model):\n    id = db.Column(Integer)\n    name = Column(String)\nclass _P: pass\nclass Pub(X):\n"
            "    def meth(self): pass\ndef _x(): pass\ndef top(a): pass\n@app.route('/a', methods=['GET', \"post\"])\n@app.route('/b')\n"
            "os.environ['K1']; os.getenv(\"K2\")\npath('users/', v)\nDAG (")
    nodes, edges = graph(N.analyze_py, "app/urls.py", text, merged=True)
    assert set(nodes) == {"file:app/urls.py", "table:User", "class:Pub", "function:meth", "function:top", "endpoint:GET /a", "endpoint:POST /a",
                          "endpoint:GET /b", "endpoint:GET users/", "config:K1", "config:K2"}
    assert nodes["table:User"]["metadata"] == {"columns": '["id","name"]'} and nodes["file:app/urls.py"]["framework"] == "airflow"
    assert ("file:app/urls.py", "imports", "file:.foo") in edges


def test_analyze_sql(graph):
    text = ("CREATE TABLE IF NOT EXISTS users (\n  id INT PRIMARY KEY,\n  `org_id` INT REFERENCES orgs(id),\n  PRIMARY KEY (id)\n);\nALTER TABLE users ADD x int;\n"
            "INSERT INTO audit (a) SELECT * FROM Users;\nselect * from audit; select * from logs\n{{ ref('m1') }} {{ source('raw', 't1') }}")
    nodes, edges = graph(N.analyze_sql, "models/marts/a.sql", text)
    assert {i: n["metadata"] for i, n in nodes.items()} == {
        "file:models/marts/a.sql": {"dbtLayer": "mart"}, "table:users": {"columns": '["id","org_id"]'}, "table:audit": {}, "table:logs": {}}
    f = "file:models/marts/a.sql"
    assert edges == {(f, "contains", "table:users"), (f, "depends-on", "table:users"), ("table:users", "depends-on", "table:orgs"), (f, "writes", "table:audit"),
                     (f, "reads", "table:Users"), (f, "reads", "table:audit"), (f, "reads", "table:logs"), (f, "depends-on", "file:m1.sql"), (f, "reads", "table:raw.t1")}


def test_analyze_cobol(graph):
    text = ("       PROGRAM-ID. PAYROLL.\n       FD  EMP-FILE.\n       COPY CUSTREC.\n       MAIN-PROC SECTION.\n           CALL 'SUB1'\n"
            "           EXEC SQL SELECT a FROM emp JOIN dept ON x END-EXEC\n           EXEC SQL\n             UPDATE emp SET a=1\n           END-EXEC\n"
            "           EXEC CICS RETURN END-EXEC\n       WORKING-STORAGE SECTION.")
    nodes, edges = graph(N.analyze_cobol, "p.cbl", text, merged=True)
    assert set(nodes) == {"file:p.cbl", "table:EMP", "table:DEPT", "function:MAIN-PROC", "external:EMP-FILE"}
    assert nodes["file:p.cbl"]["name"] == "PAYROLL" and nodes["file:p.cbl"]["framework"] == "cics"
    assert {("file:p.cbl", "imports", "file:CUSTREC."), ("file:p.cbl", "calls", "file:SUB1"), ("file:p.cbl", "reads", "table:DEPT"), ("file:p.cbl", "writes", "table:EMP")} <= edges


def test_analyze_docker(graph):
    nodes, edges = graph(N.analyze_docker, "x/Dockerfile", "FROM node:20 AS build\nFROM scratch\nfrom node:20\nEXPOSE 80 443")
    assert set(nodes) == {"file:x/Dockerfile", "external:node:20"} and nodes["file:x/Dockerfile"]["metadata"] == {"exposedPorts": '["80","443"]'}
    text = ('version: "3"\nservices:\n  web:\n    image: nginx:1\n    ports:\n      - "80:80"\n    depends_on: [db, cache]\n  db:\n    volumes:\n      - data:/x\n'
            "    depends_on:\n      - 'cache'\nvolumes:\n  data:\n")
    nodes, edges = graph(N.analyze_docker, "docker-compose.yml", text)
    assert nodes["service:web"]["metadata"] == {"image": "nginx:1", "ports": '["80:80"]', "volumes": "[]"}
    assert {e for e in edges if e[1] == "deploys-with"} == {
        ("service:web", "deploys-with", "service:db"), ("service:web", "deploys-with", "service:cache"), ("service:db", "deploys-with", "service:cache")}


def test_analyze_openapi(graph):
    text = ("openapi: 3.0.0\npaths:\n  /users:\n    get:\n      x: y\n  /z/{id}:\n    delete:\n      a: b\ncomponents:\n  schemas:\n    User:\n      p:\n"
            "        $ref: '#/components/schemas/Addr'\n        $ref: '#/components/schemas/User'\n    Addr:\n      type: object\n  securitySchemes:\n    k:\n      t: 1")
    nodes, edges = graph(N.analyze_openapi, "api.yaml", text)
    assert set(nodes) == {"file:api.yaml", "endpoint:GET /users", "endpoint:DELETE /z/{id}", "schema:User", "schema:Addr"}
    assert {e for e in edges if e[1] == "depends-on"} == {("schema:User", "depends-on", "schema:Addr")}
    assert graph(N.analyze_openapi, "x.yaml", "kind: other\npaths:\n  /a:\n    get:")[0] == {}


def test_calls_belong_to_the_function_that_holds_them(files):
    ts = """function outer() {
  const inner = (a) => {
    first();
  };
  /* dead(1); {
  dead(2) */ second("} lost(1)");
  const t = `x ghost(1) {
    ghost(2)`;
  class K {
    run() { third(); }
    field = fourth();
  }
  const one = (x) => fifth(x);
  sixth();
}
// function gone() {
top();
"""
    got = X.extract_trace(files({"a.ts": ts, "b.js": ts.replace("outer", "outer2")}))
    assert told(got.filter("language = 'typescript'"), "call", "caller", "name", "line") == [
        ("<module>", "top", 17), ("inner", "first", 3), ("one", "fifth", 13), ("outer", "fourth", 11), ("outer", "second", 6), ("outer", "sixth", 14), ("run", "third", 10)]
    assert told(got.filter("language = 'javascript'"), "symbol", "name", "line", "end_line") == [
        ("K", 9, 12), ("inner", 2, 4), ("one", 13, 13), ("outer2", 1, 15), ("run", 10, 10)]


def test_python_scopes_close_by_indentation(files):
    py = '''def outer(a):
    """Doc dead(1)
dead(2) """
    def inner():
        return first(
  a)
    # dead(3)

    class C:
        x = second()
    return third()
fourth()
'''
    got = X.extract_trace_py(files({"a.py": py}))
    assert told(got, "call", "caller", "name", "line") == [("<module>", "fourth", 12), ("inner", "first", 5), ("outer", "second", 10), ("outer", "third", 11)]
    assert told(got, "symbol", "name", "line", "end_line") == [("C", 9, 10), ("inner", 4, 6), ("outer", 1, 11)]


def test_java_scopes_and_abstract_methods(files):
    java = """interface I {
  void plain();
  int other(int a);
}
class A {
  int run() {
    list.each(new F() {
      void go() { first(); }
    });
    String s = \"\"\"
      ghost(1); {
      \"\"\";
    return second();
  }
  int field = third();
}
"""
    got = X.extract_trace_java(files({"A.java": java}))
    assert told(got, "call", "caller", "name", "line") == [("<module>", "third", 15), ("go", "first", 8), ("run", "each", 7), ("run", "second", 13)]
    assert told(got, "symbol", "name", "line", "end_line") == [("A", 5, 16), ("I", 1, 4), ("go", 8, 8), ("other", 3, 3), ("plain", 2, 2), ("run", 6, 14)]


def test_openapi_key_may_stand_anywhere(files):
    text = "".join(f"# line {i}\n" for i in range(30)) + "openapi: 3.0.0\npaths:\n  /a:\n    get:\n      x: 1\n"
    assert N.analyze_openapi(files({"a.yaml": text})).count() > 0


def test_a_line_is_read_once(spark):
    """In lambdas each mention of a column is computed again: what is made from a line's text is bound to a name first."""
    a, b = X.F.col("a"), X.F.col("b")
    for dialect in (X.TYPESCRIPT, X.PYTHON, X.JAVA):
        assert str(X._line(dialect, a, b)).count("d+:'") == 2
    text = "".join(f"class A{i} {{\n  void run{i}(int a) {{ go{i}(a); }}\n}}\n" for i in range(3))
    files = spark.createDataFrame([("r", "A.java", "java", text)], "repo string, path string, language string, content string")
    assert told(X.extract_trace_java(files), "call", "name", "caller", "line") == [(f"go{i}", f"run{i}", 3 * i + 2) for i in range(3)]
