"""Declarations with their owners in several languages, and tokens against a plain scanner."""

import re

import pytest

from lexigraph.operators import code, scopes

GO = """package p
// func Hidden() {
type Crane struct {
	arm string
}

func (c *Crane) Lift(
	n int,
) error {
	s := "func Fake() {"
	go func() { if true { run() } }()
	return nil
}
func Lower() {}
"""
JAVA = """class Dock {
  /* class Not { */
  int depth = 3; static { init(); }
  public void moor(Ship s) { if (s.big()) { tow(s); } }
  class Bollard {
    void tie(Rope r) { char c = '{'; }
    enum Knot { A, B }
  }
  void leave() { while (true) { } }
}
class Quay { void moor(Ship s) { } }
"""
PY = '''
class Tide:
    """def not_this():"""
    x = [
  1,
    ]
    def rise(self):
        if True:
            def inner():
                pass
        async def later(): pass

    def fall(self): # def neither
        s = 'class Nope:'

def rise():
    pass
'''
RUBY = "module Port\n  class Gate\n    def open\n      1\n    end\n  end\n  def self.close\n  end\nend\ndef lone\nend\n"
RUST = "struct Buoy<'a> { n: &'a str }\nimpl<'a> Buoy<'a> {\n  fn ring(&self) { let c = '{'; }\n}\nfn main() { fn helper() {} }\n"
TS = "export class Hull {\n  fill() { const pump = (a) => { a }; }\n}\nfunction sink() { let deep = function () { function deeper() {} } }\n"
LUA = "function outer()\n  -- function no()\n  local function inner()\n  end\nend\n"
WANT = {
    "a.go": {("Crane", 3, None), ("Lift", 7, None), ("Lower", 14, None)},
    "A.java": {("Dock", 1, None), ("moor", 4, "Dock"), ("Bollard", 5, "Dock"), ("tie", 6, "Bollard"), ("Knot", 7, "Bollard"), ("leave", 9, "Dock"), ("Quay", 11, None), ("moor", 11, "Quay")},
    "t.py": {("Tide", 2, None), ("rise", 7, "Tide"), ("inner", 9, "rise"), ("later", 11, "rise"), ("fall", 13, "Tide"), ("rise", 16, None)},
    "p.rb": {("Port", 1, None), ("Gate", 2, "Port"), ("open", 3, "Gate"), ("close", 7, "Port"), ("lone", 10, None)},
    "b.rs": {("Buoy", 1, None), ("ring", 3, None), ("main", 5, None), ("helper", 5, "main")},
    "h.ts": {("Hull", 1, None), ("pump", 2, "Hull"), ("sink", 4, None), ("deep", 4, "sink"), ("deeper", 4, "deep")},
    "o.lua": {("outer", 1, None), ("inner", 3, "outer")},
}
TEXTS = {"a.go": GO, "A.java": JAVA, "t.py": PY, "p.rb": RUBY, "b.rs": RUST, "h.ts": TS, "o.lua": LUA}


@pytest.fixture(scope="module")
def files(spark):
    more = [("empty.go", ""), ("none.py", None), ("blank.java", " \n;;}}{{ \n"), ("x.tsx", "class No {}"), ("y.unknown", "class No {}")]
    return code.with_language(spark.createDataFrame([*TEXTS.items(), *more], "path string, content string"))


def test_members_are_named_by_their_owner(files):
    got = {}
    found = code.find_symbols(files)
    for r in found.collect():
        got.setdefault(r["path"], set()).add((r["name"], r["line"], r["owner"]))
    assert got == WANT
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_blanking_keeps_places(files):
    for r in files.where("lang is not null and content is not null").select("path", "content", scopes.blanked().alias("t")).collect():
        assert len(r["t"]) == len(r["content"]) and [m.start() for m in re.finditer("\n", r["t"])] == [m.start() for m in re.finditer("\n", r["content"])]
        assert "Hidden" not in r["t"] and "Fake" not in r["t"] and "neither" not in r["t"]


def test_tokens_equal_a_plain_scanner(spark, files):
    token = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/|\#[^\n]*|--[^\n]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<identifier>[A-Za-z_$][\w$]*)""", re.S)
    want = {(p, m.lastgroup, m[0], t.count("\n", 0, m.start()) + 1) for p, t in TEXTS.items() for m in token.finditer(t)}
    found = scopes.tokens(files.where("lang is not null and path <> 'x.tsx'"))
    assert {(r["path"], r["node"], r["term"], r["span"]) for r in found.collect()} == want
    assert "Python" not in code.find_mentions(files)._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_one_pass(spark):
    """A file near the size limit: long strings and comments, many declarations, deep nesting."""
    text = "/*" + "x" * 200_000 + "*/\nvar s = \"" + "y\\\"" * 60_000 + "\";\n" + "".join(f"func F{i}() {{ a(); }}\n" for i in range(5000)) + "func Deep() " + "{" * 3000 + "}" * 3000 + "\nfunc Last() {}\n"
    df = code.with_language(spark.createDataFrame([("big.go", text)], "path string, content string"))
    got = code.find_symbols(df)
    assert got.count() == 5002 and got.where("owner is not null").isEmpty() and got.where("name = 'Last'").first()["line"] == 5004
    assert code.find_mentions(df).where("normalized = 'deep'").count() == 1
