"""A second code base made from the driver's suppliers: every rule of debug output, annotations and handlers, complexity and duplicates of all languages, circles, entry points, and orders.

Supplier k has the folder q{k}. As in codebase, what must be found is written down by file and line, read off the texts by hand. Where a result is an order, place is the row's number in
the detector's own sorted result, and the SQL orders by the rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrain.functions.tables import written
from lodegrain.operators import blocks, findings, imports, symbols
from lodegrain.plans import reports
from lodegrain.plans.codebase import rows_sql, suppliers
from lodegrain.sources.files import as_files

#: Debug output by file: (line, kind), kind None where nothing is found.
OUTPUT = {
    "out.js": [("console.log(1);", "log"), ("console.warn(1);", "warn"), ("console.debug(1);", "debug"), ("console.info(1);", "info"), ("console.error (1);", "error"), ("console.trace();", "trace"), ("console.dir(x);", "dir"), ("// console.log(2);", None), ("  * console.log(3);", None), ("console.table(x);", None)],
    "out.tsx": [("f(() => console.log(1));", "log"), ("/* console.log(2); */", None)],
    "out.py": [("print(1)", "print"), ("x = print(1)", None), ("pprint(x)", "debug"), ("from pprint import pprint", None), ("logging.debug(1)", "debug"), ("logging.info(1)", "info"), ("logging.warning(1)", "warn"), ("logging.error(1)", "error"), ("logging.critical(1)", "log"), ("# print(1)", None)],
    "out.go": [("fmt.Print(1)", "print"), ("fmt.Println(1)", "print"), ("fmt.Printf(1)", "print"), ("fmt.Fprintf(w)", "print"), ("x := fmt.Sprintf(s)", "print"), ("log.Print(1)", "log"), ("log.Printf(1)", "log"), ("log.Println(1)", "log"), ("log.Fatal(1)", "log"), ("log.Fatalf(1)", "log"), ("log.Fatalln(1)", "log"), ("log.Panic(1)", "log"), ("xlog.Print(1)", None)],
    "out.java": [("System.out.print(1);", "print"), ("System.out.println(1);", "print"), ("System.out.printf(s);", "print"), ("System.err.println(1);", "error"), ("e.printStackTrace();", "error"), ("System.in.read();", None)],
    "out.rb": [("p x", "debug"), ("  puts x", "print"), ("pp x", "debug"), ("$stderr.puts x", "error"), ("y = p x", None)],
    "out.rs": [('println!("x");', "print"), ('print!("x");', "print"), ('eprintln!("x");', "error"), ("dbg!(x);", "debug")],
    "out.php": [("var_dump($x);", "debug"), ("print_r($x);", "debug"), ("echo $x;", "print"), ("var_export($x);", "debug")],
    "out.cs": [("Console.Write(1);", "print"), ("Console.Error.WriteLine(1);", "print"), ("Debug.WriteLine(1);", "debug"), ("Trace.Write(1);", "trace")],
    "out.test.js": [("console.log(1);", None)],
    "tests/out.py": [("print(1)", None)],
    "__mocks__/out.js": [("console.log(1);", None)],
}
#: Annotations: line, kind, text, issue and severity, or None.
NOTES = [
    ("# TODO: a #12", ("TODO", "a #12", "#12", 1)), ("// FIXME b", ("FIXME", "b", None, 3)), ("-- HACK: c ABC-9 and #3", ("HACK", "c ABC-9 and #3", "ABC-9", 2)), ("/* XXX d */", ("XXX", "d", None, 1)), ("# bug lower e", ("BUG", "lower e", None, 4)),
    ("# TEMP", ("TEMP", "", None, 1)), ("# DEPRECATED: f # TODO g", ("DEPRECATED", "f # TODO g", None, 5)), ("x = 'TODO: none'", None), ("# TODOS many", None),
]
#: Handlers by file: (line, kind, severity), kind None where nothing is found; lines of a body are their own entries.
HANDLERS = {
    "h.java": [("try {", None, None), ("} catch (IOException e) {", "empty", "error"), ("  log(e);", None, None), ("}", None, None), ("catch (RuntimeException x) {", None, None), ("  log(x);", None, None), ("}", None, None)],
    "h.cs": [("try { Go(); }", None, None), ("catch (Exception) {", "broad", "info"), ("  Log();", None, None), ("}", None, None), ("catch (Exception)", "broad", "info"), ("{", None, None), ("}", None, None)],
    "h.php": [("try { f(); }", None, None), ("catch (Wrong $e) {}", "empty", "error")],
    "h.mjs": [("try { f(); }", None, None), ("catch (err: any) {", "broad", "info"), ("  g();", None, None), ("}", None, None), ("try { f(); } catch (e) { log(e); }", "empty", "error"), ("p.catch(done => {", None, None), ("});", None, None)],
    "h.py": [
        ("try:", None, None), ("    f()", None, None), ("except BaseException as e:", "broad", "info"), ("    raise", None, None), ("except ValueError:", "empty", "error"), ("    pass", None, None), ("except:", "empty", "error"), ("", None, None), ("    pass # why", None, None), ("except KeyError:", None, None), ("    g()", None, None),
    ],
    "h.rb": [("begin", None, None), ("rescue => e", "empty", "error"), ("  nil", None, None), ("rescue A", "empty", "error"), ("  # skip", None, None), ("rescue B", None, None), ("  retry", None, None), ("end", None, None)],
    "h.go": [("_, _ = f()", "swallowed", "warning"), ("x, _ = f()", "swallowed", "warning"), ("_ = f() // why", None, None), ("_, row := f()", None, None), ("if err != nil {", None, None), ("\treturn err", None, None), ("}", None, None)],
    "h.rs": [("x.unwrap(); // y.unwrap()", None, None), ("x.unwrap_or(1);", None, None), ("x.unwrap ();", "panic", "info"), ('x.expect("y").unwrap();', "panic", "warning")],
    "tests/h.rs": [("x.unwrap();", None, None)],
}
#: Other files; {k} is the supplier's key.
FILES = {
    "cx.js": "export async function load_{k}(a, b) {\n  if (a && b) { return 1; }\n  for (const x of a) {\n    while (x) { x--; }\n    switch (x) {\n      case 1: break;\n    }\n  }\n  try { a(); } catch (e) { }\n  return a?b:c||d&&e;\n}\nclass Work_{k} {\n  static async run_{k}(x) {\n    if (x) {\n    } else if (x > 1) {\n    }\n    do { x--; } while (x)\n    if (x) { }\n    if (x) { }\n  }\n}\nconst outer_{k} = (p) => {\n  const inner_{k} = (q) => {\n    if (q) { } if (q) { } if (q) { } if (q) { } if (q) { }\n    return q;\n  };\n  const second_{k} = (r) => {\n    return r?1:0;\n  };\n  return inner_{k};\n};",
    "cx.go": "package m\nfunc (s *Srv_{k}) Serve_{k}(ch chan int) {\n\tfor i := range ch {\n\t\tif i>0&&i<9||i==3 {\n\t\t}\n\t\tselect {\n\t\tcase <-ch:\n\t\t}\n\t}\n}",
    "cx.rs": "pub async fn scan_{k}<T>(v: T) {\n    loop {\n        match v {\n            A => if x { },\n            _ => while y { },\n        }\n        for z in v { }\n        if a {\n        } else if b {\n        }\n    }\n}",
    "cx.rb": "def work_{k}(a)\n  if a and b\n    x = 1\n  elsif c or d\n    y = 2 unless z\n  end\n  while q\n    r\n  end\nend",
    "cx2.rb": "class Box_{k}\n  def tiny_{k}; 1; end\n  def big_{k}(a)\n    case a\n    when 1 then b||c\n    when 2 then d&&e\n    end\n    begin\n      f\n    rescue\n      g\n    end\n  end\nend",
    "d1.js": "class A_{k} {\n  async load(x) {\n    const total = {k};\n    let other = x + 3;\n    for (const row of rows) { other = other + total * 3; }\n    return this.save(other, total, \"first\");\n  }\n}",
    "d2.js": "// another one\nclass B_{k} {\n  async load(x) {\n    const sum = 99;\n    let other = x + 7;\n    for (const line of rows) { other = other + total * 9; }\n    return this.save(other, total, \"second\"); // done\n  }\n}",
    "e1.java": "class E_{k} {\n  public int sum(int[] rows) {\n    int total = {k};\n    for (int row : rows) {\n      total = total + row * 3 + rows.length;\n    }\n    return total;\n  }\n}",
    "e2.java": "class F_{k} {\n  private int x;\n  public int sum(int[] rows) {\n    int total = 5;\n    for (int row : rows) {\n      total = total + row * 8 + rows.length;\n    }\n    return total;\n  }\n}",
    "g1.go": "package g\nfunc Sum_{k}(rows []int) int {\n\ttotal := {k}\n\tfor _, row := range rows {\n\t\ttotal = total + row*3 + len(rows)\n\t}\n\treturn total\n}",
    "g2.go": "package g\nfunc All_{k}(rows []int) int {\n\ttotal := 8\n\tfor _, row := range rows {\n\t\ttotal = total + row*4 + len(rows)\n\t}\n\treturn total\n}",
    "r1.rs": "pub fn sum_{k}(rows: &[u8]) -> u8 {\n    let mut total = {k};\n    for row in rows {\n        total = total + row * 3 + rows.len();\n    }\n    // all\n    let more = total + rows.len() + 1;\n    return more;\n}",
    "r2.rs": "pub(crate) async fn other() {}\n\npub fn all_{k}(rows: &[u8]) -> u8 {\n    let mut total = 9;\n    for row in rows {\n        total = total + row * 7 + rows.len();\n    }\n    /* all */\n    let most = total + rows.len() + 2;\n    return more;\n}",
    "s1.rb": "def sum_{k}(rows)\n  total = {k}\n  rows.each do |row|\n    total = total + row * 3 + rows.size\n  end\n  total = total + rows.first.to_i + rows.last.to_i\n  total = total * 2\n  keep(total)\n  return total\nend",
    "s2.rb": "def all_{k}(rows)\n  total = 4\n  rows.each do |row|\n    total = total + row * 5 + rows.size\n  end\n  total = total + rows.first.to_i + rows.last.to_i\n  total = total * 7\n  keep(total)\n  return total\nend",
    "pk/__init__.py": "from .one import y", "pk/one.py": "from .two import x\ny = 1", "pk/two.py": "from . import three\nx = 1", "pk/solo.py": "import q{k}.pk.one",
    "loops/a.ts": "import { b_{k} } from './b';\nexport const a_{k} = b_{k};", "loops/b.ts": "import { a_{k} } from './a';\nexport const b_{k} = a_{k};",
    "in/index.ts": "export const entry_{k} = 1;\nconst own_{k} = 2;", "in/main.ts": "export function start_{k}() {}", "in/plain.ts": "export const plain_{k} = 1;\nexport const runSpec = 1;\nexport const _kept_{k} = 1;\nexport function test_{k}() {}",
}
#: (file, name, line, end line, complexity, risk)
SCORES = [
    ("cx.js", "load_{k}", 1, 11, 10, "medium"), ("cx.js", "run_{k}", 13, 20, 7, "medium"), ("cx.js", "outer_{k}", 22, 31, 7, "medium"), ("cx.go", "Serve_{k}", 2, 10, 7, "medium"), ("cx.rs", "scan_{k}", 1, 12, 8, "medium"),
    ("cx.rb", "work_{k}", 1, 10, 7, "medium"), ("cx2.rb", "tiny_{k}", 2, 14, 6, "medium"), ("cx2.rb", "big_{k}", 3, 13, 6, "medium"),
]
#: Files with duplicate blocks; other files of all suppliers are alike too.
BLOCKS = r"/[a-z]\d\.\w+\z"
#: (file, line, end line, name, lines of the group's blocks)
DOUBLES = [
    ("d1.js", 2, 7, "load", 6), ("d2.js", 3, 8, "load", 6), ("e1.java", 2, 8, "sum", 7), ("e2.java", 3, 9, "sum", 7), ("g1.go", 2, 8, "Sum_{k}", 7), ("g2.go", 2, 8, "All_{k}", 7),
    ("r1.rs", 1, 9, "sum_{k}", 9), ("r2.rs", 3, 11, "all_{k}", 9), ("s1.rb", 1, 9, "sum_{k}", 9), ("s2.rb", 1, 9, "all_{k}", 9),
]
CIRCLES = [("pk/__init__.py", "pk/__init__.py", 3), ("pk/__init__.py", "pk/one.py", 3), ("pk/__init__.py", "pk/two.py", 3), ("loops/a.ts", "loops/a.ts", 2), ("loops/a.ts", "loops/b.ts", 2)]
#: Dead symbols of the folder in: entry points keep what they export, some names are passed over.
DEAD = [("in/index.ts", 2, "own_{k}"), ("in/plain.ts", 1, "plain_{k}")]
#: Files that nothing imports, also in a folder of tests, which exempts none; without {k}, as sizes would depend on it.
LONELY = ("out.js", "out.tsx", "h.mjs", "tests/out.py", "tests/h.rs")
TEXTS = {
    **{p: "\n".join(x[0] for x in lines) for p, lines in {**OUTPUT, **HANDLERS}.items()}, "notes.py": "\n".join(x[0] for x in NOTES), **FILES,
}


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second code base of a corpus folder's suppliers."""
    listed = F.array(*(F.struct(F.lit("q{k}/" + p).alias("p"), F.lit(t).alias("c")) for p, t in TEXTS.items()))
    own = suppliers(spark, sf_dir).select("k", F.explode(listed).alias("f"))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    return as_files(own.select(put("f.p").alias("p"), put("f.c").alias("c")), F.col("p"), F.col("c"))


def placed(rows: DataFrame) -> DataFrame:
    """Sorted rows with place, their number from 1. The rows stay where the sort has put them: each partition's are counted, and only counts come together."""
    table = written(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = table.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each partition of the sort
    before = counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    return table.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("place", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_start")


def _query(detect: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: detect(files_of(spark, sf_dir))


def _only(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(pattern))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "code_debug_rules": _query(lambda f: findings.debug_statements(_only(f, r"out\."))),
    "code_debug_order": _query(lambda f: placed(reports.counted(findings.debug_statements(f), "kind"))),
    "code_todo_order": _query(lambda f: placed(reports.todos_in_order(findings.todos(f))).drop("context")),
    "code_handlers": _query(lambda f: findings.weak_catches(_only(f, r"/h\."))),
    "code_scores": _query(lambda f: placed(reports.top_functions(written(blocks.complexity(f))))),  # a sort reads its rows twice
    "code_doubles": _query(lambda f: blocks.duplicate_blocks(_only(f, BLOCKS)).drop("fingerprint", "preview")),
    "code_double_order": _query(lambda f: placed(blocks.duplicate_counts(_only(f, BLOCKS))).select("place", "first_path", "lines", "n", "wasted")),
    "code_circles": _query(lambda f: placed(imports.import_cycles(f))),
    "code_entry_points": _query(lambda f: _only(symbols.dead_symbols(f), "/in/").select("path", "line", "name")),
    "code_lonely_order": _query(lambda f: placed(imports.unused_files(_only(f, r"/(?:out\.(?:js|tsx)|h\.mjs|tests/.*|out\.test\.js)\z")).where(~F.contains("path", F.lit("__"))))),
}


_S = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier)"
_N = "(SELECT count(*) FROM s)"
_OUTPUT = rows_sql([(p, i, kind, text.strip()) for p, lines in OUTPUT.items() for i, (text, kind) in enumerate(lines, 1) if kind], "path, line, kind, snippet", top="q")
_NOTES = rows_sql([("notes.py", i, *found) for i, (_, found) in enumerate(NOTES, 1) if found], "path, line, kind, text, issue, severity", top="q")
_HANDLERS = rows_sql([(p, i, kind, severity, text.strip()) for p, lines in HANDLERS.items() for i, (text, kind, severity) in enumerate(lines, 1) if kind], "path, line, kind, severity, snippet", top="q")
_SCORES = rows_sql(SCORES, "path, name, line, end_line, complexity, risk", top="q")
_DOUBLES = rows_sql(DOUBLES, "path, line, end_line, name, lines", top="q")
_CIRCLES = rows_sql(CIRCLES, "cycle, path, length", folder=(0, 1), top="q")
_LONELY = rows_sql([(p, len(TEXTS[p].encode())) for p in LONELY], "path, size", top="q")
_PLACE = "row_number() OVER (ORDER BY {}) AS place"

ORACLES: dict[str, str] = {
    "code_debug_rules": f"WITH {_S} {_OUTPUT}",
    "code_debug_order": f"WITH {_S}, g AS (SELECT kind, count(*) AS n FROM ({_OUTPUT}) GROUP BY kind) SELECT kind, n, {_PLACE.format('n DESC, kind')} FROM g",
    "code_todo_order": f"WITH {_S}, t AS ({_NOTES}) SELECT *, {_PLACE.format('severity DESC, path, line')} FROM t",
    "code_handlers": f"WITH {_S} {_HANDLERS}",
    "code_scores": f"WITH {_S}, t AS ({_SCORES}) SELECT *, {_PLACE.format('complexity DESC, path, line')} FROM t",
    "code_doubles": f"WITH {_S}, t AS ({_DOUBLES}) SELECT *, 2 * {_N} AS n, lines * (2 * {_N} - 1) AS wasted, CASE WHEN {_N} = 1 THEN 'q' || (SELECT min(k) FROM s) ELSE '' END AS folder FROM t",
    "code_double_order": f"WITH {_S}, t AS ({_DOUBLES}), g AS (SELECT min(path) AS first_path, min(lines) AS lines, count(*) AS n, min(lines) * (count(*) - 1) AS wasted FROM t GROUP BY regexp_extract(path, '.*/([a-z])[0-9][.]', 1)) SELECT *, {_PLACE.format('lines DESC, first_path')} FROM g",
    "code_circles": f"WITH {_S}, t AS ({_CIRCLES}) SELECT *, {_PLACE.format('length DESC, cycle, path')} FROM t",
    "code_entry_points": f"WITH {_S} {rows_sql(DEAD, 'path, line, name', top='q')}",
    "code_lonely_order": f"WITH {_S}, t AS ({_LONELY}) SELECT *, {_PLACE.format('size DESC, path')} FROM t",
}
