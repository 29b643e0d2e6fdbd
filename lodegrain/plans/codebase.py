"""A code base made from the driver's suppliers, every detector over it, and what each must find.

Each supplier k has a folder p{k} of files in all languages; manifests and settings stand at the root. What a detector must find is written down by file and line, read off the
texts by hand, so the SQL of a query repeats no rule of the library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrain.functions.tables import written
from lodegrain.operators import blocks, config, findings, history, imports, symbols
from lodegrain.plans import reports, scan
from lodegrain.sources.files import as_files
from lodegrain.sources.ignore import ignored, rules_of

#: Files of each supplier; {k} is its key.
FILES = {
    "a.py": "import os\nfrom .util import helper_{k}\n\nclass Alpha_{k}(Base):\n    def run_{k}(self, x, y):\n        if x and y or os:\n            return helper_{k}(x)\n        for i in y:\n            while i:\n                if i: print(i)\n        # TODO: tidy AB-7 later\n\n# lodegrain-ignore\ndef kept_{k}():\n    raise ValueError\n    print(\"never\")\n_hidden_{k} = 1\nLIMIT_{k} = 5",
    "util.py": "def helper_{k}(v):\n    try:\n        return v\n    except Exception:\n\n        pass\n    return 1\n\ndef lonely_{k}():\n    return 1",
    "d1.py": "def total_{k}(rows):\n    amount = {k}\n    for row in rows:\n        amount = amount + row * 3\n        print(\"total\", amount)\n    return amount",
    "d2.py": "def sum_{k}(rows):\n    amount = 99\n    for row in rows:\n        amount = amount + row * 7\n        print(\"other\", amount)\n    return amount",
    "m.go": "package m\nimport \"fmt\"\ntype Box_{k} struct {\n}\nfunc (b *Box_{k}) Do_{k}(x int) {\n\tif err != nil {\n\t}\n\t_ = x\n\tfmt.Println(\"x\")\n}\nfunc helper_go_{k}() {}\nvar Max_{k} int",
    "X.java": "public class Main_{k} {\n  public int size_{k}(int a) throws E {\n    Foo_{k} f = new Foo_{k}(a);\n    if (a>1&&a<9||a==3) { return 1; }\n    while (a > 2) { a--; }\n    switch (a) { case 1: break; }\n    System.out.println(a);\n    return a;\n  }\n}",
    "r.rs": "pub fn go_{k}() {\n    a.unwrap();\n    c.expect(\"x\");\n    println!(\"x\");\n}\nconst LIM_{k}: u8 = 1;\nstruct Unit_{k};",
    "u.rs": "use serde::De;\n// API_URL",
    "c.rb": "class Thing_{k}\n  def self.run_{k}!(x)\n    begin\n      puts x\n    rescue\n    end\n  end\nend",
    "f.php": "<?php\nabstract class Shape_{k} {\n  private function area_{k}($x) {\n    var_dump($x);\n  }\n}\ninterface Draw_{k} {}\ntrait Bold_{k} {}",
    "q.cs": "namespace N {\n public class Kind_{k} {\n  public int Prop_{k} { get; }\n  public void Go_{k}(int x) {\n   Console.WriteLine(x);\n  }\n }\n}",
    "src/b.ts": "import { Svc_{k} } from './svc';\nimport type { T } from 'left-pad/x';\nimport './side';\nexport const use_{k} = (a) => {\n  try { a(); }\n  catch (e) {\n    console.warn(e);\n  }\n  return Svc_{k};\n};",
    "src/svc.ts": "export class Svc_{k} {\n  go_ts_{k}() {\n    return 1;\n  }\n}\nexport interface Opt_{k} {\n  a: number;\n}\ntype Id_{k} = string;\nenum Color_{k} { Red }",
    "src/side.ts": "export const side_{k} = 1;",
    "src/index.ts": "export * from './b';",
    "src/orphan.ts": "export function orphan_{k}() {}",
    "src/loop1.ts": "import { l2_{k} } from './loop2';\nexport const l1_{k} = l2_{k};",
    "src/loop2.ts": "import { l1_{k} } from './loop1';\nexport const l2_{k} = 2;",
    "src/al.ts": "import { w } from '@lib/w';\nimport fs from 'fs';",
    "src/ghost.ts": "export const Ghost_{k} = () => 1;",
    "src/deep.ts": "import { Svc_{k} } from './svc';\n// Ghost_{k} is only named here\nconst brace_{k} = \"}{\" + `{ ${Svc_{k}} Ghost_{k}`;\nexport function outer_{k}(a: string) {\n  const inner_{k} = /[{\"]Ghost_{k}/.test(a),\n    twice_{k} = (x: number) => {\n      return x * 2;\n    };\n  function local_{k}() { return inner_{k}; }\n  return local_{k};\n}\n// lodegrain-ignore\nexport abstract class Deep_{k} {\n  static made = '}';\n  get size_ts_{k}() { return 1; }\n  @log()\n  async run_deep_{k}<T>(\n    a: T,\n  ): Promise<T> {\n    return a;\n  }\n}",
}
#: Files at the root.
ROOT = {
    "shared/w.ts": "export const w = 1;", "lib/start2.ts": "export const begin2 = 1;", "tsconfig.json": '{"compilerOptions": {"paths": {"@lib/*": ["shared/*"]}}}',
    "package.json": '{"main": "lib/start2.js", "dependencies": {"left-pad": "1", "fs-extra": "2", "gone": "3", "typescript": "5"}, "devDependencies": {"gone": "4"}}',
    "requirements.txt": "Requests==2 # x\nflask>=1\nos", "go.mod": "module m\nrequire (\n\tgithub.com/a/b v1.0.0\n)\n", "Cargo.toml": '[package]\nname = "x"\n[dependencies]\nserde = "1"\nrand = "0.8"\n[features]\ny = []',
    ".env": "API_URL=x\nUNUSED_KEY=y\nA=1\n", "config.json": '{"db": {"host": "h", "ports": [1]}, "x1": 2}',
}
#: What must be found: (file, line, language, name, kind, column, exported, ignored, dead, end line where the language is read by tokens).
DEFINITIONS = [
    ("a.py", 4, "python", "Alpha_{k}", "class", 0, True, False, True), ("a.py", 5, "python", "run_{k}", "method", 4, True, False, True), ("a.py", 14, "python", "kept_{k}", "function", 0, True, True, False), ("a.py", 18, "python", "LIMIT_{k}", "variable", 0, True, False, True),
    ("util.py", 1, "python", "helper_{k}", "function", 0, True, False, False), ("util.py", 9, "python", "lonely_{k}", "function", 0, True, False, True), ("d1.py", 1, "python", "total_{k}", "function", 0, True, False, True), ("d2.py", 1, "python", "sum_{k}", "function", 0, True, False, True),
    ("m.go", 3, "go", "Box_{k}", "struct", 0, True, False, True), ("m.go", 5, "go", "Box_{k}.Do_{k}", "method", 0, True, False, True), ("m.go", 11, "go", "helper_go_{k}", "function", 0, False, False, True), ("m.go", 12, "go", "Max_{k}", "variable", 0, True, False, True),
    ("X.java", 1, "java", "Main_{k}", "class", 0, True, False, True), ("X.java", 2, "java", "size_{k}", "method", 0, True, False, True), ("X.java", 3, "java", "Foo_{k}", "method", 0, False, False, True),
    ("r.rs", 1, "rust", "go_{k}", "function", 0, True, False, True), ("r.rs", 6, "rust", "LIM_{k}", "variable", 0, False, False, True), ("r.rs", 7, "rust", "Unit_{k}", "struct", 0, False, False, True),
    ("c.rb", 1, "ruby", "Thing_", "class", 0, True, False, True), ("c.rb", 2, "ruby", "run_{k}!", "method", 0, True, False, True),
    ("f.php", 2, "php", "Shape_{k}", "class", 0, True, False, True), ("f.php", 3, "php", "area_{k}", "function", 0, False, False, True), ("f.php", 7, "php", "Draw_{k}", "interface", 0, True, False, True), ("f.php", 8, "php", "Bold_{k}", "trait", 0, True, False, True),
    ("q.cs", 2, "csharp", "Kind_{k}", "class", 0, True, False, True), ("q.cs", 3, "csharp", "Prop_{k}", "variable", 0, True, False, True), ("q.cs", 4, "csharp", "Go_{k}", "method", 0, True, False, True),
    ("src/b.ts", 4, "typescript", "use_{k}", "function", 13, True, False, True, 10), ("src/svc.ts", 1, "typescript", "Svc_{k}", "class", 13, True, False, False, 5), ("src/svc.ts", 2, "typescript", "Svc_{k}.go_ts_{k}", "method", 2, True, False, True, 4),
    ("src/svc.ts", 6, "typescript", "Opt_{k}", "interface", 17, True, False, True, 8), ("src/svc.ts", 9, "typescript", "Id_{k}", "type", 5, False, False, True, 9), ("src/svc.ts", 10, "typescript", "Color_{k}", "enum", 5, False, False, True, 10),
    ("src/side.ts", 1, "typescript", "side_{k}", "variable", 13, True, False, True, 1), ("src/orphan.ts", 1, "typescript", "orphan_{k}", "function", 16, True, False, True, 1), ("src/loop1.ts", 2, "typescript", "l1_{k}", "variable", 13, True, False, False, 2), ("src/loop2.ts", 2, "typescript", "l2_{k}", "variable", 13, True, False, False, 2),
    ("src/ghost.ts", 1, "typescript", "Ghost_{k}", "function", 13, True, False, True, 1), ("src/deep.ts", 3, "typescript", "brace_{k}", "variable", 6, False, False, True, 3), ("src/deep.ts", 4, "typescript", "outer_{k}", "function", 16, True, False, True, 11), ("src/deep.ts", 5, "typescript", "inner_{k}", "variable", 8, False, False, True, 8),
    ("src/deep.ts", 6, "typescript", "twice_{k}", "function", 4, False, False, True, 8), ("src/deep.ts", 9, "typescript", "local_{k}", "function", 11, False, False, True, 9), ("src/deep.ts", 13, "typescript", "Deep_{k}", "class", 22, True, True, False, 22), ("src/deep.ts", 17, "typescript", "Deep_{k}.run_deep_{k}", "method", 8, True, False, True, 21),
]
ROOT_DEFINITIONS = [("shared/w.ts", 1, "typescript", "w", "variable", 13, True, False, False, 1), ("lib/start2.ts", 1, "typescript", "begin2", "variable", 13, True, False, True, 1)]
#: An ignore file, and the files of each supplier that it leaves.
IGNORE = "# notes\n*.RB\n!c.rb\np*/src/\n!p*/src/index.ts\nd?.py\n/u.rs\n[m-n].go\n**/X.java\nf.php/\n"
NOT_IGNORED = ("a.py", "util.py", "r.rs", "u.rs", "c.rb", "f.php", "q.cs")
#: TypeScript files without their dead symbols.
CLEANED = {
    "src/b.ts": "import { Svc_{k} } from './svc';\nimport type { T } from 'left-pad/x';\nimport './side';", "src/svc.ts": "export class Svc_{k} {\n}", "src/side.ts": "", "src/index.ts": FILES["src/index.ts"], "src/orphan.ts": "",
    "src/loop1.ts": FILES["src/loop1.ts"], "src/loop2.ts": FILES["src/loop2.ts"], "src/al.ts": FILES["src/al.ts"], "src/ghost.ts": "",
    "src/deep.ts": "import { Svc_{k} } from './svc';\n// Ghost_{k} is only named here\n// lodegrain-ignore\nexport abstract class Deep_{k} {\n  static made = '}';\n  get size_ts_{k}() { return 1; }\n  @log()\n}",
}
#: Earlier versions of files whose last one is in FILES; when versions were made, in days, and the day of the report.
EARLIER = {"a.py": "import os\nfrom .util import helper_{k}\n\nclass Alpha_{k}(Base):\n        # TODO: tidy AB-7 later", "util.py": "def helper_{k}(v):\n    return v\ndef lonely_{k}():\n    return 1"}
MADE, TODAY = (600, 990), 1000
#: Lines that stem from the earlier version, and how many lines the last one has.
OLD_LINES, ALL_LINES = {"a.py": (1, 2, 3, 4, 11), "util.py": (1, 9, 10)}, {"a.py": 18, "util.py": 10}
EDGES = [("a.py", "util.py", "helper_{k}"), ("src/b.ts", "src/svc.ts", "Svc_{k}"), ("src/deep.ts", "src/svc.ts", "Svc_{k}"), ("src/loop1.ts", "src/loop2.ts", "l2_{k}"), ("src/loop2.ts", "src/loop1.ts", "l1_{k}")]
TODOS = [("a.py", 11, "TODO", "tidy AB-7 later", "AB-7", 1)]
DEBUG = [
    ("a.py", 16, "print", 'print("never")'), ("d1.py", 5, "print", 'print("total", amount)'), ("d2.py", 5, "print", 'print("other", amount)'), ("m.go", 9, "print", 'fmt.Println("x")'), ("X.java", 7, "print", "System.out.println(a);"), ("r.rs", 4, "print", 'println!("x");'),
    ("c.rb", 4, "print", "puts x"), ("f.php", 4, "debug", "var_dump($x);"), ("q.cs", 5, "print", "Console.WriteLine(x);"), ("src/b.ts", 7, "warn", "console.warn(e);"),
]
CATCHES = [
    ("util.py", 4, "empty", "error", "except Exception:"), ("m.go", 6, "empty", "error", "if err != nil {"), ("m.go", 8, "swallowed", "warning", "_ = x"), ("r.rs", 2, "panic", "warning", "a.unwrap();"), ("r.rs", 3, "panic", "info", 'c.expect("x");'),
    ("c.rb", 5, "empty", "error", "rescue"), ("src/b.ts", 6, "broad", "info", "catch (e) {"),
]
UNREACHABLE = [("a.py", 15, 16, 16, "error", '    print("never")')]
COMPLEX = [("a.py", "run_{k}", 5, 12, 7, "medium"), ("X.java", "size_{k}", 2, 9, 7, "medium")]
UNUSED = ("a.py", "util.py", "d1.py", "d2.py", "m.go", "X.java", "r.rs", "u.rs", "c.rb", "f.php", "q.cs", "src/side.ts", "src/orphan.ts", "src/al.ts", "src/ghost.ts", "src/deep.ts")
PACKAGES = [("npm", "gone", "4"), ("pip", "requests", "Requests==2"), ("pip", "flask", "flask>=1"), ("go", "github.com/a/b", "v1.0.0"), ("go", "(", "github.com/a/b"), ("cargo", "rand", '"0.8"')]
KEYS = [("UNUSED_KEY", "y", ".env"), ("db.host", "h", "config.json"), ("db.ports", "[1]", "config.json"), ("x1", "2", "config.json")]


#: Suppliers of a task, each of which becomes dozens of files.
TASK_SUPPLIERS = 1000


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k): the keys of a corpus folder's suppliers, dealt out to as many tasks as their files need; a table of megabytes would be one task, and become gigabytes of text there."""
    table = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return table.select(F.col("s_suppkey").cast("string").alias("k")).repartition(max(1, -(-table.count() // TASK_SUPPLIERS)))


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code base of a corpus folder's suppliers."""
    listed = lambda files, folder: F.array(*(F.struct(F.lit(folder + p).alias("p"), F.lit(t).alias("c")) for p, t in files.items()))
    own = suppliers(spark, sf_dir).select("k", F.explode(listed(FILES, "p{k}/")).alias("f"))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    root = spark.range(1).select(F.explode(listed(ROOT, "")).alias("f")).select("f.p", "f.c")
    return as_files(own.select(put("f.p").alias("p"), put("f.c").alias("c")).union(root), F.col("p"), F.col("c"))


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of some files of the code base, by ann and by bob."""
    each = [F.struct(F.lit(f"p{{k}}/{p}").alias("p"), F.lit(v + 1).alias("version"), F.lit(who).alias("author"), F.lit(86400 * MADE[v]).alias("author_time"), F.lit(text).alias("c")) for p in EARLIER for v, (who, text) in enumerate((("ann", EARLIER[p]), ("bob", FILES[p])))]
    own = suppliers(spark, sf_dir).select("k", F.explode(F.array(*each)).alias("f"))
    put = lambda c: F.replace(F.col(c), F.lit("{k}"), F.col("k"))
    return own.select(put("f.p").alias("path"), "f.version", "f.author", "f.author_time", put("f.c").alias("content"))


def _ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.line_ages(versions_of(spark, sf_dir)).withColumn("days_ago", history.days_ago(F.col("author_time"), F.lit(86400 * TODAY)))


def _dead_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead symbols but those whose line changed in the last 30 days."""
    dead = symbols.dead_symbols(files_of(spark, sf_dir))
    return history.dead_since(dead, _ages(spark, sf_dir), history.duration_days("30d"), F.lit(86400 * TODAY)).select("path", "name", "line", F.col("days_since_last_change").alias("days"))


def _todo_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with author and age, the older ones of ann."""
    aged = findings.with_age(findings.todos(files_of(spark, sf_dir)), _ages(spark, sf_dir), 30)
    return findings.by_author(aged, "ANN").select("path", "line", "kind", "author", "days_ago")


def _query(detect: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: detect(files_of(spark, sf_dir))


def _dead(files: DataFrame) -> DataFrame:
    return symbols.dead_symbols(files).select("path", "name", "kind", "line", "exported")


def _stats(files: DataFrame) -> DataFrame:
    return symbols.language_stats(files, symbols.definitions(files), symbols.dead_symbols(files)).withColumn("dead_percent", F.col("dead_percent").cast("bigint"))


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def _counts(files: DataFrame) -> DataFrame:
    """The detectors' group counts as rows of what, of and n. Each is worked out by itself: as one plan they would fill the driver."""
    named = lambda rows, what, key: rows.select(F.lit(what).alias("what"), F.col(key).alias("of"), F.col("n").cast("bigint").alias("n"))
    dead, debug, unused = written(symbols.dead_symbols(files).select("path", "kind")), written(findings.debug_statements(files).select("path", "kind")), imports.unused_files(files)
    keys = reports.key_counts(config.config_keys(files), config.unused_keys(files))
    ext = F.regexp_extract("path", r"(\.[a-z]+)\z", 1)
    parts = [
        named(reports.catches_by_severity(findings.weak_catches(files)), "catches", "severity"), named(reports.functions_by_risk(blocks.complexity(files)), "functions", "risk"), named(reports.counted(debug, "kind"), "debug", "kind"),
        named(reports.counted(debug.withColumn("ext", ext), "ext"), "debug of language", "ext"), named(reports.counted(findings.todos(files), "kind"), "todos", "kind"),
        reports.unused_bytes(unused).select(F.lit("unused").alias("what"), F.lit("bytes").alias("of"), F.col("bytes").alias("n")), keys.select(F.lit("keys").alias("what"), F.lit("live").alias("of"), F.col("live").alias("n")),
        reports.dead_by_file(dead).agg(F.max("dead").alias("n")).select(F.lit("dead").alias("what"), F.lit("most in a file").alias("of"), "n"), symbols.cleanup_stats(dead).select(F.lit("lines").alias("what"), F.col("kind").alias("of"), F.col("estimated_lines").alias("n")),
    ]
    out = written(parts[0])
    for p in parts[1:]:
        out = out.union(written(p))
    return out


def _cleaned(files: DataFrame) -> DataFrame:
    """Every TypeScript file without its dead symbols, whose ends are known."""
    dead = symbols.dead_symbols(files).where("language = 'typescript'")
    return history.apply_edits(files, history.edit_plan(dead)).where(F.col("path").startswith("p") & F.col("path").endswith(".ts")).select("path", "content")


def _board(files: DataFrame) -> DataFrame:
    return scan.safe_board(files).select("detector", "issues", F.col("bar").cast("bigint").alias("bar"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "code_definitions": _query(symbols.definitions),
    "code_edges": _query(lambda f: symbols.edges(symbols.definitions(f), symbols.references(f))),
    "code_dead": _query(_dead),
    "code_languages": _query(_stats),
    "code_todos": _query(lambda f: reports.todos_in_order(findings.todos(f)).withColumn("context", F.array_join("context", "|"))),
    "code_debug": _query(findings.debug_statements),
    "code_catches": _query(findings.weak_catches),
    "code_unreachable": _query(lambda f: blocks.unreachable(f).withColumn("preview", F.array_join("preview", "|"))),
    "code_complexity": _query(lambda f: reports.top_functions(blocks.complexity(f))),
    "code_top_functions": _query(lambda f: _placed(reports.top_functions(blocks.complexity(f), 5), F.desc("complexity"), F.col("path"), F.col("line")).select("place", "path", "name", "complexity")),
    "code_duplicates": _query(lambda f: blocks.duplicate_blocks(f).drop("fingerprint", "preview")),
    "code_duplicate_groups": _query(lambda f: blocks.duplicate_counts(f).drop("fingerprint", "preview")),
    "code_unused_files": _query(imports.unused_files),
    "code_unused_packages": _query(lambda f: imports.unused_packages(f).select("manager", "name", "version")),
    "code_unused_keys": _query(lambda f: _placed(config.unused_keys(f), F.collate("key", "UNICODE"), F.col("key"))),
    "code_cycles": _query(imports.import_cycles),
    "code_counts": _query(_counts),
    "code_board": _query(_board),
    "code_not_ignored": lambda spark, sf_dir: files_of(spark, sf_dir).where(F.col("path").startswith("p") & F.contains("path", F.lit("/")) & ~ignored(F.col("path"), rules_of(IGNORE))).select("path"),
    "code_cleaned": lambda spark, sf_dir: _cleaned(files_of(spark, sf_dir)),
    "code_line_ages": lambda spark, sf_dir: _ages(spark, sf_dir).select("path", "line", "author", "days_ago"),
    "code_dead_since": _dead_since,
    "code_todo_ages": _todo_ages,
}


def _quoted(x: object) -> str:
    if x is None:
        return "CAST(NULL AS INT)"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    return str(x) if isinstance(x, int) else "replace('" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "', '{k}', k)"


def rows_sql(own: list[tuple], columns: str, root: list[tuple] = (), folder: tuple[int, ...] = (0,), top: str = "p") -> str:
    """SELECT of rows for each supplier, with the folder before the given columns, and of rows at the root."""
    put = lambda r, prefix: ", ".join(_quoted((prefix + x) if i in folder else x) for i, x in enumerate(r))
    parts = [f"SELECT {put(r, top + '{k}/')} FROM s" for r in own] + [f"SELECT {put(r, '')} FROM (SELECT '' AS k)" for r in root]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t({columns})"


_S = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier)"
_DEFS = f"defs AS ({rows_sql([(*r, None)[:10] for r in DEFINITIONS], 'path, line, language, name, kind, \"column\", exported, ignored, dead, end_line', ROOT_DEFINITIONS)})"
_FILES = f"files AS ({rows_sql([(p, t) for p, t in FILES.items()], 'path, content', [(p, t) for p, t in ROOT.items()])})"
_LANGUAGE = "CASE regexp_extract(path, '[.]([a-z]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'rb' THEN 'ruby' WHEN 'cs' THEN 'csharp' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'php' THEN 'php' END"
_WEIGHT = "CASE kind WHEN 'function' THEN 12 WHEN 'method' THEN 10 WHEN 'class' THEN 30 WHEN 'variable' THEN 1 WHEN 'interface' THEN 8 WHEN 'type' THEN 3 WHEN 'enum' THEN 6 WHEN 'struct' THEN 15 WHEN 'trait' THEN 12 END"
_UNUSED = f"unused AS (SELECT path, CAST(strlen(content) AS BIGINT) AS size FROM files WHERE regexp_replace(path, '^p[0-9]+/', '') IN ({', '.join(repr(x) for x in UNUSED)}) AND path LIKE 'p%/%')"
_FLAT = lambda rows, columns: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(repr(x) for x in r) + ')' for r in rows)}) AS t({columns})"
_CONTEXT = "                if i: print(i)|        # TODO: tidy AB-7 later||# lodegrain-ignore"
_COMPLEX = rows_sql(COMPLEX, "path, name, line, end_line, complexity, risk")
_DOUBLES = rows_sql([("d1.py", 1, 6, "total_{k}"), ("d2.py", 1, 6, "sum_{k}")], "path, line, end_line, name")
_GROUP = "2 * count(*) AS n, 6 AS lines, 6 * (2 * count(*) - 1) AS wasted"
_N = "(SELECT count(*) FROM s)"
_AGES = rows_sql([(p, i, *(("ann", TODAY - MADE[0]) if i in OLD_LINES[p] else ("bob", TODAY - MADE[1]))) for p in EARLIER for i in range(1, ALL_LINES[p] + 1)], "path, line, author, days_ago")

ORACLES: dict[str, str] = {
    "code_definitions": f"WITH {_S}, {_DEFS} SELECT path, line, language, name, kind, \"column\", exported, ignored, end_line FROM defs",
    "code_edges": f"WITH {_S} {rows_sql(EDGES, 'from_path, path, name', folder=(0, 1))} UNION ALL SELECT 'p' || k || '/src/al.ts', 'shared/w.ts', 'w' FROM s",
    "code_dead": f"WITH {_S}, {_DEFS} SELECT path, name, kind, line, exported FROM defs WHERE dead",
    "code_languages": f"WITH {_S}, {_DEFS}, {_FILES}, a AS (SELECT {_LANGUAGE} AS language, count(*) AS files FROM files GROUP BY 1), b AS (SELECT language, count(*) AS definitions, count(*) FILTER (dead) AS dead FROM defs GROUP BY 1) SELECT language, files, definitions, dead, CAST(round(100.0 * dead / definitions) AS BIGINT) AS dead_percent FROM a JOIN b USING (language)",
    "code_todos": f"WITH {_S} SELECT *, '{_CONTEXT}' AS context FROM ({rows_sql(TODOS, 'path, line, kind, text, issue, severity')})",
    "code_debug": f"WITH {_S} {rows_sql(DEBUG, 'path, line, kind, snippet')}",
    "code_catches": f"WITH {_S} {rows_sql(CATCHES, 'path, line, kind, severity, snippet')}",
    "code_unreachable": f"WITH {_S} {rows_sql(UNREACHABLE, 'path, line, unreachable_line, unreachable_end, severity, preview')}",
    "code_complexity": f"WITH {_S} {_COMPLEX}",
    "code_top_functions": f"WITH {_S}, f AS ({_COMPLEX}) SELECT row_number() OVER (ORDER BY complexity DESC, path, line) AS place, path, name, complexity FROM f ORDER BY place LIMIT 5",
    "code_duplicates": f"WITH {_S}, g AS (SELECT {_GROUP} FROM s) SELECT d.*, g.*, CASE WHEN {_N} = 1 THEN 'p' || (SELECT min(k) FROM s) ELSE '' END AS folder FROM ({_DOUBLES}) d, g",
    "code_duplicate_groups": f"WITH {_S} SELECT {_GROUP}, min('p' || k || '/d1.py') AS first_path, CASE WHEN count(*) = 1 THEN min('p' || k) ELSE '' END AS folder FROM s",
    "code_unused_files": f"WITH {_S}, {_FILES}, {_UNUSED} SELECT path, size FROM unused",
    "code_unused_packages": _FLAT(PACKAGES, "manager, name, version"),
    "code_unused_keys": f"SELECT *, row_number() OVER (ORDER BY lower(key)) AS place FROM ({_FLAT(KEYS, 'key, value, declared_in')})",
    "code_cycles": f"WITH {_S} SELECT 'p' || k || '/src/loop1.ts' AS cycle, 'p' || k || '/src/' || f AS path, 2 AS length FROM s, (VALUES ('loop1.ts'), ('loop2.ts')) v(f)",
    "code_counts": f"""WITH {_S}, {_DEFS}, {_FILES}, {_UNUSED}, c AS ({rows_sql(CATCHES, 'path, line, kind, severity, snippet')}), d AS ({rows_sql(DEBUG, 'path, line, kind, snippet')})
SELECT 'catches' AS what, severity AS of, count(*) AS n FROM c GROUP BY severity UNION ALL SELECT 'functions', v.r, CASE WHEN v.r = 'medium' THEN {len(COMPLEX)} * {_N} ELSE 0 END FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) v(r)
UNION ALL SELECT 'debug', kind, count(*) FROM d GROUP BY kind UNION ALL SELECT 'debug of language', regexp_extract(path, '([.][a-z]+)$', 1), count(*) FROM d GROUP BY 2 UNION ALL SELECT 'todos', 'TODO', {_N}
UNION ALL SELECT 'unused', 'bytes', CAST(sum(size) AS BIGINT) FROM unused UNION ALL SELECT 'keys', 'live', 1 UNION ALL SELECT 'dead', 'most in a file', max(n) FROM (SELECT count(*) AS n FROM defs WHERE dead GROUP BY path)
UNION ALL SELECT 'lines', kind, CAST(sum({_WEIGHT}) AS BIGINT) FROM defs WHERE dead GROUP BY kind""",
    "code_board": f"""WITH {_S}, {_DEFS}, b AS (
SELECT 'dead_symbols' AS detector, count(*) AS issues FROM defs WHERE dead UNION ALL SELECT v.d, v.n * {_N} FROM (VALUES ('unused_files', {len(UNUSED)}), ('todos', {len(TODOS)}), ('unreachable', {len(UNREACHABLE)}), ('weak_catches', {len(CATCHES)}), ('debug_statements', {len(DEBUG)}), ('import_cycles', 1), ('complexity', 0), ('secrets', 0)) v(d, n)
UNION ALL SELECT 'unused_packages', {len(PACKAGES)} UNION ALL SELECT 'duplicates', 1 UNION ALL SELECT 'unused_keys', {len(KEYS)})
SELECT detector, issues, CAST(round(issues * 18.0 / max(issues) OVER ()) AS BIGINT) AS bar FROM b""",
    "code_not_ignored": f"WITH {_S} {rows_sql([(p,) for p in NOT_IGNORED], 'path')}",
    "code_cleaned": f"WITH {_S} {rows_sql(list(CLEANED.items()), 'path, content')}",
    "code_line_ages": f"WITH {_S} {_AGES}",
    "code_dead_since": f"WITH {_S}, {_DEFS}, a AS ({_AGES}) SELECT path, name, line, days_ago AS days FROM defs LEFT JOIN a USING (path, line) WHERE dead AND coalesce(days_ago >= 30, true)",
    "code_todo_ages": f"WITH {_S}, a AS ({_AGES}) SELECT path, line, kind, author, days_ago FROM ({rows_sql(TODOS, 'path, line, kind, text, issue, severity')}) JOIN a USING (path, line)",
}
