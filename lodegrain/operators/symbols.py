"""Definitions, references, and definitions that nothing refers to.

Most languages are lists of ordered line rules; the first that matches a line defines a symbol. References are the identifiers of the other lines. A definition is
dead if no other file refers to its name. References are reduced to the first and last path of each name before they meet the definitions, so a word that all files hold is one
row. The TypeScript family, and languages that users add, are read by functions (plugins) instead of lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions.tables import merged
from lodegrain.functions.text import EDGE_L, IDENT, basename, by_extension, first_rule, lines_of
from lodegrain.operators import plugins

#: Weights of a dead symbol in lines, entry points and ignored names.
LINES = {"function": 12, "method": 10, "class": 30, "variable": 1, "interface": 8, "type": 3, "enum": 6, "struct": 15, "trait": 12, "module": 20}
OTHER_LINES = 5
ENTRY_POINTS = ("index.ts", "index.js", "main.ts", "main.js", "app.ts", "app.py", "main.go", "main.py", "main.rb", "main.rs", "Program.cs", "Main.java")
IGNORED_NAMES = ("_*", "__*", "test_*", "*_test", "*Test", "*Spec")
#: The tool whose comment on the line before asks for a definition to be left alone: its name and -ignore.
TOOL = "lodegrain"


@dataclass(frozen=True)
class Language:
    """Line rules (kind, pattern, group of the name), kinds whose lines still count as references, names that are no definitions, and what is exported."""

    name: str
    extensions: tuple[str, ...]
    rules: tuple[tuple[str, str, int], ...]
    open_kinds: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    exported: str = "all"
    open_rules: tuple[int, ...] = field(default=())


_MODS_JAVA = r"(?:public|private|protected|static|final|abstract|synchronized|native|\s)+"
_MODS_CS = r"(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|partial|readonly|\s)+"
#: Heads of definitions in each language, and what counts as exported.
LANGUAGES = (
    Language("python", (".py",), (("method", rf"^\s+(?:async\s+)?def\s+({IDENT})\s*\(", 1), ("function", rf"^(?:async\s+)?def\s+({IDENT})\s*\(", 1), ("class", rf"^\s*class\s+({IDENT})\s*[:(]", 1), ("variable", rf"^(?!_)({IDENT})\s*=", 1)), ("variable",), (), "underscore"),
    Language("go", (".go",), (("method", rf"^func\s+\(\w+\s+\*?(\w+)\)\s+{IDENT}\s*\(", 1), ("function", rf"^func\s+({IDENT})\s*\(", 1), ("struct", rf"^type\s+({IDENT})\s+struct", 1), ("interface", rf"^type\s+({IDENT})\s+interface", 1), ("type", rf"^type\s+({IDENT})\s+(?:map|chan|\[)", 1), ("variable", rf"^(?:var|const)\s+({IDENT})\s", 1)), (), (), "upper"),
    Language("java", (".java",), (("class", rf"{EDGE_L}class\s+({IDENT})", 1), ("interface", rf"{EDGE_L}interface\s+({IDENT})", 1), ("enum", rf"{EDGE_L}enum\s+({IDENT})", 1), ("method", rf"^(?!\s*(?://|\*)).*?(?:^|(?<=\W)){_MODS_JAVA}[\w<>\[\]]+\s+({IDENT})\s*\(", 1)), ("method",), ("if", "while", "for", "switch", "catch"), "public"),
    Language("csharp", (".cs",), (("class", rf"^(?!\s*(?://|\*)).*?{_MODS_CS}class\s+({IDENT})", 1), ("interface", rf"^(?!\s*(?://|\*)).*?{_MODS_CS}interface\s+({IDENT})", 1), ("enum", rf"^(?!\s*(?://|\*)).*?{_MODS_CS}enum\s+({IDENT})", 1), ("method", rf"^(?!\s*(?://|\*)).*?{_MODS_CS}[\w<>\[\]?]+\s+({IDENT})\s*\(", 1), ("variable", rf"^(?!\s*(?://|\*)).*?{_MODS_CS}[\w<>\[\]?]+\s+({IDENT})\s*\{{", 1)), (), ("if", "while", "for", "foreach", "switch", "catch", "using", "lock"), "public"),
    Language("ruby", (".rb",), (("method", rf"^\s*def\s+(?:self\.)?({IDENT}[?!]?)", 1), ("class", r"^\s*class\s+([A-Z][A-Za-z_]*)", 1), ("module", r"^\s*module\s+([A-Z][A-Za-z_]*)", 1)), (), (), "ruby"),
    Language("rust", (".rs",), tuple((k, rf"^\s*(?:pub(?:\([^)]*\))?\s+)?{head}\s+({name})", 1) for k, head, name in (("function", r"(?:async\s+)?fn", IDENT), ("struct", "struct", IDENT), ("enum", "enum", IDENT), ("trait", "trait", IDENT), ("type", "type", IDENT), ("variable", "const", r"[A-Z_][A-Za-z0-9_]*"))), (), (), "pub"),
    Language("php", (".php",), (("function", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+({IDENT})\s*\(", 1), ("class", rf"^\s*(?:(?:abstract|final)\s+)?class\s+({IDENT})", 1), ("interface", rf"^\s*interface\s+({IDENT})", 1), ("trait", rf"^\s*trait\s+({IDENT})", 1)), (), (), "php"),
)
#: Endings of the languages that are read by line rules.
RULED = tuple(e for x in LANGUAGES for e in x.extensions)


def language_of(ext: Column) -> Column:
    """The language of files with an ending, one of the added plugins' too; null for others."""
    by_rules = {x.extensions: F.lit(x.name) for x in LANGUAGES}
    return by_extension(ext, by_rules | {(e,): F.lit(p.language) for e, p in plugins.by_ending(RULED).items()})


def marker(tool: str) -> str:
    """The pattern of a tool's ignore comment."""
    return rf"(?://|#)\s*{re.escape(tool)}-ignore(?![A-Za-z0-9_-])"


def _by_rules(text: Column, of: Callable[[Column], Column]) -> Column:
    """of(struct(kind, name)) of the line's definition by its language's rules. The rules are tried inside a lambda, where Spark interprets them: their code would be longer than a Java method may be."""
    return F.transform(F.array(text), lambda t: of(by_extension(F.col("ext"), {x.extensions: first_rule(t, list(x.rules)) for x in LANGUAGES})))


def _ruled(files: DataFrame) -> DataFrame:
    """Files of the languages that are read by line rules."""
    return files.where(F.col("ext").isin(list(RULED)) & F.col("content").isNotNull())


def definitions(files: DataFrame, tool: str = TOOL) -> DataFrame:
    """(path, line, language, name, kind, column, exported, ignored, end_line): what each file defines; end_line where the language is read by tokens.

    Go methods are named Receiver.name, TypeScript's Class.name. A definition is ignored if the line before it holds the tool's marker. Lines over several megabytes are lines like others; null contents define nothing.
    """
    split = F.split("content", "\n")
    both = F.arrays_zip(split.alias("text"), F.concat(F.array(F.lit("")), split).alias("before"))
    listed = (F.col("ext") == ".py") & F.col("content").rlike(r"(?m)^__all__\s*=")
    lines = _ruled(files).select("path", "ext", listed.alias("_all"), F.posexplode(both).alias("_at", "_l")).select("path", "ext", "_all", (F.col("_at") + 1).alias("line"), "_l.text", "_l.before").where("text is not null")
    # explode() works each line's definition out once and drops lines without one
    rows = lines.select("*", language_of(F.col("ext")).alias("language"), F.explode(F.array_compact(_by_rules(F.col("text"), lambda d: d))).alias("_d"))
    text, name, lang = F.col("text"), F.col("_d.name"), F.col("language")
    for x in LANGUAGES:
        if x.excluded:
            rows = rows.where(~((lang == x.name) & name.isin(list(x.excluded))))
    receiver = (lang == "go") & (F.col("_d.kind") == "method")
    full = F.when(receiver, F.concat(name, F.lit("."), F.regexp_extract(text, rf"^func\s+\(\w+\s+\*?\w+\)\s+({IDENT})", 1))).otherwise(name)
    column = F.when(lang == "python", F.length(F.regexp_extract(text, r"^(\s*)", 1))).otherwise(0)
    last = F.element_at(F.split(full, r"\."), -1)
    exported = (
        F.when(lang == "python", ~last.startswith("_"))
        .when(lang == "go", F.substring(last, 1, 1).rlike("[A-Z]"))
        .when(lang.isin("java", "csharp"), text.contains("public") | ((lang == "csharp") & (F.col("_d.kind") == "interface")))
        .when(lang == "ruby", ~last.startswith("_") & ~text.rlike(r"\b(?:private|protected)\b"))
        .when(lang == "rust", text.rlike(r"^\s*pub\b"))
        .otherwise((F.col("_d.kind") != "function") | ~text.rlike("private|protected"))
    )
    exported = exported & ~(F.col("_all") & F.col("_d.kind").isin("function", "method"))
    ruled = rows.select("path", "line", "language", full.alias("name"), F.col("_d.kind").alias("kind"), column.alias("column"), exported.alias("exported"), F.col("before").rlike(marker(tool)).alias("ignored"), F.lit(None).cast("int").alias("end_line"))
    parsed = plugins.facts(files, marker(tool), RULED).select("path", "language", F.explode("definitions").alias("d"))
    return ruled.unionByName(parsed.select("path", "d.line", "language", "d.name", "d.kind", "d.column", "d.exported", "d.ignored", "d.end_line"))


def mentions(files: DataFrame) -> DataFrame:
    """(path, name): names in each file but where they are defined. By line rules these are the identifiers of lines that define nothing, or define a kind whose line still refers, as often as they occur; by tokens each name once."""
    opens = [k for x in LANGUAGES for k in ((x.name, o) for o in x.open_kinds)]
    refers = lambda d: d.isNull() | F.struct(language_of(F.col("ext")).alias("l"), d["kind"].alias("k")).isin([F.struct(F.lit(a).alias("l"), F.lit(b).alias("k")) for a, b in opens])
    kept = lines_of(_ruled(files)).where(F.element_at(_by_rules(F.col("text"), refers), 1))
    ruby = F.when(F.col("ext") == ".rb", F.regexp_extract_all("text", F.lit(rf"{EDGE_L}({IDENT}[?!])\("), F.lit(1))).otherwise(F.array().cast("array<string>"))
    ruled = kept.select("path", F.explode(F.concat(F.regexp_extract_all("text", F.lit(rf"{EDGE_L}({IDENT})"), F.lit(1)), ruby)).alias("name"))
    return ruled.union(plugins.facts(files, marker(TOOL), RULED).select("path", F.explode("names").alias("name")))


def references(files: DataFrame) -> DataFrame:
    """mentions() without repeats."""
    return mentions(files).distinct()


def first_definitions(defs: DataFrame) -> DataFrame:
    """One node per file and name: the first line's."""
    return defs.groupBy("path", "name").agg(F.min_by(F.struct(*(c for c in defs.columns if c not in ("path", "name"))), "line").alias("_d")).select("path", "name", "_d.*")


def dead(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """Rows of defs(path, name, ...) whose name no other file refers to: refs(path, name), repeated or not. Names are reduced to their first and last path before rows meet."""
    used = refs.groupBy(F.col("name").alias("_name")).agg(F.min("path").alias("_a"), F.max("path").alias("_b"))
    return merged(defs, used, (F.col("name") == F.col("_name")) & ((F.col("path") != F.col("_a")) | (F.col("path") != F.col("_b"))), "left_anti")


def edges(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(from_path, path, name): which file refers to which definition."""
    return refs.select(F.col("path").alias("from_path"), "name").join(defs.select("path", "name").distinct(), "name").where("from_path <> path").select("from_path", "path", "name").distinct()


def use_counts(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, name, n_files): how many other files refer to each definition. Files are counted by name first, so a name that all files use makes no pairs."""
    by_name = refs.select("path", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    own = refs.select("path", "name", F.lit(1).alias("_own")).distinct()
    nodes = defs.select("path", "name").distinct().join(by_name, "name", "left").join(own, ["path", "name"], "left")
    return nodes.select("path", "name", (F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))).cast("bigint").alias("n_files"))


def glob_pattern(glob: str) -> str:
    """A whole-name pattern of a glob: * is any run; ? stays a quantifier."""
    return "^" + "".join(".*" if c == "*" else "\\" + c if c in ".+^${}()[]|`\\" else c for c in glob) + r"\z"


def not_ignored(name: Column, globs: tuple[str, ...] = IGNORED_NAMES) -> Column:
    return ~name.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs)) if globs else F.lit(True)


def of_languages(files: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """The files of some languages; unknown names have none. javascript is the part of typescript's files that have no types."""
    known = {x.name: x.extensions for x in LANGUAGES} | {p.language: p.extensions for p in plugins.known()} | {"typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx", ".mjs", ".cjs")}
    return files.where(F.col("ext").isin([e for x in languages for e in known.get(x, ())]))


def judged(globs: tuple[str, ...] = IGNORED_NAMES, entry_points: tuple[str, ...] = ENTRY_POINTS) -> Column:
    """Whether a definition may be called dead: no ignored name, no marked line, no export of an entry point."""
    return ~F.col("ignored") & not_ignored(F.col("name"), globs) & ~(F.col("exported") & basename(F.col("path")).isin(list(entry_points)))


def dead_symbols(files: DataFrame, globs: tuple[str, ...] = IGNORED_NAMES, entry_points: tuple[str, ...] = ENTRY_POINTS, tool: str = TOOL) -> DataFrame:
    """Definitions that no other file refers to, without ignored names, marked lines and exports of entry points, with a reason."""
    nodes = first_definitions(definitions(files, tool)).where(judged(globs, entry_points))
    return dead(nodes, mentions(files)).withColumn("reason", F.when(F.col("exported"), F.lit("exported, but no other file names it")).otherwise(F.lit("no other file names it")))


def language_stats(files: DataFrame, defs: DataFrame, dead_rows: DataFrame) -> DataFrame:
    """language, files, definitions, dead and dead_percent, by files."""
    base = files.select(language_of(F.col("ext")).alias("language")).where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    d = defs.groupBy("language").agg(F.count(F.lit(1)).alias("definitions"))
    x = dead_rows.groupBy("language").agg(F.count(F.lit(1)).alias("dead"))
    out = base.join(d, "language", "left").join(x, "language", "left").fillna(0, ["definitions", "dead"])
    return out.withColumn("dead_percent", F.when(F.col("definitions") > 0, F.round(100 * F.col("dead") / F.col("definitions"))).otherwise(0).cast("int")).orderBy(F.desc("files"), "language")


def estimated_lines(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in LINES.items()), F.lit(OTHER_LINES))


def cleanup_stats(dead_rows: DataFrame) -> DataFrame:
    """kind, dead and estimated_lines."""
    return dead_rows.groupBy("kind").agg(F.count(F.lit(1)).alias("dead"), F.sum(estimated_lines(F.col("kind"))).cast("bigint").alias("estimated_lines"))
