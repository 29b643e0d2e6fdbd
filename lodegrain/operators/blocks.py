"""Blocks of source: function bodies by braces or indent, duplicate blocks, complexity, code that can't be reached.

Heads are lines that a rule names. A brace block ends where the running balance of braces of its file is back at the head's; an indent block
before the next line that is not deeper. A line that takes a balance or an indent back closes each level it passes, so the end of a block is the next closing of its
level: one sorted pass over heads and closings, which are as many as braces or leading blanks, whatever the number of blocks in a file. Bodies are cut from the file's lines, where they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.functions.tables import merged
from lodegrain.functions.text import COMMENT_LINE, EDGE_L, EDGE_R, IDENT, first_rule, lines_of, word

#: Lines a brace body or block can have, and least sizes.
BODY_LINES, BLOCK_LINES = 300, 400
MIN_BRACE, MIN_INDENT, MIN_CHARS, MIN_LINES = 5, 4, 80, 6
RISKS = ((5, "low"), (10, "medium"), (15, "high"))

JS, JAVA, GO, RUST, PYTHON, RUBY = (".ts", ".tsx", ".js", ".jsx", ".mjs"), (".java",), (".go",), (".rs",), (".py",), (".rb",)
_CONTROL = r"(?:if|for|while|switch|catch|else|try|with|do)"
_MODS = r"(?:public|private|protected|internal|static|final|abstract|override|virtual|async|\s)+"
#: Heads of functions for complexity, and of blocks for duplicates, by languages.
FUNCTION_HEADS = {
    JS: [("fn", r"function\s*\*?\s*(\w+)", 1), ("fn", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(", 1), ("fn", rf"^\s*(?:(?:async|static|private|public|protected|override)\s+)*(?!{_CONTROL}\b)(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]|&, ]+)?\s*\{{", 1)],
    JAVA: [("fn", rf"{_MODS}[\w<>\[\]]+\s+(?!(?:if|for|while|catch|switch)\b)(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+\s*)?\{{", 1)],
    GO: [("fn", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", 1)],
    RUST: [("fn", rf"{EDGE_L}fn\s+(\w+)\s*[<(]", 1)],
}
BLOCK_HEADS = {
    (*JS, ".cjs"): [("fn", r"function\s+(\w+)", 1), ("fn", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", 1), ("fn", rf"^\s*(?:async\s+)?(?!{_CONTROL}\b)(\w+)\s*\(", 1)],
    (".java", ".cs", ".php"): [("fn", rf"{_MODS}[\w<>\[\]]+\s+(?!{_CONTROL}\b)(\w+)\s*\(", 1)],
    GO: [("fn", rf"^func\s+(?:\(\w+\s+\*?\w+\)\s+)?({IDENT})\s*\(", 1)],
    RUST: [("fn", rf"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?fn\s+({IDENT})", 1)],
}
INDENT_HEADS = {PYTHON: [("fn", rf"^\s*(?:async\s+)?def\s+({IDENT})", 1)], RUBY: [("fn", rf"^\s*(?:def|class)\s+(?:self\.)?({IDENT})", 1)]}
#: What adds one to a function's complexity. Signs count only where they touch words on both sides.
_SIGNS = rf"|(?<=[A-Za-z0-9_])(?:&&|\|\|)(?=[A-Za-z0-9_])"
DECISIONS = {
    JS: word(r"if|else\s+if|for|while|do|switch|case|catch") + _SIGNS + r"|(?<=[A-Za-z0-9_])\?(?![?.:])(?=[A-Za-z0-9_])",
    JAVA: word(r"if|else\s+if|for|while|do|switch|case|catch") + _SIGNS + r"|(?<=[A-Za-z0-9_])\?(?![?.:])(?=[A-Za-z0-9_])",
    PYTHON: word("if|elif|for|while|except|and|or"),
    GO: word("if|for|case|select") + _SIGNS,
    RUBY: word("if|elsif|unless|for|while|until|rescue|when|and|or") + _SIGNS,
    RUST: word(r"if|else\s+if|for|while|loop|match") + _SIGNS,
}
#: Lines after which none of the same block runs, and lines that close one.
TERMINATOR = rf"^\s*(?:return{EDGE_R}|throw{EDGE_R}|raise{EDGE_R}|panic\s*\(|exit\s*\(|process\.exit\s*\(|os\.Exit\s*\(|sys\.exit\s*\(|abort\s*\()"
CLOSING = rf"^\s*(?:[}}\])]|(?:end|else|elif|elsif|rescue|catch|finally|except|case|default|when|ensure){EDGE_R})"
PREVIEW = 10


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _indent(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"^(\s*)", 1))


def _next_closing(heads: DataFrame, closers: DataFrame) -> DataFrame:
    """heads(path, level, after, ...) with closing: the first line beyond after at which closers(path, level, line) has the level closed; null if none has."""
    rest = [c for c in heads.columns if c not in ("path", "level", "after")]
    asked = heads.select("path", "level", F.col("after").alias("_at"), F.struct(*rest).alias("_q"))
    kind = asked.schema["_q"].dataType
    both = asked.unionByName(closers.select("path", "level", F.col("line").alias("_at"), F.lit(None).cast(kind).alias("_q")))
    backwards = Window.partitionBy("path", "level").orderBy(F.desc("_at"), F.col("_q").isNull())
    found = F.last(F.when(F.col("_q").isNull(), F.col("_at")), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("closing", found).where("_q is not null").select("path", "closing", "_q.*")


def _closers(lines: DataFrame) -> DataFrame:
    """(path, level, line): the levels that each of lines(path, line, before, now) closes as it goes from one level to a lower one."""
    return lines.where("now < before").select("path", F.explode(F.sequence("now", F.col("before") - 1)).alias("level"), "line")


def _bodies(ends: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """(path, ext, name, line, end_line, closed, body) of ends(path, name, head, end_line, closed), cut from the files' lines; without an end, up to the file's last line or limit lines."""
    per_file = ends.groupBy("path").agg(F.collect_list(F.struct("name", "head", "end_line", "closed")).alias("_b"))
    wide = merged(files.select("path", "ext", "content"), per_file, "path").select("path", "ext", F.split("content", "\n").alias("_t"), "_b")
    last = lambda b: F.coalesce(b["end_line"], F.least(F.size("_t"), b["head"] + (limit - 1)) if limit else F.size("_t"))
    cut = lambda b: F.struct(b["name"].alias("name"), b["head"].alias("line"), last(b).alias("end_line"), b["closed"].alias("closed"), F.slice("_t", b["head"], last(b) - b["head"] + 1).alias("body"))
    return wide.select("path", "ext", F.explode(F.transform("_b", cut)).alias("_x")).select("path", "ext", "_x.*")


def _of(files: DataFrame, rules: dict) -> DataFrame:
    return files.where(F.col("ext").isin([e for exts in rules for e in exts]) & F.col("content").isNotNull())


def brace_blocks(files: DataFrame, rules: dict, limit: int, unclosed: bool = False) -> DataFrame:
    """(path, ext, name, line, end_line, closed, body): from each head to the line at which its braces are closed, within limit lines; heads whose braces don't open and close there
    give none, or with unclosed the lines that were read."""
    files = _of(files, rules)
    net = _count(F.col("text"), "{") - _count(F.col("text"), "}")
    head = F.coalesce(*(F.when(F.col("ext").isin(list(exts)), first_rule(F.col("text"), r)) for exts, r in rules.items()))["name"]
    slim = lines_of(files).select("path", "line", net.alias("_net"), F.contains("text", F.lit("{")).alias("_opens"), head.alias("name"))
    by_line = Window.partitionBy("path").orderBy("line")
    lines = slim.withColumn("now", F.sum("_net").over(by_line)).withColumn("before", F.col("now") - F.col("_net"))
    # the first line from here on that opens a brace
    first = F.last(F.when(F.col("_opens"), F.struct("line", "now")), ignorenulls=True).over(Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0))
    heads = lines.withColumn("_f", first).where(F.col("name").isNotNull() & (F.col("_f.line") < F.col("line") + limit))
    asked = heads.select("path", F.col("before").alias("level"), F.col("_f.line").alias("after"), "name", F.col("line").alias("head"), F.when(F.col("_f.now") <= F.col("before"), F.col("_f.line")).alias("_here"))
    ends = _next_closing(asked, _closers(lines)).withColumn("end_line", F.coalesce("_here", "closing"))
    ends = ends.withColumn("end_line", F.when(F.col("end_line") < F.col("head") + limit, F.col("end_line"))).withColumn("closed", F.col("end_line").isNotNull())
    return _bodies(ends if unclosed else ends.where("closed"), files, limit)


def indent_blocks(files: DataFrame, rules: dict) -> DataFrame:
    """The same for blocks of deeper or blank lines of any number; trailing blank lines belong to them."""
    files = _of(files, rules)
    by_line = Window.partitionBy("path").orderBy("line")
    head = F.coalesce(*(F.when(F.col("ext").isin(list(exts)), first_rule(F.col("text"), r)) for exts, r in rules.items()))["name"]
    solid = lines_of(files).where(F.col("text").rlike(r"\S")).select("path", "line", _indent(F.col("text")).alias("now"), head.alias("name"))
    lines = solid.withColumn("before", F.lag("now").over(by_line)).withColumn("_next", F.lead(F.struct("line", "now")).over(by_line))
    here = F.when(F.col("_next.now") <= F.col("now"), F.col("_next.line"))
    asked = lines.where("name is not null").select("path", F.col("now").alias("level"), F.coalesce("_next.line", "line").alias("after"), "name", F.col("line").alias("head"), here.alias("_here"))
    ends = _next_closing(asked, _closers(lines.where("before is not null"))).withColumn("end_line", F.coalesce("_here", "closing") - 1)
    return _bodies(ends.withColumn("closed", F.col("end_line").isNotNull()), files)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _taken(spans: pa.Array) -> pa.Array:
    """Starts of a file's spans from the top, each that starts inside one already taken left out."""
    out = []
    for row in spans.to_pylist():
        until, taken = 0, []
        for x in sorted(row, key=lambda x: (x["s"], x["e"])):
            if x["s"] > until:
                taken.append(x["s"])
                until = x["e"]
        out.append(taken)
    return pa.array(out, pa.list_(pa.int32()))


def without_overlap(blocks: DataFrame) -> DataFrame:
    """Blocks of a file from the top, each that starts inside one already taken left out. Only the places of a file's blocks come together."""
    spans = blocks.groupBy("path").agg(F.collect_list(F.struct(F.col("line").alias("s"), F.col("end_line").alias("e"))).alias("_s"))
    return blocks.join(spans.select("path", F.explode(_taken("_s")).alias("line")), ["path", "line"])


#: Rewrites of code in their order, each with letters without which it changes nothing.
REWRITES = (
    (r"//[^\n\r]*", "", ("//",)), (r"(?s)/\*.*?\*/", "", ("/*",)), (r"#[^\n]*", "", ("#",)), (word("const|let|var") + r"\s+\w+", "VAR _", ("const", "let", "var")), (word("function|def|func|fn|sub") + r"\s+\w+", "FN _", ("func", "def", "fn", "sub")),
    ('"[^"]*"', '""', ('"',)), ("'[^']*'", "''", ("'",)), ("`[^`]*`", "``", ("`",)), (rf"{EDGE_L}\d+(?:\.\d+)?{EDGE_R}", "0", ()), (r"\s+", " ", ()),
)


def _rewrite(pattern: str, by: str, signs: tuple[str, ...]):
    """One rewrite of a text. The pattern runs only where a plain substring test says that it may match."""
    may = lambda b: F.greatest(*(F.contains(b, F.lit(x)) for x in signs), F.lit(False))
    return lambda b: F.when(may(b), F.regexp_replace(b, pattern, by)).otherwise(b) if signs else F.regexp_replace(b, pattern, by)


def normalised(body: Column) -> Column:
    """Code without comments, names of declarations, contents of strings, numbers and spacing."""
    for rewrite in REWRITES:
        body = F.get(F.transform(F.array(body), _rewrite(*rewrite)), F.lit(0))  # the lambda's variable keeps the text from being worked out for each use
    return F.trim(body)


def _coded_blocks(files: DataFrame, min_lines: int) -> DataFrame:
    brace = brace_blocks(files, BLOCK_HEADS, BLOCK_LINES).where(F.col("end_line") - F.col("line") + 1 >= MIN_BRACE)
    indent = indent_blocks(files, INDENT_HEADS).where(F.col("end_line") - F.col("line") + 1 >= MIN_INDENT)
    blocks = without_overlap(brace.unionByName(indent).drop("closed")).where(F.col("end_line") - F.col("line") + 1 >= min_lines)
    coded = blocks.withColumn("_code", normalised(F.array_join("body", "\n"))).where(F.length("_code") >= MIN_CHARS)
    return coded.select(F.sha2("_code", 256).alias("fingerprint"), "path", "line", "end_line", "name", F.slice("body", 1, 4).alias("preview"))


def duplicate_blocks(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(fingerprint, path, line, end_line, name, n, lines, wasted, preview, folder): each block with equal normalised code in two places or more, with its group's figures.

    The first occurrence by path and line gives lines and preview. Occurrences are rows, so a group may be of any size.
    """
    rows = _coded_blocks(files, min_lines)
    return rows.drop("preview").join(group_counts(rows).drop("first_path"), "fingerprint")


def duplicate_counts(files: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """group_counts() of a file table's blocks, the longest first."""
    return group_counts(_coded_blocks(files, min_lines)).orderBy(F.desc("lines"), "first_path")


def group_counts(rows: DataFrame) -> DataFrame:
    """(fingerprint, n, lines, wasted, preview, first_path, folder) of groups of rows(fingerprint, path, line, end_line, name, preview) of two or more: sums that are made
    before rows meet, so a group of any size is one small row. folder is the deepest that holds all: what the first and the last folder by parts have in common."""
    first = F.min_by(F.struct("preview", (F.col("end_line") - F.col("line") + 1).alias("lines"), "path"), F.struct("path", "line"))
    parts = F.split(F.regexp_replace(F.col("path").cast("string"), r"/?[^/]*\z", ""), "/")
    groups = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), first.alias("_f"), F.min(parts).alias("_a"), F.max(parts).alias("_b")).where("n > 1")
    apart = F.array_position(F.zip_with("_a", "_b", lambda a, b: ~a.eqNullSafe(b)), True)
    folder = F.array_join(F.when(apart == 0, F.col("_a")).otherwise(F.slice("_a", F.lit(1), (apart - 1).cast("int"))), "/")
    return groups.select("fingerprint", "n", F.col("_f.lines").alias("lines"), (F.col("_f.lines") * (F.col("n") - 1)).alias("wasted"), F.col("_f.preview").alias("preview"), F.col("_f.path").alias("first_path"), folder.alias("folder"))


def risk(score: Column) -> Column:
    return F.coalesce(*(F.when(score <= most, F.lit(name)) for most, name in RISKS), F.lit("critical"))


def decisions(text: Column, ext: Column) -> Column:
    return F.coalesce(*(F.when(ext.isin(list(exts)), F.regexp_count(text, F.lit(p))) for exts, p in DECISIONS.items()), F.lit(0))


def complexity(files: DataFrame, threshold: int = 5) -> DataFrame:
    """(path, name, line, end_line, complexity, risk) of functions with a risk above low and at least the threshold.

    Nested functions count in both; in brace languages a head on the line right after that of a function is part of it only.
    """
    brace = brace_blocks(files, FUNCTION_HEADS, BODY_LINES, unclosed=True).withColumn("_body", F.when(F.col("closed"), F.slice("body", F.lit(1), F.greatest(F.size("body") - 1, F.lit(0)))).otherwise(F.col("body")))
    indent = indent_blocks(files, {PYTHON: INDENT_HEADS[PYTHON]}).withColumn("_body", F.slice("body", F.lit(2), F.greatest(F.size("body") - 1, F.lit(0))))
    ruby = ruby_blocks(files).withColumn("_body", F.slice("body", F.lit(2), F.greatest(F.size("body") - F.when(F.col("closed"), 2).otherwise(1), F.lit(0))))
    long = F.size("_body") >= 2
    rows = _every_other(brace.where(long)).unionByName(indent.where(long)).unionByName(ruby.where(long))
    scored = rows.withColumn("complexity", 1 + decisions(F.array_join("_body", "\n"), F.col("ext")))
    return scored.withColumn("risk", risk(F.col("complexity"))).where((F.col("risk") != "low") & (F.col("complexity") >= threshold)).select("path", "name", "line", "end_line", "complexity", "risk")


def _every_other(heads: DataFrame) -> DataFrame:
    """Heads without those right below a closed head that stays: the first, third and so on of a run of lines that are all heads."""
    in_file = Window.partitionBy("path").orderBy("line")
    above = F.lag(F.when(F.col("closed"), F.col("line"))).over(in_file)
    starts = F.when(F.coalesce(above, F.lit(-1)) != F.col("line") - 1, F.col("line"))
    run = heads.withColumn("_starts", starts).withColumn("_first", F.last("_starts", ignorenulls=True).over(in_file))
    return run.where((F.col("line") - F.col("_first")) % 2 == 0).drop("_starts", "_first")


def ruby_blocks(files: DataFrame) -> DataFrame:
    """Ruby methods: a line with an opening word is one deeper, one with end one less; a method, also one that ends on its first line, stops at the next line that
    goes below its depth, or with its file (closed is false), which words after a statement (x if y) can bring about."""
    files = _of(files, {RUBY: []})
    by_line = Window.partitionBy("path").orderBy("line")
    step = F.col("text").rlike(word("def|do|begin|class|module|if|unless|while|for|until|case")).cast("int") - F.col("text").rlike(word("end")).cast("int")
    slim = lines_of(files).select("path", "line", step.alias("_net"), F.nullif(F.regexp_extract("text", r"^\s*def\s+(\w+)", 1), F.lit("")).alias("name"))
    lines = slim.withColumn("now", F.sum("_net").over(by_line)).withColumn("before", F.col("now") - F.col("_net"))
    asked = lines.where("name is not null").select("path", (F.col("now") - 1).alias("level"), F.col("line").alias("after"), "name", F.col("line").alias("head"))
    ends = _next_closing(asked, _closers(lines)).withColumn("end_line", F.col("closing")).withColumn("closed", F.col("closing").isNotNull())
    return _bodies(ends, files)


def unreachable(files: DataFrame) -> DataFrame:
    """(path, line, unreachable_line, unreachable_end, severity, preview): lines after one that leaves the block, up to a blank, a shallower or a closing line.

    A line that leaves the block inside code already reported is passed over. A multi-line return counts as leaving at its first line. A preview has ten lines
    and a mark that there are more.
    """
    files = files.where("content is not null")
    text = F.col("text")
    comment = text.rlike(COMMENT_LINE)
    slim = lines_of(files).select(
        "path", "line", text.rlike(r"\S").alias("_solid"), _indent(text).alias("_indent"), (text.rlike(CLOSING) | comment).alias("_bars"), (text.rlike(TERMINATOR) & ~comment).alias("_leaves"), text.rlike("throw|raise|panic").alias("_throws")
    )
    backwards = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(F.col("_solid"), F.struct("line", "_indent", "_bars")), ignorenulls=True).over(backwards)
    heads = slim.withColumn("_next", after).where(F.col("_leaves") & ~F.col("_next._bars") & (F.col("_next._indent") >= F.col("_indent")))
    per_file = heads.groupBy("path").agg(F.collect_list(F.struct("line", F.col("_next.line").alias("first"), "_indent", "_throws")).alias("_h"))
    wide = files.select("path", F.split("content", "\n").alias("_t")).join(per_file, "path").select("path", "_t", F.explode("_h").alias("h"))
    near = wide.select("path", "h.*", F.slice("_t", F.col("h.first"), PREVIEW + 1).alias("_near"))
    stop = F.array_position(F.transform("_near", lambda t: ~t.rlike(r"\S") | (F.length(F.regexp_extract(t, r"^(\s*)", 1)) < F.col("_indent")) | t.rlike(CLOSING)), True).cast("int")
    size = F.least(F.when(stop > 0, stop - 1).otherwise(F.size("_near")), F.lit(PREVIEW))
    listed = F.transform(F.slice("_near", F.lit(1), size), lambda t: F.regexp_replace(t, r"\s+\z", ""))
    rows = near.select("path", "line", F.col("first").alias("unreachable_line"), F.when(size == PREVIEW, F.concat(listed, F.array(F.lit("  ...")))).otherwise(listed).alias("preview"), F.when(F.col("_throws"), F.lit("error")).otherwise(F.lit("warning")).alias("severity"))
    rows = rows.withColumn("unreachable_end", F.col("unreachable_line") - 1 + F.size("preview")).withColumn("end_line", F.col("unreachable_end"))
    return without_overlap(rows).select("path", "line", "unreachable_line", "unreachable_end", "severity", "preview")
