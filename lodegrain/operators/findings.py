"""Findings on single lines and their neighbours: annotated comments, debug output, credentials, weak error handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrain.functions.text import COMMENT_LINE, EDGE_L, EDGE_R, by_extension, first_rule, lines_of, trim_space

#: Annotations and their weights.
SEVERITY = {"DEPRECATED": 5, "BUG": 4, "FIXME": 3, "HACK": 2}
TODO = r"(?i)(?://|#|--|/\*)\s*(TODO|FIXME|HACK|XXX|BUG|TEMP|DEPRECATED)(?![A-Za-z0-9_])[\s:]*([^*\n]*)"
ISSUE = r"(#\d+|[A-Z]+-\d+)"

#: Debug output by language; a captured method renames its kind.
DEBUG_RULES = {
    (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"): [("log", r"console\.(log|warn|debug|info|error|trace|dir)\s*\(", 1)],
    (".py",): [("print", r"^\s*print()\s*\(", 1), ("debug", rf"{EDGE_L}pprint()\s*\(", 1), ("log", rf"{EDGE_L}logging\.(debug|info|warning|error|critical)\s*\(", 1)],
    (".go",): [("print", rf"{EDGE_L}fmt\.(Print|Println|Printf|Fprintf|Sprintf)\s*\(", 1), ("log", rf"{EDGE_L}log\.(Print|Println|Printf|Fatal|Fatalf|Fatalln|Panic)\s*\(", 1)],
    (".java",): [("print", r"System\.out\.(print|println|printf)\s*\(", 1), ("error", r"System\.err\.(print|println|printf)\s*\(", 1), ("error", r"e\.printStackTrace()\s*\(", 1)],
    (".rb",): [("debug", r"^\s*p()\s+", 1), ("print", r"^\s*puts()\s+", 1), ("debug", r"^\s*pp()\s+", 1), ("error", r"\$stderr\.puts()", 1)],
    (".rs",): [("print", rf"{EDGE_L}println!()\s*\(", 1), ("print", rf"{EDGE_L}print!()\s*\(", 1), ("error", rf"{EDGE_L}eprintln!()\s*\(", 1), ("debug", rf"{EDGE_L}dbg!()\s*\(", 1)],
    (".php",): [("debug", rf"{EDGE_L}var_dump()\s*\(", 1), ("debug", rf"{EDGE_L}print_r()\s*\(", 1), ("print", rf"{EDGE_L}echo()\s+", 1), ("debug", rf"{EDGE_L}var_export()\s*\(", 1)],
    (".cs",): [("print", r"Console\.(Write|WriteLine|Error\.Write|Error\.WriteLine)\s*\(", 1), ("debug", r"Debug\.(Write|WriteLine|Print)\s*\(", 1), ("trace", r"Trace\.(Write|WriteLine)\s*\(", 1)],
}
RENAMED = {"warn": "warn", "warning": "warn", "debug": "debug", "info": "info", "error": "error", "err": "error", "trace": "trace", "dir": "dir", "log": "log"}
TEST_PATH = r"(?:\.(?:test|spec)\.[jt]sx?\z|__(?:tests?|mocks?)__|(?:^|/)tests?/|(?:^|/)spec/)"

#: Tokens of known shape, names of credentials, and values that are none.
TOKENS = (("aws_key", r"(?<![A-Z0-9])(AKIA[0-9A-Z]{16})(?![A-Z0-9])", 1), ("github_token", r"(gh[ps]_[A-Za-z0-9]{36,})", 1), ("private_key", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)", 1), ("connection_string", r"([a-z][a-z0-9+]*://[^\s:/@]+:[^\s:/@]+@[^\s\"']+)", 1))
#: A named value begins at the edge of a word, so that a long word is tried once.
SENSITIVE = r"(?i)(?<![a-z0-9_])((?:[a-z0-9_]*(?:api_?key|secret|token|passw(?:or)?d|credential)[a-z0-9_]*))\s*[:=]\s*[\"']([^\"'\s]{8,})[\"']"
PLACEHOLDER = r"(?i)(?:example|placeholder|changeme|your[_-]|xxxx|<[^>]*>|\$\{|dummy|sample)"
MIN_ENTROPY, MIN_LENGTH = 3.5, 16
#: Letters in lower case of which a text with any finding holds some.
SIGNS = ("akia", "ghp_", "ghs_", "private key-----", "://", "key", "secret", "token", "passw", "credential")

#: Catches that name no specific error.
BROAD_CATCH = r"(?i)catch\s*\(\s*(?:e|err|error|ex|exception|_)\s*(?::\s*(?:any|Error|Exception|Throwable|\w+Error))?\s*\)"
BROAD_EXCEPT = r"^\s*except\s*(?:Exception|BaseException)?\s*(?:as\s+\w+)?\s*:"
BRACE_EXTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".java", ".cs", ".php")
EMPTY_PYTHON, EMPTY_RUBY, EMPTY_GO = r"^\s*pass\s*(?:#.*)?\z", r"^\s*(?:end|nil|#.*)?\s*\z", r"^\s*\}\s*\z"
ERROR_GO, DISCARD_GO = rf"{EDGE_L}if\s+err\s*!=\s*nil\s*\{{", r"(?:^|\s)_\s*(?:,\s*_\s*)*="
PANIC, PANIC_COMMENT = r"\.(?:unwrap|expect)\s*\(", r"//.*\.(?:unwrap|expect)"


def _in_file() -> Window:
    return Window.partitionBy("path").orderBy("line")


def with_context(lines: DataFrame, wanted: Column) -> DataFrame:
    """The wanted rows of lines(path, line, text) with context: one line before and two after, as far as the file goes."""
    return lines.withColumn("context", F.collect_list("text").over(_in_file().rowsBetween(-1, 2))).where(wanted)


def todos(files: DataFrame, blame: DataFrame | None = None, older_than: int | None = None) -> DataFrame:
    """(path, line, kind, text, issue, context, severity): the first annotation of each line, with one line before and two after.

    With blame(path, line, author, days_ago): author and days_ago too; older_than drops lines that are known to be younger.
    """
    lines = with_context(lines_of(files), F.col("text").rlike(TODO))
    kind = F.upper(F.regexp_extract("text", TODO, 1))
    said = trim_space(F.regexp_extract("text", TODO, 2))
    issue = F.nullif(F.regexp_extract(said, ISSUE, 1), F.lit(""))
    severity = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in SEVERITY.items()), F.lit(1))
    out = lines.select("path", "line", kind.alias("kind"), said.alias("text"), issue.alias("issue"), "context", severity.alias("severity"))
    return out if blame is None else with_age(out, blame, older_than)


def with_age(rows: DataFrame, blame: DataFrame, older_than: int | None = None) -> DataFrame:
    """rows(path, line, ...) with author and days_ago; rows younger than older_than go, those of unknown age stay."""
    out = rows.join(blame.select("path", "line", "author", "days_ago"), ["path", "line"], "left")
    return out if older_than is None else out.where(F.coalesce(F.col("days_ago") >= older_than, F.lit(True)))


def by_author(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose author's name holds a text, whatever the case; rows without an author go."""
    return rows.where(F.contains(F.lower("author"), F.lit(name.lower())))


def debug_statements(files: DataFrame, skip_tests: bool = True) -> DataFrame:
    """(path, line, kind, snippet): debug output outside comment lines, the first rule of the file's language that matches."""
    lines = lines_of(files if not skip_tests else files.where(~F.col("path").rlike(TEST_PATH)))
    found = by_extension(F.col("ext"), {exts: first_rule(F.col("text"), rules) for exts, rules in DEBUG_RULES.items()})
    rows = lines.where(~F.col("text").rlike(COMMENT_LINE)).withColumn("_r", found).where("_r is not null")
    method = F.lower(F.col("_r.name"))
    kind = F.coalesce(*(F.when(method == m, F.lit(k)) for m, k in RENAMED.items()), F.col("_r.kind"))
    return rows.select("path", "line", kind.alias("kind"), F.substring(trim_space(F.col("text")), 1, 120).alias("snippet"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character, rounded to six places."""
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.round(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), 6)


def redacted(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 4), F.lit("****"))


def secrets(files: DataFrame) -> DataFrame:
    """(path, line, kind, confidence, entropy, redacted): tokens of known shape (high), and values given to sensitive names (medium from MIN_ENTROPY and
    MIN_LENGTH on, else low); all of a line, a named value of known shape once. Example files, test files and placeholders are left out. The thresholds are this library's own."""
    low = F.lower("content")
    held = F.lit(False)
    for x in SIGNS:
        held = held | F.contains(low, F.lit(x))
    lines = lines_of(files.where(~F.col("path").rlike(r"(?:\.example\z|" + TEST_PATH + ")") & held))
    text = F.col("text")
    lines = lines.where(F.lower(text).rlike("|".join(SIGNS)))
    values = lambda kind, p, g, high: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name"), F.lit(high).alias("high")))
    shaped = F.concat(*(values(kind, p, g, True) for kind, p, g in TOKENS))
    named = values("assigned_secret", SENSITIVE, 2, False)
    found = lines.withColumn("_shaped", shaped).withColumn("_named", named)
    own = F.filter("_named", lambda n: ~F.exists("_shaped", lambda s: s["name"] == n["name"]))
    rows = found.select("path", "line", F.explode(F.concat("_shaped", own)).alias("_s")).where(~F.col("_s.name").rlike(PLACEHOLDER)).withColumn("_high", F.col("_s.high"))
    bits = entropy(F.col("_s.name"))
    level = F.when(F.col("_high"), "high").when((bits >= MIN_ENTROPY) & (F.length("_s.name") >= MIN_LENGTH), "medium").otherwise("low")
    return rows.select("path", "line", F.col("_s.kind").alias("kind"), level.alias("confidence"), bits.alias("entropy"), redacted(F.col("_s.name")).alias("redacted"))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def weak_catches(files: DataFrame) -> DataFrame:
    """(path, line, kind, severity, snippet): handlers that do nothing, discard errors, panic or catch everything.

    In brace languages the handler is what stands between the braces that open on the catch line (or the next): if they close at once, it
    is empty; a catch line that leaves them open counts as its own first line, so only its breadth can be reported.
    """
    # in descending order the line after is the one before, and the next solid line is the last so far
    w = Window.partitionBy("path").orderBy(F.desc("line"))
    some = files.where(F.col("ext").isin([*BRACE_EXTS, ".py", ".go", ".rs", ".rb"]))
    lines = lines_of(some).withColumn("_next", F.lag("text", 1).over(w)).withColumn("_solid", F.last(F.when(F.col("text").rlike(r"\S"), F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    text, ext = F.col("text"), F.col("ext")
    opened = F.when(text.contains("{"), text).otherwise(F.coalesce("_next", text))
    brace = F.when(text.rlike(rf"{EDGE_L}catch{EDGE_R}"), F.when(_count(opened, "{") <= _count(opened, "}"), F.lit("empty:error")).when(text.rlike(BROAD_CATCH), F.lit("broad:info")))
    python = F.when(text.rlike(rf"^\s*except{EDGE_R}"), F.when(F.col("_solid").rlike(EMPTY_PYTHON), F.lit("empty:error")).when(text.rlike(BROAD_EXCEPT), F.lit("broad:info")))
    empty_go = F.when(text.rlike(ERROR_GO) & F.col("_next").rlike(EMPTY_GO), F.lit("empty:error"))
    discard = F.when(text.rlike(DISCARD_GO) & ~text.contains("//"), F.lit("swallowed:warning"))
    panics = F.when(text.rlike(PANIC) & ~text.rlike(PANIC_COMMENT) & ~F.col("path").rlike("test|spec"), F.when(text.contains(".unwrap()"), F.lit("panic:warning")).otherwise(F.lit("panic:info")))
    ruby = F.when(text.rlike(rf"^\s*rescue{EDGE_R}") & F.col("_solid").rlike(EMPTY_RUBY), F.lit("empty:error"))
    marks = F.array(F.when(ext.isin(list(BRACE_EXTS)), brace).when(ext == ".py", python).when(ext == ".go", empty_go).when(ext == ".rs", panics).when(ext == ".rb", ruby), F.when(ext == ".go", discard))
    rows = lines.select("path", "line", text.alias("snippet"), F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
    return rows.select("path", "line", F.split_part("m", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("m", F.lit(":"), F.lit(2)).alias("severity"), trim_space(F.col("snippet")).alias("snippet"))
