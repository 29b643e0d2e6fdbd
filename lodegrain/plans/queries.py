"""The operators over the driver's tables: documents stand for files, orders for history, nations for modules. Each has SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegrain.functions.text import EDGE_L, IDENT, first_rule, lines_of
from lodegrain.operators import blocks, config, findings, graph, history, imports, symbols
from lodegrain.plans import codebase, samples, scan
from lodegrain.sources.files import as_files
from lodegrain.streaming.watch import bursts

AS_OF = "timestamp_ntz'2000-01-01 00:00:00'"
CUT_OFF = "timestamp_ntz'1996-01-01 00:00:00'"
#: A flow between nations is an edge from this share of all lines on.
FLOW_SHARE = 400


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return as_files(docs, F.col("doc_id"), F.col("text"))


def _definitions(files: DataFrame) -> DataFrame:
    """Identifiers at the start of a line; capitalised ones are classes."""
    name = F.regexp_extract("text", f"^({IDENT})", 1)
    rows = lines_of(files).withColumn("name", name).where("name <> ''")
    return rows.select(F.col("path").cast("bigint").alias("path"), "line", "name", F.when(F.col("name").rlike("^[A-Z]"), F.lit("class")).otherwise(F.lit("function")).alias("kind"))


def _references(files: DataFrame) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("content", F.lit(rf"{EDGE_L}({IDENT})"), F.lit(1)))
    return files.where("content is not null").select(F.col("path").cast("bigint").alias("path"), F.explode(words).alias("name"))


def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return symbols.dead(_definitions(files), _references(files)).select(F.col("path").alias("doc_id"), "line", "name", "kind")


def symbol_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return symbols.use_counts(_definitions(files), _references(files)).select(F.col("path").alias("doc_id"), "name", "n_files")


def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang")
    files = _files(spark, sf_dir)
    defs = _definitions(files)
    both = defs.groupBy("path").agg(F.count(F.lit(1)).alias("d"))
    dead = symbols.dead(defs, _references(files)).groupBy("path").agg(F.count(F.lit(1)).alias("x"))
    out = docs.join(both, "path", "left").join(dead, "path", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("d"), F.lit(0)).alias("definitions"), F.coalesce(F.sum("x"), F.lit(0)).alias("dead"))
    return out.withColumn("dead_percent", F.when(F.col("definitions") > 0, F.round(100 * F.col("dead") / F.col("definitions"))).otherwise(0).cast("bigint"))


def cleanup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return symbols.cleanup_stats(symbols.dead(_definitions(files), _references(files)))


def ignore_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").where(symbols.not_ignored(F.col("p_brand"), ("*#1*", "B*3", "x.*"))).select("p_partkey", "p_brand")


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    on = ("o_custkey", "o_orderpriority", "o_orderstatus")
    before = orders.where(F.col("o_orderdate") < F.expr(CUT_OFF)).select(*on)
    return history.new_since(orders.where(F.col("o_orderdate") >= F.expr(CUT_OFF)).select("o_orderkey", *on), before, on)


def order_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    age = history.days_ago(seconds(F.col("o_orderdate")), seconds(F.expr(AS_OF)))
    return _table(spark, sf_dir, "orders").withColumn("days", age).where(F.col("days") >= history.duration_days("36m")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("days").cast("bigint").alias("least"), F.max("days").cast("bigint").alias("most"))


def notice_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.with_context(lines_of(_files(spark, sf_dir)), F.col("text").rlike("(?i)licen[sc]e"))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "line", F.array_join("context", " / ").alias("context"))


def issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"/([a-z]+)/", 1).alias("section"), F.regexp_extract("url", r"/(\d+)", 1).alias("number")).where("number <> ''")


def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("alarm", "^(error)$", 1), ("money", "^(purchase|signup)$", 1), ("look", "^(view|cl.*)$", 1)]
    kinds = _table(spark, sf_dir, "events").select(first_rule(F.col("event_type"), rules).alias("r"), "user_id")
    return kinds.groupBy(F.col("r.kind").alias("kind"), F.col("r.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.secrets(_files(spark, sf_dir))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "line", "kind", "confidence", "entropy", "redacted")


def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("code", blocks.normalised(F.col("text"))).where(F.length("code") >= blocks.MIN_CHARS)
    size = F.size(F.split("text", "\n"))
    rows = docs.select(F.md5(F.col("code").cast("binary")).alias("fingerprint"), F.col("doc_id").alias("path"), F.lit(1).alias("line"), size.alias("end_line"), F.lit(None).cast("string").alias("name"), F.array("lang").alias("preview"))
    return blocks.group_counts(rows).select("fingerprint", "n", F.col("lines").cast("bigint").alias("lines"), F.col("wasted").cast("bigint").alias("wasted"), F.col("preview")[0].alias("lang"), F.col("first_path").alias("first_doc"))


def complexity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = 1 + blocks.decisions(F.col("text"), F.lit(".py"))
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", score.cast("bigint").alias("complexity"), blocks.risk(score).alias("risk"))


def unused_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = _table(spark, sf_dir, "part").select(F.lit("m").alias("manager"), F.lower("p_type").alias("name")).distinct()
    words = _table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{3,5})"), F.lit(1))).alias("name")).distinct()
    return imports.unused(declared, words.select(F.lit("m").alias("manager"), "name")).select("name")


def unused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).union(_table(spark, sf_dir, "events").select("event_type")).union(_table(spark, sf_dir, "documents").select("lang")).distinct()
    return config.unmentioned(keys, _table(spark, sf_dir, "documents").select(F.col("text").alias("content")))


def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    idle = _table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti")
    return idle.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def resolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as importing files, parts as what exists."""
    paths = _table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("lib/p"), "p_partkey", F.lit(".ts")).alias("path")).union(_table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.concat(F.lit("lib/p"), "p_partkey", F.lit("/index.ts"))))
    asked = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), "s_suppkey", F.lit(".ts")).alias("path"), F.concat(F.lit("./../lib/./p"), "s_suppkey").alias("spec"))
    return imports.resolve(asked, paths, imports.CYCLE_ENDINGS)


def flow_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    buyers = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("dst"))
    flows = lines.join(suppliers, "l_suppkey").join(buyers, "l_orderkey").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = flows.agg(F.sum("n").alias("total"))
    return graph.components(flows.join(F.broadcast(total)).where(F.col("n") * FLOW_SHARE >= F.col("total")).select("src", "dst"))


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return _table(spark, sf_dir, "customer").withColumn("place", rank).where("place <= 5").select("c_mktsegment", "place", "c_custkey", "c_acctbal")


def scan_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    complex_docs = complexity_scores(spark, sf_dir).where("risk in ('high', 'critical')")
    board = scan.board({"secrets": secrets(spark, sf_dir), "notices": notice_context(spark, sf_dir), "complexity": complex_docs, "dead": symbols.dead(_definitions(files), _references(files))})
    return board.select("detector", "issues", F.col("bar").cast("bigint").alias("bar"))


def event_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    runs = bursts(events, "ts", "6 hours", "10 minutes", "user_id")
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"), F.max("n").alias("longest"), F.sum("n").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (dead_symbols, symbol_use, language_stats, cleanup_stats, ignore_patterns, baseline_diff, order_ages, notice_context, issue_refs, event_kinds, secrets, duplicate_documents, complexity_scores, unused_types, unused_keys, idle_customers, resolved_imports, flow_circles, top_customers, scan_board, event_bursts)
} | codebase.QUERIES | samples.QUERIES

_LINES = "lines AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"
_DEFS = f"{_LINES}, defs AS (SELECT doc_id, line, name, CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'class' ELSE 'function' END AS kind FROM (SELECT doc_id, line, regexp_extract(text, '^([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM lines) WHERE name <> '')"
_REFS = r"refs AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM documents)"
_DEAD = f"{_DEFS}, {_REFS}, dead AS (SELECT * FROM defs d WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.name = d.name AND r.doc_id <> d.doc_id))"
_WORDS = r"\b(?:if|elif|for|while|except|and|or)\b"
_SCORES = f"scores AS (SELECT doc_id, complexity, CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 10 THEN 'medium' WHEN complexity <= 15 THEN 'high' ELSE 'critical' END AS risk FROM (SELECT doc_id, 1 + len(regexp_extract_all(text, '{_WORDS}')) AS complexity FROM documents WHERE text IS NOT NULL))"
_SENSITIVE = r"""(?i)((?:[a-z0-9_]*(?:api_?key|secret|token|passw(?:or)?d|credential)[a-z0-9_]*))\s*[:=]\s*["'']([^"''\s]{8,})["'']"""
_SHAPED = (("aws_key", r"\b(AKIA[0-9A-Z]{16})\b"), ("github_token", r"(gh[ps]_[A-Za-z0-9]{36,})"), ("private_key", r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----)"), ("connection_string", r"""([a-z][a-z0-9+]*://[^\s:/@]+:[^\s:/@]+@[^\s"'']+)"""))
_SECRETS = f"""shaped AS ({" UNION ALL ".join(f"SELECT doc_id, line, '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS value FROM lines" for kind, p in _SHAPED)}),
named AS (SELECT doc_id, line, unnest(regexp_extract_all(text, '{_SENSITIVE}', 2)) AS value FROM lines),
found AS (SELECT * FROM shaped UNION ALL SELECT doc_id, line, 'assigned_secret', value FROM named n WHERE NOT EXISTS (SELECT 1 FROM shaped x WHERE x.doc_id = n.doc_id AND x.line = n.line AND x.value = n.value)),
bits AS (SELECT doc_id, line, kind, value, round((SELECT -sum(p * log2(p)) FROM (SELECT count(*) / len(value) AS p FROM (SELECT unnest(string_split(value, '')) AS c) GROUP BY c)), 6) AS entropy FROM found
  WHERE value <> '' AND NOT regexp_matches(value, '(?i)(?:example|placeholder|changeme|your[_-]|xxxx|<[^>]*>|\\$\\{{|dummy|sample)')),
secrets AS (SELECT doc_id, line, kind, CASE WHEN kind <> 'assigned_secret' THEN 'high' WHEN entropy >= 3.5 AND len(value) >= 16 THEN 'medium' ELSE 'low' END AS confidence, entropy, substr(value, 1, 4) || '****' AS redacted FROM bits)"""
_NOTICES = f"""around AS (SELECT doc_id, line, text, list(text) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS c FROM lines),
notices AS (SELECT doc_id, line, array_to_string(c, ' / ') AS context FROM around WHERE regexp_matches(text, '(?i)licen[sc]e'))"""


def _normalised(text: str) -> str:
    steps = ((r"//[^\n\r]*", ""), (r"(?s)/\*.*?\*/", ""), (r"#[^\n]*", ""), (r"\b(?:const|let|var)\b\s+\w+", "VAR _"), (r"\b(?:function|def|func|fn|sub)\b\s+\w+", "FN _"), ('"[^"]*"', '""'), ("''[^'']*''", "''''"), ("`[^`]*`", "``"), (r"\b\d+(?:\.\d+)?\b", "0"), (r"\s+", " "))
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return f"trim({text}, ' ')"


ORACLES: dict[str, str] = {
    "dead_symbols": f"WITH {_DEAD} SELECT doc_id, line, name, kind FROM dead",
    "symbol_use": f"WITH {_DEFS}, {_REFS}, n AS (SELECT name, count(*) AS n FROM refs GROUP BY name) SELECT d.doc_id, d.name, coalesce(n.n, 0) - (CASE WHEN r.name IS NULL THEN 0 ELSE 1 END) AS n_files FROM (SELECT DISTINCT doc_id, name FROM defs) d LEFT JOIN n USING (name) LEFT JOIN refs r ON r.doc_id = d.doc_id AND r.name = d.name",
    "language_stats": f"WITH {_DEAD}, a AS (SELECT doc_id, count(*) AS d FROM defs GROUP BY 1), b AS (SELECT doc_id, count(*) AS x FROM dead GROUP BY 1) SELECT lang, count(*) AS files, CAST(coalesce(sum(d), 0) AS BIGINT) AS definitions, CAST(coalesce(sum(x), 0) AS BIGINT) AS dead, CAST(CASE WHEN coalesce(sum(d), 0) > 0 THEN round(100.0 * coalesce(sum(x), 0) / sum(d)) ELSE 0 END AS BIGINT) AS dead_percent FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) GROUP BY lang",
    "cleanup_stats": f"WITH {_DEAD} SELECT kind, count(*) AS dead, CAST(sum(CASE kind WHEN 'class' THEN 30 ELSE 12 END) AS BIGINT) AS estimated_lines FROM dead GROUP BY kind",
    "ignore_patterns": r"SELECT p_partkey, p_brand FROM part WHERE NOT regexp_matches(p_brand, '(?:^.*#1.*$)|(?:^B.*3$)|(?:^x\..*$)')",
    "baseline_diff": "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders c WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderdate < TIMESTAMP '1996-01-01' AND b.o_custkey = c.o_custkey AND b.o_orderpriority = c.o_orderpriority AND b.o_orderstatus = c.o_orderstatus)",
    "order_ages": "SELECT o_orderpriority, count(*) AS n, min(days) AS least, max(days) AS most FROM (SELECT o_orderpriority, CAST(floor((epoch(TIMESTAMP '2000-01-01') - floor(epoch(o_orderdate))) / 86400) AS BIGINT) AS days FROM orders) WHERE days >= 90 * 12 GROUP BY 1",
    "notice_context": f"WITH {_LINES}, {_NOTICES} SELECT doc_id, line, context FROM notices",
    "issue_refs": r"SELECT page_id, regexp_extract(url, '/([a-z]+)/', 1) AS section, regexp_extract(url, '/(\d+)', 1) AS number FROM pages WHERE regexp_extract(url, '/(\d+)', 1) <> ''",
    "event_kinds": "SELECT CASE WHEN event_type = 'error' THEN 'alarm' WHEN event_type IN ('purchase', 'signup') THEN 'money' WHEN event_type = 'view' OR event_type LIKE 'cl%' THEN 'look' END AS kind, event_type AS name, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "secrets": f"WITH {_LINES}, {_SECRETS} SELECT doc_id, line, kind, confidence, entropy, redacted FROM secrets",
    "duplicate_documents": f"WITH c AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS lines, {_normalised('text')} AS code FROM documents) SELECT md5(code) AS fingerprint, count(*) AS n, arg_min(lines, doc_id) AS lines, arg_min(lines, doc_id) * (count(*) - 1) AS wasted, arg_min(lang, doc_id) AS lang, min(doc_id) AS first_doc FROM c WHERE len(code) >= 80 GROUP BY code HAVING count(*) > 1",
    "complexity_scores": f"WITH {_SCORES} SELECT doc_id, complexity, risk FROM scores",
    "unused_types": "WITH d AS (SELECT DISTINCT lower(p_type) AS name FROM part), u AS (SELECT DISTINCT unnest(regexp_extract_all(text, '([a-z]{3,5})', 1)) AS w FROM conversations) SELECT name FROM d WHERE NOT EXISTS (SELECT 1 FROM u WHERE w = name OR starts_with(w, name || '/') OR contains(name, w))",
    "unused_keys": "WITH k AS (SELECT p_brand AS key FROM part UNION SELECT event_type FROM events UNION SELECT lang FROM documents) SELECT key FROM k WHERE NOT EXISTS (SELECT 1 FROM documents WHERE contains(text, key))",
    "idle_customers": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1",
    "resolved_imports": "WITH p AS (SELECT p_partkey AS k FROM part) SELECT 'src/s' || s_suppkey || '.ts' AS path, './../lib/./p' || s_suppkey AS spec, CASE WHEN s_suppkey % 3 = 0 THEN 'lib/p' || s_suppkey || '.ts' ELSE 'lib/p' || s_suppkey || '/index.ts' END AS target FROM supplier JOIN p ON k = s_suppkey WHERE s_suppkey % 3 = 0 OR s_suppkey % 5 = 0",
    "flow_circles": f"""WITH RECURSIVE f AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT src, dst FROM f WHERE n * {FLOW_SHARE} >= (SELECT sum(n) FROM f) AND src <> dst), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src""",
    "top_customers": "SELECT c_mktsegment, place, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5",
    "scan_board": f"""WITH {_DEAD}, {_SECRETS}, {_NOTICES}, {_SCORES},
b AS (SELECT 'secrets' AS detector, count(*) AS issues FROM secrets UNION ALL SELECT 'notices', count(*) FROM notices UNION ALL SELECT 'complexity', count(*) FROM scores WHERE risk IN ('high', 'critical') UNION ALL SELECT 'dead', count(*) FROM dead)
SELECT detector, issues, CAST(CASE WHEN max(issues) OVER () > 0 THEN round(issues * 18.0 / max(issues) OVER ()) ELSE 0 END AS BIGINT) AS bar FROM b""",
    "event_bursts": "WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM n GROUP BY 1, 2) SELECT user_id, count(*) AS bursts, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
} | codebase.ORACLES | samples.ORACLES
