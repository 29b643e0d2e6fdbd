"""All detectors over one file table, their counts on one board, and results as report lines."""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions.tables import written
from lodegrain.operators import blocks, config, findings, imports, symbols
from lodegrain.sources.report import ROWS, write_document

DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "dead_symbols": symbols.dead_symbols,
    "unused_files": imports.unused_files,
    "unused_packages": imports.unused_packages,
    "todos": findings.todos,
    "duplicates": blocks.duplicate_counts,
    "unreachable": blocks.unreachable,
    "weak_catches": findings.weak_catches,
    "unused_keys": config.unused_keys,
    "debug_statements": findings.debug_statements,
    "complexity": lambda f: blocks.complexity(f).where("risk in ('high', 'critical')"),
    "import_cycles": lambda f: imports.import_cycles(f).select("cycle").distinct(),
    "secrets": lambda f: findings.secrets(f).where("confidence <> 'low'"),
}


def scan(files: DataFrame) -> dict[str, DataFrame]:
    """The result of each detector. A caller who wants the files to be read once persists them, and lets go of them after the results are used."""
    return {name: detect(files) for name, detect in DETECTORS.items()}


def board(results: dict[str, DataFrame], width: int = 18) -> DataFrame:
    """(detector, issues, bar): a count of each result and its length on a scale of width. The counts run as one job."""
    counts = [df.agg(F.count(F.lit(1)).alias("issues")).select(F.lit(name).alias("detector"), "issues") for name, df in results.items()]
    both = reduce(DataFrame.unionByName, counts)
    most = both.agg(F.max("issues").alias("most"))
    return both.join(F.broadcast(most)).select("detector", "issues", F.when(F.col("most") > 0, F.round(F.col("issues") / F.col("most") * width)).otherwise(0).cast("int").alias("bar"))


def counted(files: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]] | None = None, at_once: int = 4) -> list[tuple[str, int | None, str | None]]:
    """(detector, issues, failure) of each detector. The files are read once, as they are written to the shared folder; the detectors work on that table, some jobs at a time, and one that fails has no count."""
    detectors = DETECTORS if detectors is None else detectors
    table = written(files)

    def count(name: str) -> tuple[str, int | None, str | None]:
        try:
            return name, detectors[name](table).count(), None
        except Exception as e:  # noqa: BLE001  whatever a detector fails with is its result
            return name, None, str(e).strip().split("\n")[0][:200]

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(count, detectors))


def safe_board(files: DataFrame, detectors: dict[str, Callable[[DataFrame], DataFrame]] | None = None, width: int = 18) -> DataFrame:
    """board() with the column failure: a detector that fails has neither issues nor bar."""
    rows = counted(files, detectors)
    most = max((n for _, n, _ in rows if n is not None), default=0)
    bar = lambda n: None if n is None else int(n / most * width + 0.5) if most else 0
    return files.sparkSession.createDataFrame([(name, n, bar(n), failure) for name, n, failure in rows], "detector string, issues bigint, bar int, failure string")


def totals(results: dict[str, DataFrame]) -> DataFrame:
    """(issues): the sum over all detectors."""
    return board(results).agg(F.sum("issues").alias("issues"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def json_report(files: DataFrame, dead_rows: DataFrame, stats: DataFrame, cleanup: DataFrame) -> DataFrame:
    """One JSON text of the figures of an analysis: scannedFiles, deadSymbolCount, detectedLanguages and cleanup by kind. The symbols themselves are as_json() of their rows, as they may be of any number."""
    languages = stats.agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("_n"), "language", "files", "definitions", "dead"))).alias("_l")).select(F.transform("_l", lambda x: F.struct(x["language"].alias("language"), x["files"].alias("fileCount"), x["definitions"].alias("definitionCount"), x["dead"].alias("deadCount"))).alias("detectedLanguages"))
    kinds = cleanup.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "dead")))).alias("byKind"), F.coalesce(F.sum("estimated_lines"), F.lit(0)).alias("estimatedLines"))
    counts = files.agg(F.count(F.lit(1)).alias("scannedFiles")).join(F.broadcast(dead_rows.agg(F.count(F.lit(1)).alias("deadSymbolCount"))))
    return counts.join(F.broadcast(languages)).join(F.broadcast(kinds.select(F.struct("byKind", "estimatedLines").alias("cleanup")))).select(F.to_json(F.struct("scannedFiles", "deadSymbolCount", "detectedLanguages", "cleanup")).alias("value"))


#: Results of a SARIF document, about.
DOCUMENT_RESULTS = 5000


def as_sarif(rows: DataFrame, rule: str, message: str = "name") -> DataFrame:
    """Results in the form of SARIF 2.1.0, one JSON text for each row of rows(path, line, ...)."""
    return rows.select(F.to_json(_result(rows, rule, message)).alias("value"))


def _result(rows: DataFrame, rule: str, message: str) -> Column:
    column = F.col("column") + 1 if "column" in rows.columns else F.lit(1)
    region = F.struct(F.col("line").alias("startLine"), column.alias("startColumn"))
    place = [F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")]
    if {"name", "kind"} <= set(rows.columns):
        place.append(F.array(F.struct("name", "kind")).alias("logicalLocations"))
    return F.struct(F.lit(rule).alias("ruleId"), F.struct(F.col(message).cast("string").alias("text")).alias("message"), F.lit("warning").alias("level"), F.array(F.struct(*place)).alias("locations"))


def sarif_documents(rows: DataFrame, rule: str, text: str, message: str = "name") -> DataFrame:
    """(document, value): whole SARIF 2.1.0 documents of one run each, with the tool and its rule. Rows are dealt by path over as many documents as hold about DOCUMENT_RESULTS each, so none grows with the corpus."""
    parts = max(1, -(-rows.count() // DOCUMENT_RESULTS))
    dealt = rows.select(F.pmod(F.xxhash64("path", "line"), F.lit(parts)).cast("int").alias("document"), F.struct("path", "line", _result(rows, rule, message).alias("r")).alias("x"))
    results = dealt.groupBy("document").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    about = F.struct(F.lit(rule).alias("id"), F.struct(F.lit(text).alias("text")).alias("shortDescription"), F.struct(F.lit("warning").alias("level")).alias("defaultConfiguration"))
    tool = F.struct(F.struct(F.lit("lodegrain").alias("name"), F.array(about).alias("rules")).alias("driver"))
    whole = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(tool.alias("tool"), F.col("results"))).alias("runs"))
    return results.select("document", F.to_json(whole).alias("value"))


def write_json(files: DataFrame, dead_rows: DataFrame, path: str) -> None:
    """Write one JSON document of an analysis: the figures of json_report() and all dead symbols, however many they are."""
    defs = symbols.definitions(files)
    head = json.loads(json_report(files, dead_rows, symbols.language_stats(files, defs, dead_rows), symbols.cleanup_stats(dead_rows)).first().value)
    write_document(as_json(dead_rows), path, head | {"deadSymbols": ROWS})


def write_sarif(rows: DataFrame, path: str, rule: str, text: str, message: str = "name") -> None:
    """Write one SARIF 2.1.0 document of all rows."""
    about = {"id": rule, "shortDescription": {"text": text}, "defaultConfiguration": {"level": "warning"}}
    run = {"tool": {"driver": {"name": "lodegrain", "rules": [about]}}, "results": ROWS}
    write_document(as_sarif(rows, rule, message), path, {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]})
