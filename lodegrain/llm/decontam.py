"""Benchmark decontamination by template windows, in DataFrame expressions only.

A text becomes a template: numbers, units after numbers and capitalised words turn into typed placeholders, other words into
lower case. Windows of template words are hash-joined with those of the benchmark. Where enough windows of an item lie on one
diagonal of a document, the slots under the placeholders are compared: every value of the item must stand for one value
of the document, as in a copy or a question with new parameters; chance matches of the bare template fail here.

Two more forms find what the template misses. In the collapsed form a run of like placeholders is one slot, so that names and numbers of
several words keep the places of the rest. In the literal form all words are in lower case, so that the case of a copy is of no account and
items of names and numbers alone have windows. Their windows are added up over neighbouring diagonals, as a word put in or left out
shifts the rest.

An item of one sentence with a number may have too few literals for windows to tell it from chance. It is looked for among the documents' whole
sentences: the template must be equal from edge to edge and no slot in conflict, and where fewer than sentence_literals words are no
placeholders, the first word, which every sentence writes in upper case, must be equal too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrain.llm.common import BROADCAST_ROWS, free_name, materialise, scratch

#: Units that are placeholders after a number, and words that are numbers.
UNITS = "mm cm m km in ft yd mi g kg mg t lb lbs oz ml cl l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres inch inches foot feet mile miles dollar dollars euro euros cent cents pound pounds percent degrees mph kmh kwh w kw v hz ghz mb gb tb".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
NUMBER, NAME, UNIT = "#", "@n", "@u"
#: Forms of a text, the one whose figures are reported first before the others; the mark around a placeholder's value.
TEMPLATE, COLLAPSED, LITERAL, SENTENCE = 0, 1, 2, 3
#: Where a sentence ends, and what one must hold that may be an item with other numbers.
ENDS, HAS_NUMBER = r"[.!?]+(?=\s|$)|[\r\n]+", r"(?i)\d|(?<![\p{L}\p{N}])(?:" + "|".join(NUMBERS) + r")(?![\p{L}\p{N}])"
MARK = "\x01"


@dataclass(frozen=True)
class Rule:
    """Words of a window; words of it that must not be placeholders; windows on a diagonal that make a match (all of an
    item that has fewer); least words of an item that is looked for at all, and of one that is looked for as a template, which are also those of a literal
    window (shorter items are one window); share of slots that may be in conflict; share of an item's words that literal windows must cover; diagonals that are added up; literals from
    which the first word of a sentence may differ."""

    width: int = 8
    literals: int = 4
    windows: int = 6
    least_words: int = 3
    short_words: int = 5
    conflicts: float = 0.2
    covered: float = 0.8
    band: int = 8
    sentence_literals: int = 3


def _spaced(text: Column) -> Column:
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)[.,](?=\d)", "$1")
    s = F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]+", " "))
    s = F.regexp_replace(s, r"(\d)(?=\p{L})", "$1 ")
    return F.regexp_replace(s, r"(\d) (?=(?i:" + "|".join(UNITS) + r")(?: |$))", "$1 @")


def _split(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " "), "")


def words_of(text: Column) -> Column:
    """Words with their case; a unit after a number is marked by @. Null and empty texts have none."""
    return _split(_spaced(text))


def template_of(words: Column, lower: Column) -> Column:
    """The words with placeholders, and literals in lower case; lower has the words in lower case and without the marks of units."""

    def place(w: Column, low: Column) -> Column:
        name = (low != w) & ((F.upper(w) != w) | (F.length(w) == 1))
        return F.when(F.substring(w, 1, 1).between("0", "9") | low.isin(NUMBERS), F.lit(NUMBER)).when(F.startswith(w, F.lit("@")), F.lit(UNIT)).when(name, F.lit(NAME)).otherwise(low)

    return F.zip_with(words, lower, place)


def forms_of(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and for df's text words and template, collapsed (the template with runs of like placeholders as one, and units after number words as after
    numbers), and literal."""
    spaced = df.select(*keep, _spaced(F.col("text")).alias("_s"))
    words = spaced.select(*keep, _split(F.col("_s")).alias("words"), _split(F.lower(F.replace("_s", F.lit("@"), F.lit("")))).alias("literal"))
    rows = words.select(*keep, "words", "literal", template_of(F.col("words"), F.col("literal")).alias("template"))
    united = F.regexp_replace(F.array_join("template", " "), f"{NUMBER} (?:{'|'.join(UNITS)})(?= |$)", f"{NUMBER} {UNIT}")
    return rows.select(*keep, "words", "literal", "template", _split(F.regexp_replace(united, rf"({NUMBER}|{NAME}|{UNIT})(?: \1(?= |$))+", "$1")).alias("collapsed"))


def _collapsed_words(words: Column, template: Column) -> Column:
    """The words of each place of the collapsed form; those of one slot are joined by an underscore, which no word holds."""
    tagged = F.zip_with(words, template, lambda w, k: F.when(_is_slot(k), F.concat(k, F.lit(MARK), F.replace(w, F.lit("@"), F.lit("")), F.lit(MARK), k)).otherwise(k))
    merged = F.regexp_replace(F.array_join(tagged, " "), f"({MARK}{NUMBER} )({'|'.join(UNITS)})(?= |$)", f"$1{UNIT}{MARK}$2{MARK}{UNIT}")
    for k in (NUMBER, NAME, UNIT):
        merged = F.replace(merged, F.lit(f"{MARK}{k} {k}{MARK}"), F.lit("_"))
    return F.transform(_split(merged), lambda x: F.coalesce(F.nullif(F.split_part(F.concat(x, F.lit(MARK)), F.lit(MARK), F.lit(2)), F.lit("")), x))


def with_runs(df: DataFrame, column: str, width: int, form: int) -> tuple[DataFrame, Column]:
    """df with helper columns, and the hashes of each run of width words of its column, which differ by form. Hashes of runs are joined in pairs, each
    length in a column of its own that is looked at twice, so the optimiser leaves it there."""
    run = f"_{column}_run"
    if f"{run}1" not in df.columns:
        df = df.withColumn(f"{run}1", F.transform(column, lambda w: F.xxhash64(w, F.lit(form))))
    lengths, todo = set(), [width]
    while todo:
        n = todo.pop()
        if n > 1 and n not in lengths:
            lengths.add(n)
            todo += [n - n // 2, n // 2]
    for n in sorted(x for x in lengths if f"{run}{x}" not in df.columns):
        a, b = n - n // 2, n // 2
        df = df.withColumn(f"{run}{n}", F.zip_with(f"{run}{a}", F.slice(F.col(f"{run}{b}"), a + 1, F.lit(1 << 30)), lambda x, y: F.xxhash64(x, y)))
    whole = F.when(F.size(f"{run}1") >= width, F.slice(F.col(f"{run}{width}"), F.lit(1), F.size(f"{run}1") - (width - 1))).otherwise(F.array().cast("array<bigint>"))
    return df, whole


def windows_of(df: DataFrame, width: int, keep: list[str], form: int = TEMPLATE) -> DataFrame:
    """keep, j and h: a hash h of each run of width words of df's template, from word j on. What is exploded is an expression, as for a column Spark would
    infer a filter on its size and work everything out once more to apply it."""
    df, whole = with_runs(df, "template", width, form)
    return df.select(*keep, F.posexplode(whole).alias("j", "h"))


def _is_slot(w: Column) -> Column:
    return w.isin(NUMBER, NAME, UNIT)


def benchmark_forms(benchmark: DataFrame, rule: Rule) -> DataFrame:
    """item_id with all forms of each item with enough words."""
    return forms_of(benchmark, ["item_id"]).withColumn("values", _collapsed_words(F.col("words"), F.col("template"))).where(F.size("words") >= rule.least_words)


def benchmark_windows(every: DataFrame, rule: Rule) -> DataFrame:
    """benchmark_forms() to (form, item_id, words, template, width, n_windows, need, h, j) for each window of each form; in templates, with enough literals."""
    spread = None
    for form, words, template in ((TEMPLATE, "words", "template"), (COLLAPSED, "values", "collapsed"), (LITERAL, "literal", "literal")):
        items = every.select(F.lit(form).alias("form"), "item_id", F.col(words).alias("words"), F.col(template).alias("template"))
        low, top = (rule.least_words, rule.short_words) if form == LITERAL else (rule.short_words, rule.width)
        for width in range(low, top + 1):
            own = items.where(F.size("words") >= width if width == top else F.size("words") == width)
            part = windows_of(own.withColumn("width", F.lit(width)), width, ["form", "item_id", "words", "template", "width"], form)
            spread = part if spread is None else spread.union(part)
    literal = F.size(F.filter(F.slice("template", F.col("j") + 1, F.col("width")), lambda w: ~_is_slot(w)))
    kept = spread.where((F.col("form") == LITERAL) | (literal >= F.least(F.lit(rule.literals), F.col("width") - 1)))
    counts = kept.groupBy("form", "item_id", "template").agg(F.count(F.lit(1)).alias("n_windows"))
    joined = kept.join(counts, (kept["form"] == counts["form"]) & (kept["item_id"].eqNullSafe(counts["item_id"])) & (kept["template"] == counts["template"])).drop(counts["form"]).drop(counts["item_id"]).drop(counts["template"])
    return joined.withColumn("need", F.when(F.col("form") == LITERAL, F.ceil(F.size("words") * rule.covered)).otherwise(F.least("n_windows", F.lit(rule.windows))))


def _sentences(df: DataFrame, keep: list[str], rule: Rule) -> DataFrame:
    """keep, values (words in lower case without marks) and template of each sentence of df's text that has least_words words, a number and a literal."""
    each = df.select(*keep, F.explode(F.split("text", ENDS)).alias("text")).where(F.col("text").rlike(HAS_NUMBER))
    forms = forms_of(each, keep).select(*keep, F.transform("words", lambda w: F.lower(F.replace(w, F.lit("@"), F.lit("")))).alias("values"), "template")
    return forms.where((F.size("template") >= rule.least_words) & F.array_contains("template", NUMBER) & F.exists("template", lambda w: ~_is_slot(w))).withColumn("h", F.xxhash64(F.array_join("template", " ")))


def _sentence_leaks(docs: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, row_key, c) of documents that have a sentence like that of items(item_id, values, template, h), c as _checked() makes it."""
    named = items.select("item_id", F.col("values").alias("wanted"), F.col("template").alias("form"), "h").distinct()
    met = _sentences(docs, ["doc_id", "row_key"], rule).join(_bounded(named), "h").where("template = form")
    slots = F.filter(F.zip_with(F.arrays_zip(F.col("wanted").alias("a"), F.col("values").alias("b")), "form", lambda v, k: F.when(_is_slot(k), v)), lambda v: v.isNotNull())
    literals = F.size("form") - F.size("pairs")
    first = (F.col("wanted")[0] == F.col("values")[0]) | (literals >= rule.sentence_literals)
    rows = met.withColumn("pairs", slots).where(first)
    conflicts = F.size(F.array_distinct("pairs")) - F.size(F.array_distinct(F.transform("pairs", lambda v: v["a"])))
    c = F.struct(
        F.lit(SENTENCE).alias("form"), "item_id", F.lit(1).cast("bigint").alias("matched"), F.lit(1).cast("bigint").alias("n_windows"), F.size("pairs").alias("n_slots"),
        F.size(F.filter("pairs", lambda v: v["a"] != v["b"])).alias("n_changed"), conflicts.alias("n_conflicts"),
    )
    return rows.select("doc_id", "row_key", c.alias("c")).where("c.n_conflicts = 0")


def _bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per document row and leaked item: doc_id, row_key (a hash of id and text), item_id, matched and n_windows (windows found
    and in the item), n_slots and n_changed (placeholders on the diagonal, and those whose value differs).

    Null and empty texts leak nothing; items of fewer than least_words words are not looked for. Repeated document rows give
    one row; repeated items and items with equal texts are each reported. A null doc_id or item_id is a value like
    others. Only doc_id, text and item_id are read, so other columns may have any names; ids may have any type.
    """
    spark = docs.sparkSession
    with scratch(spark) as write:
        known = write(benchmark_windows(write(benchmark_forms(benchmark.select("item_id", "text"), rule), "forms"), rule), "windows")
        lengths = [(r["form"], r["width"]) for r in known.select("form", "width").distinct().orderBy("form", "width").collect()]  # a few for each form, whatever the tables
        if not lengths:
            ids = T.StructType([docs.schema["doc_id"], T.StructField("row_key", T.LongType()), benchmark.schema["item_id"]])
            return spark.createDataFrame([], T.StructType([*ids, *(T.StructField(c, T.LongType()) for c in ("matched", "n_windows", "n_slots", "n_changed"))]))
        keys = _bounded(known.select("h", "form", "width", "item_id", "j", "n_windows", "need", F.size("words").alias("size")).distinct())
        rows = forms_of(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text"), ["doc_id", "row_key"])
        runs = []
        for form, width in lengths:
            rows, whole = with_runs(rows, ("template", "collapsed", "literal")[form], width, form)
            runs.append(whole)
        seen = rows.select("doc_id", "row_key", F.explode(F.array(*runs)).alias("_runs")).select("doc_id", "row_key", F.posexplode("_runs").alias("i", "h"))
        found = seen.join(keys, "h").select("doc_id", "row_key", "form", "width", "item_id", "n_windows", "need", "size", (F.col("i") - F.col("j")).alias("diagonal"), "j")
        d, half = F.col("diagonal"), rule.band // 2
        bands = F.when(F.col("form") == TEMPLATE, F.array(d.cast("bigint"))).otherwise(F.array(2 * F.floor(d / rule.band), 2 * F.floor((d + half) / rule.band) + 1))  # neighbours share one of two overlapping bands
        banded = found.withColumn("band", F.explode(bands)).groupBy("doc_id", "row_key", "form", "width", "item_id", "n_windows", "need", "size", "band").agg(F.array_sort(F.collect_set(F.struct("j", "diagonal"))).alias("at"))
        starts = F.array_distinct(F.transform("at", lambda a: a["j"]))
        covered = F.aggregate(F.zip_with(starts, F.slice(starts, 2, F.lit(1 << 30)), lambda a, b: F.coalesce(F.least(b - a, F.col("width")), F.col("width"))), F.lit(0), lambda acc, x: acc + x)
        lines = banded.withColumn("matched", F.size(starts).cast("bigint")).where(F.when(F.col("form") == LITERAL, covered).otherwise(F.col("matched")) >= F.col("need")).drop("need")
        # a diagonal travels without the item's words, and comes back with the document's words that it spans
        per_row = lines.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("form", "width", "item_id", "n_windows", "size", "at", "matched", F.col("band").cast("int").alias("diagonal"))).alias("lines"))
        per_row = _bounded(write(per_row.withColumnRenamed("doc_id", "_id").withColumnRenamed("row_key", "_key"), "candidates"))
        back = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").join(per_row, F.col("row_key") == F.col("_key")).where(F.col("doc_id").eqNullSafe(F.col("_id")))
        own = forms_of(back, ["doc_id", "row_key", "lines"]).withColumn("values", _collapsed_words(F.col("words"), F.col("template")))
        spans = own.select("doc_id", "row_key", F.explode(F.transform("lines", _spanned)).alias("x")).select("doc_id", "row_key", "x.*")
        items = known.select("form", "item_id", "n_windows", "words", "template").distinct()
        on_item = (spans["form"] == items["form"]) & spans["item_id"].eqNullSafe(items["item_id"]) & (spans["n_windows"] == items["n_windows"])
        wide = spans.join(_bounded(items), on_item).drop(items["form"]).drop(items["item_id"]).drop(items["n_windows"])
        checked = wide.select("doc_id", "row_key", _checked(F.struct(*(c for c in wide.columns if c not in ("doc_id", "row_key")))).alias("c"))
        fine = checked.where(F.col("c.n_conflicts") <= F.lit(rule.conflicts) * F.col("c.n_slots"))
        brief = write(_sentences(benchmark.select("item_id", "text").where(F.size(F.filter(F.split("text", ENDS), lambda t: t.rlike(r"[\p{L}\p{N}]"))) == 1), ["item_id"], rule), "brief")
        if not brief.isEmpty():
            keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
            fine = fine.union(_sentence_leaks(keyed, brief, rule))
        best = fine.groupBy("doc_id", "row_key", "c.item_id").agg(F.max(F.struct((-F.col("c.form")).alias("form"), "c.matched", "c.n_windows", "c.n_slots", (-F.col("c.n_changed")).alias("same"))).alias("b"))
        out = best.select("doc_id", "row_key", "item_id", "b.matched", F.col("b.n_windows").cast("long").alias("n_windows"), F.col("b.n_slots").cast("long").alias("n_slots"), (-F.col("b.same")).cast("long").alias("n_changed"))
        return materialise(out, "leaks")


def _spanned(x: Column) -> Column:
    """A diagonal, or band of diagonals, with the places of the document that it spans: their first one, words and placeholders."""
    own, kinds = F.when(x["form"] == TEMPLATE, F.col("words")).otherwise(F.col("values")), F.when(x["form"] == TEMPLATE, F.col("template")).otherwise(F.col("collapsed"))
    diagonals = F.transform(x["at"], lambda a: a["diagonal"])
    first = F.greatest(F.array_min(diagonals), F.lit(0))
    span = F.array_max(diagonals) + x["size"] - first
    cut = lambda words: F.slice(words, first + 1, F.greatest(span, F.lit(0)))
    return F.struct(*(x[c].alias(c) for c in ("form", "width", "item_id", "n_windows", "at", "matched", "diagonal")), first.alias("first"), cut(own).alias("own"), cut(kinds).alias("kinds"))


def _checked(x: Column) -> Column:
    """A span with its slots: how many, how many changed, and values of the item that stand for several of the document. On a
    band, a slot is compared as the matched window that holds it or the last before it says; literal windows have no slots."""
    shift = lambda j: F.when(x["form"] == TEMPLATE, x["diagonal"]).otherwise(F.coalesce(F.get(F.filter(x["at"], lambda a: (a["j"] <= j) & (j < a["j"] + x["width"])), F.lit(0)), F.try_element_at(F.filter(x["at"], lambda a: a["j"] <= j), F.lit(-1)), F.get(x["at"], F.lit(0)))["diagonal"])
    places = F.transform(F.sequence(F.lit(0), F.size(x["words"]) - 1), lambda j: F.struct(j.alias("j"), (j + shift(j) - x["first"]).alias("i")))
    aligned = F.filter(places, lambda p: _is_slot(F.get(x["template"], p["j"])) & F.coalesce((p["i"] >= 0) & (F.get(x["kinds"], F.greatest(p["i"], F.lit(0))) == F.get(x["template"], p["j"])), F.lit(False)))
    both = F.transform(aligned, lambda p: F.struct(F.split(F.lower(F.get(x["words"], p["j"])), "_").alias("a"), F.split(F.lower(F.get(x["own"], F.greatest(p["i"], F.lit(0)))), "_").alias("b")))
    # runs of as many words are compared word by word, others as a whole
    apart = lambda v: F.when(F.size(v["a"]) == F.size(v["b"]), F.zip_with(v["a"], v["b"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array(F.struct(F.array_join(v["a"], "_").alias("a"), F.array_join(v["b"], "_").alias("b"))))
    pairs = F.flatten(F.transform(both, apart))
    values = F.transform(pairs, lambda p: p["a"])
    return F.struct(
        x["form"].alias("form"), x["item_id"].alias("item_id"), x["matched"].alias("matched"), x["n_windows"].alias("n_windows"), F.size(pairs).alias("n_slots"),
        F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).alias("n_changed"),
        (F.size(F.array_distinct(pairs)) - F.size(F.array_distinct(values))).alias("n_conflicts"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of docs, with their columns, that leak no item."""
    key = free_name("_leak_key", docs)
    found = _bounded(materialise(leaks(docs, benchmark, rule).select(F.col("row_key").alias(key)).distinct(), "leaks"))
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(key), "left_anti")
