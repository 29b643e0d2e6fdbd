"""Imports: which files nothing imports, which declared packages nothing uses, which files import each other in a circle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrain.functions.tables import merged
from lodegrain.functions.text import basename, dirname, lines_of, normal_path
from lodegrain.operators.graph import cycles
from lodegrain.operators.within import within

JS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Endings tried in turn for an import, for unused files and for circles.
FILE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", ".py", ".rb", ".go", ".rs")
CYCLE_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: Files that need no importer, and packages that need no import.
ENTRY_STEMS = ("index", "main", "app", "server", "start", "run", "entry", "bootstrap", "init", "setup", "program", "manage", "wsgi", "asgi")
EXEMPT_STEM = r"(?:\.(?:test|spec|e2e|stories|story)\z|_test\z|^test_|^__)"
EXEMPT_FOLDER = r"^(?:src/)?(?:app|pages)/"
TOOL_STEM = r"^(?:babel|jest|webpack|vite|rollup|eslint|prettier|postcss|tailwind|next|nuxt|svelte)\.(?:config|setup)"
SKIPPED_PACKAGES = r"^(?:@types/.*|typescript|ts-node|nodemon|concurrently)\z"
SOURCE_EXTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java", ".rb", ".rs", ".php", ".cs")


def _all(text: Column, *patterns: str) -> Column:
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))


def js_imports(files: DataFrame, bare: bool) -> DataFrame:
    """(path, spec): module names in JS-like files; bare adds imports for side effects and leaves out dynamic ones."""
    quoted = r"\s*['\"]([^'\"]+)['\"]"
    patterns = [r"from" + quoted, r"require\s*\(" + quoted + r"\s*\)", *([r"(?m)^\s*import" + quoted] if bare else [r"import\s*\(" + quoted + r"\s*\)"])]
    return files.where(F.col("ext").isin(list(JS)) & F.col("content").isNotNull()).select("path", F.explode(_all(F.col("content"), *patterns)).alias("spec")).distinct()


def _first_existing(tried: DataFrame, paths: DataFrame) -> DataFrame:
    """tried(path, spec, ord, target) to (path, spec, target): the first target by ord that is among paths(path)."""
    there = merged(tried, paths.select(F.col("path").alias("target")).distinct(), "target")
    return there.groupBy("path", "spec").agg(F.min_by("target", "ord").alias("target"))


def resolve(imports: DataFrame, paths: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """imports(path, spec) to (path, spec, target): the first of the candidates in order that is among paths(path). Relative names only."""
    base = normal_path(F.concat_ws("/", dirname(F.col("path")), F.col("spec")))
    tried = F.array(*(F.struct(F.lit(i).alias("ord"), F.concat(base, F.lit(e)).alias("target")) for i, e in enumerate(endings)))
    return _first_existing(imports.where(F.col("spec").startswith(".")).select("path", "spec", F.explode(tried).alias("c")).select("path", "spec", "c.*"), paths)


def path_aliases(files: DataFrame) -> DataFrame:
    """(alias, targets, ord) of the path settings of the root's tsconfig.json, tsconfig.base.json and jsconfig.json. A later file's alias has the place of an earlier one's; files that are no strict JSON have none."""
    names = ("tsconfig.json", "tsconfig.base.json", "jsconfig.json")
    kind = "compilerOptions STRUCT<baseUrl: STRING, paths: MAP<STRING, ARRAY<STRING>>>"
    read = files.where(F.col("path").isin(list(names)) & F.col("content").isNotNull()).select(F.array_position(F.array(*map(F.lit, names)), F.col("path")).alias("_f"), F.from_json("content", kind)["compilerOptions"].alias("_o"))
    each = read.where("_o.paths is not null").select("_f", F.coalesce("_o.baseUrl", F.lit(".")).alias("_base"), F.posexplode(F.map_entries("_o.paths")).alias("_i", "_e"))
    plain = lambda x: F.regexp_replace(x, r"/\*\z", "")
    targets = F.transform("_e.value", lambda t: normal_path(F.concat_ws("/", F.col("_base"), plain(t))))
    rows = each.select(plain(F.col("_e.key")).alias("alias"), targets.alias("targets"), F.struct("_f", "_i").alias("_at"))
    return rows.groupBy("alias").agg(F.max_by("targets", "_at").alias("targets"), F.min("_at").alias("ord"))


def resolve_aliases(imports: DataFrame, aliases: DataFrame, paths: DataFrame, endings: tuple[str, ...]) -> DataFrame:
    """imports(path, spec) whose name is an alias or below one, with target: null where no candidate exists. Each beginning of a name up to a slash meets the aliases by equality; the first alias counts."""
    parts = F.split("spec", "/")
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    met = imports.select("path", "spec", F.explode(starts).alias("alias")).join(F.broadcast(aliases), "alias").groupBy("path", "spec").agg(F.min_by(F.struct("alias", "targets"), "ord").alias("a"))
    rest = F.expr("substring(spec, length(a.alias) + 2)")
    base = lambda t: F.when(rest == "", t).otherwise(F.concat_ws("/", t, rest))
    tried = F.flatten(F.transform("a.targets", lambda t, k: F.array(*(F.struct(k.alias("k"), F.lit(i).alias("i"), F.concat(normal_path(base(t)), F.lit(e)).alias("target")) for i, e in enumerate(endings)))))
    wide = met.select("path", "spec", F.explode(tried).alias("c")).select("path", "spec", F.struct("c.k", "c.i").alias("ord"), "c.target")
    return merged(met.select("path", "spec"), _first_existing(wide, paths), ["path", "spec"], "left")


def package_entries(files: DataFrame) -> DataFrame:
    """(path): what the root's package.json names in main, module, exports and bin, as it is and with the endings .ts, .tsx and .js."""
    root = files.where("path = 'package.json' and content is not null")
    named = F.array().cast("array<string>")
    for key in ("main", "module", "exports", "bin"):
        value = F.get_json_object("content", f"$.{key}")
        inner = F.regexp_extract_all(value, F.lit(r'[:\[,]\s*"([^"\\]+\.[jt]sx?)"(?!\s*:)'), F.lit(1))
        own = F.when(value.rlike(r"^\s*[\[{]"), inner).when(value.rlike(r"\.[jt]sx?\z"), F.array(value))
        named = F.concat(named, F.coalesce(own, F.array().cast("array<string>")))
    base = root.select(F.explode(F.transform(named, normal_path)).alias("p"))
    return base.select(F.explode(F.array(F.col("p"), *(F.regexp_replace("p", r"\.[jt]sx?\z", e) for e in (".ts", ".tsx", ".js")))).alias("path")).distinct()


def unused_files(files: DataFrame) -> DataFrame:
    """(path, size), the largest first: source files that no import reaches, without entry points, tests, tool configurations, pages and files that only re-export.

    Imports are relative or by the root's path aliases, which go before; the package's entry points are reached. Folders count as import targets, so a folder hides a file of the same
    stem. Languages whose imports are not paths have none.
    """
    source = files.where(F.col("ext").isin(list(SOURCE_EXTS)) & ~F.col("path").endswith(".d.ts"))
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("path")).distinct()
    asked = js_imports(source, bare=False)
    aliased = resolve_aliases(asked, path_aliases(files), folders, FILE_ENDINGS)
    plain = resolve(merged(asked, aliased, ["path", "spec"], "left_anti"), folders, FILE_ENDINGS)
    used = aliased.where("target is not null").select(F.col("target").alias("path")).union(plain.select("target")).union(package_entries(files)).distinct()
    code = F.filter(F.split("content", "\n"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*//"))
    barrel = (F.size(code) > 0) & F.forall(code, lambda x: x.rlike(r"^\s*export\s*(?:\*|\{)"))
    stem = F.lower(F.regexp_replace(basename(F.col("path")), r"\.[^.]*\z", ""))
    left = source.where(~stem.isin(list(ENTRY_STEMS)) & ~stem.rlike(EXEMPT_STEM) & ~F.col("path").rlike(EXEMPT_FOLDER) & ~stem.rlike(TOOL_STEM) & ~F.coalesce(barrel, F.lit(False)))
    return merged(left, used, "path", "left_anti").select("path", "size").orderBy(F.desc("size"), "path")


def import_cycles(files: DataFrame) -> DataFrame:
    """(cycle, path, length): the files of each circle of imports, the largest first, in JS-like files and by relative Python imports and Python imports from the root. A circle is named by its least path."""
    js = resolve(js_imports(files, bare=True), files, CYCLE_ENDINGS).select(F.col("path").alias("src"), F.col("target").alias("dst"))
    some = files.where((F.col("ext") == ".py") & F.col("content").isNotNull())
    near = some.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"from\s+(\.+[\w.]*)\s+import"), F.lit(1))).alias("spec"))
    dots = F.length(F.regexp_extract("spec", r"^(\.+)", 1))
    rest = F.replace(F.regexp_replace("spec", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = normal_path(F.concat_ws("/", dirname(F.col("path")), F.repeat(F.lit("../"), dots - 1), rest))
    far = some.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^import\s+([A-Za-z_][\w.]*)"), F.lit(1))).alias("spec"))
    both = near.select("path", "spec", base.alias("_base")).union(far.select("path", "spec", F.replace("spec", F.lit("."), F.lit("/"))))
    tried = both.select("path", "spec", F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.concat("_base", F.lit(".py")).alias("target")), F.struct(F.lit(1).alias("ord"), F.concat("_base", F.lit("/__init__.py")).alias("target")))).alias("c")).select("path", "spec", "c.*")
    found = _first_existing(tried, files).select(F.col("path").alias("src"), F.col("target").alias("dst"))
    return cycles(js.union(found)).select(F.col("component").alias("cycle"), F.col("node").alias("path"), "length").orderBy(F.desc("length"), "cycle", "path")


def manifests(files: DataFrame) -> DataFrame:
    """(manager, declared_in, name, version) of the manifests at the root: package.json, requirements.txt, go.mod, Cargo.toml. Of repeated names the last counts, a development dependency before others."""
    root = files.where(~F.contains("path", F.lit("/")) & F.col("content").isNotNull())
    none = F.create_map().cast("map<string,string>")
    deps, dev = F.coalesce("j.dependencies", none), F.coalesce("j.devDependencies", none)
    both = F.map_concat(F.map_filter(deps, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    npm = root.where("path = 'package.json'").select("path", F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>").alias("j")).select("path", F.explode(both)).select(F.lit("npm").alias("manager"), "path", F.col("key").alias("name"), F.col("value").alias("version"), F.lit(0).alias("ord"))
    lines = lines_of(root)
    clean = F.trim(F.regexp_replace("text", "#.*", ""))
    pip = lines.where("path = 'requirements.txt'").select(F.lit("pip").alias("manager"), "path", F.lower(F.regexp_extract(clean, r"^([A-Za-z0-9_.-]+)", 1)).alias("name"), clean.alias("version"), "line").where("name <> ''")
    go = root.where("path = 'go.mod'")
    block = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"require\s*\(([^)]*)\)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^\s*(\S+\s+\S+)"), F.lit(1))))
    single = F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(r"require\s+(\S+)\s+\S+"), F.lit(1)).alias("a"), F.regexp_extract_all("content", F.lit(r"require\s+\S+\s+(\S+)"), F.lit(1)).alias("b")), lambda x: F.concat(x["a"], F.lit(" "), x["b"]))
    gomod = go.select("path", F.posexplode(F.concat(block, single)).alias("ord", "x")).select(F.lit("go").alias("manager"), "path", F.regexp_extract("x", r"^(\S+)", 1).alias("name"), F.regexp_extract("x", r"\s(\S+)\z", 1).alias("version"), "ord")
    section = F.last(F.nullif(F.regexp_extract("text", r"^\s*\[([^\]]+)\]", 1), F.lit("")), ignorenulls=True).over(Window.partitionBy("path").orderBy("line"))
    cargo = lines.where("path = 'Cargo.toml'").withColumn("_s", section).where(F.col("_s").isin("dependencies", "dev-dependencies")).select(F.lit("cargo").alias("manager"), "path", F.regexp_extract("text", r"^\s*([A-Za-z0-9_-]+)\s*=", 1).alias("name"), F.trim(F.regexp_extract("text", r"=\s*(.*)\z", 1)).alias("version"), "line").where("name <> ''")
    last = npm.union(pip).union(gomod).union(cargo).groupBy("manager", "name").agg(F.max_by(F.struct(F.col("path").alias("declared_in"), "version"), "ord").alias("d"))
    return last.select("manager", "d.declared_in", "name", "d.version")


def package_imports(files: DataFrame) -> DataFrame:
    """(manager, name): what source files import from packages."""
    content = F.col("content")
    some = files.where(content.isNotNull())
    npm = some.where(F.col("ext").isin(".ts", ".tsx", ".js", ".jsx", ".mjs")).select(F.explode(_all(content, r"from\s+['\"]([^.'\"][^'\"]*)['\"]", r"require\s*\(\s*['\"]([^.'\"][^'\"]*)['\"]\s*\)", r"import\s*\(\s*['\"]([^.'\"][^'\"]*)['\"]\s*\)")).alias("s")).select(F.lit("npm").alias("manager"), F.when(F.col("s").startswith("@"), F.substring_index("s", "/", 2)).otherwise(F.substring_index("s", "/", 1)).alias("name"))
    pip = some.where("ext = '.py'").select(F.explode(_all(content, r"(?m)^import\s+([a-zA-Z0-9_]+)", r"(?m)^from\s+([a-zA-Z0-9_]+)")).alias("s")).select(F.lit("pip").alias("manager"), F.lower("s").alias("name"))
    blocks = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"import\s*\(([^)]*)\)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit('(?m)^[^"\n]*"([^"]+)"'), F.lit(1))))
    go = some.where("ext = '.go'").select(F.explode(F.concat(blocks, _all(content, r'(?m)^import\s+"([^"]+)"'))).alias("name")).select(F.lit("go").alias("manager"), "name")
    rust = some.where("ext = '.rs'").select(F.explode(_all(content, r"(?m)^(?:use|extern\s+crate)\s+([a-zA-Z0-9_]+)")).alias("name")).select(F.lit("cargo").alias("manager"), "name")
    return npm.union(pip).union(go).union(rust).distinct()


def unused(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Rows of declared(manager, name, ...) that no row of used(manager, name) of the same manager serves: equal, a path below it, or part of its name.

    Used names meet declared ones by equality with each of their beginnings up to a slash; parts of names are looked up by their pieces."""
    names = declared.select(F.col("manager").alias("_m"), F.col("name").alias("_n")).where("_m is not null and _n is not null").distinct()
    u = used.select(F.col("manager").alias("_m"), F.col("name").alias("_u")).where("_m is not null and _u is not null").distinct()
    parts = F.split("_u", "/")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    served = u.select("_m", F.explode(begins).alias("_n")).distinct().union(within(u, names, "_u", "_n", "_m").select("_m", "_n").distinct())
    return declared.join(served, (F.col("manager") == F.col("_m")) & (F.col("name") == F.col("_n")), "left_anti")


def unused_packages(files: DataFrame) -> DataFrame:
    """Declared packages that nothing imports, without type stubs and tools."""
    return unused(manifests(files).where(~F.col("name").rlike(SKIPPED_PACKAGES)), package_imports(files))
