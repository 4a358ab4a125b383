"""Project index: what each file defines and imports, import edges, weights, context packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.predicates import both, either, has, isin, match, starts
from sievework.functions.skew import budget_prefix
from sievework.functions.text import (
    dialect,
    join_path,
    line_count,
    normal_path,
    parent_dir,
    path_parts,
)
from sievework.schema import FILE, union_all
from sievework.sources.files import config_files, index_files, pack_files
from sievework.operators.packs import PACK_EXTS

# Patterns of the index, candidate files of an import, text limits.
PY_IMPORT = r"^(?:from\s+(\S+)\s+import|import\s+(\S+))"
JS_IMPORT = r"""(?:import|require)\s*(?:\(?\s*['"]([^'"]+)['"]|.*?from\s+['"]([^'"]+)['"])"""
PY_FUNCTION = r"^(?:async\s+)?def\s+(\w+)"
JS_FUNCTION = r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)\s*=>|function))"
PY_CLASS = r"^class\s+(\w+)"
JS_CLASS = r"class\s+(\w+)"
PY_STATE = r"^[a-z_]\w*\s*=\s*(?:\{|\[|dict\(|set\(|collections\.)"
JS_STATE = r"^(?:let|var)\s+\w+\s*=\s*(?:new\s+Map|new\s+Set|\{|\[)"
PY_STATE_SKIP = ["#", "import ", "from ", "def ", "class ", "@"]
JS_STATE_SKIP = ["//", "/*", "*", "import ", "export "]
IMPORT_TARGETS = [
    ".py", "/__init__.py", ".ts", ".js", ".tsx", ".jsx", "/index.ts", "/index.js",
]
SUMMARY_CHARS = 50_000
PACK_CHARS = 100_000
PACK_CONFIG_CHARS = 2_000
PACK_FILES = 30

SCRIPTS = ["javascript", "typescript"]


def _extract(pattern: str, groups: int, multiline: bool) -> Column:
    rx = F.lit(dialect(pattern, multiline=multiline))
    first = F.regexp_extract_all("content", rx, 1)
    if groups == 1:
        return first
    return F.zip_with(
        first, F.regexp_extract_all("content", rx, 2), lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    )


def _by_language(python: Column, script: Column) -> Column:
    return (
        F.when(F.col("language") == "python", python)
        .when(F.col("language").isin(*SCRIPTS), script)
        .otherwise(F.array().cast("array<string>"))
    )


def state_line(line: str) -> str:
    """Module-level assignment of something mutable (SQL over ``line`` and language)."""
    s = f"regexp_replace({line}, '(?U)^\\\\s+|\\\\s+$', '')"
    py = both(
        "language = 'python'", has(line, "="), f"NOT {starts(line, ' ', chr(9))}",
        f"NOT {starts(s, *PY_STATE_SKIP)}", match(s, PY_STATE),
    )
    js = both(
        isin("language", SCRIPTS), has(line, "let", "var"), f"NOT {starts(s, *JS_STATE_SKIP)}", match(s, JS_STATE)
    )
    return either([py, js])


def global_state_lines() -> Column:
    return F.expr(
        f"array_compact(transform(split(content, '\\n', -1), (l, i) -> CASE WHEN {state_line('l')} THEN i + 1 END))"
    )


def file_index(files: DataFrame) -> DataFrame:
    """One row per indexed file; everything is read off its own content, nothing is shuffled."""
    imports = _by_language(_extract(PY_IMPORT, 2, True), _extract(JS_IMPORT, 2, False))
    functions = _by_language(_extract(PY_FUNCTION, 1, True), _extract(JS_FUNCTION, 2, False))
    classes = _by_language(_extract(PY_CLASS, 1, True), _extract(JS_CLASS, 1, False))
    rows = index_files(files).select(
        *FILE, "language", "size_bytes", line_count(F.col("content")).alias("line_count"),
        imports.alias("imports"), functions.alias("functions"), classes.alias("classes"),
        global_state_lines().alias("global_state_lines"),
    )
    return rows.withColumn("has_global_state", F.size("global_state_lines") > 0)


def import_edges(index: DataFrame, files: DataFrame) -> DataFrame:
    """(project, src_path, dst_path): one row per resolvable import, in file order of candidates.

    Each distinct (directory, import) is resolved once: a module imported by very many files
    is one row in the join with the file list.
    """
    imports = index.select(
        "project", F.col("path").alias("src_path"), parent_dir(F.col("path")).alias("dir"),
        F.explode("imports").alias("imp"),
    ).where((F.col("imp").startswith(".") | F.col("imp").contains("/")) & ~F.col("imp").startswith("/"))
    targets = F.array(
        *[normal_path(join_path(F.col("dir"), F.concat("imp", F.lit(t)))) for t in IMPORT_TARGETS]
    )
    wanted = (
        imports.select("project", "dir", "imp").distinct()
        .select("project", "dir", "imp", F.posexplode(targets).alias("rank", "path"))
        .where(F.col("path").isNotNull())
    )
    found = (
        wanted.join(files.select(*FILE), FILE)
        .groupBy("project", "dir", "imp")
        .agg(F.min_by("path", "rank").alias("dst_path"))
    )
    return imports.join(found, ["project", "dir", "imp"]).select("project", "src_path", "dst_path")


def file_weights(index: DataFrame, edges: DataFrame) -> DataFrame:
    """(project, path, …, in_degree, score): ten points per import of a file plus its lines."""
    degree = edges.groupBy("project", F.col("dst_path").alias("path")).agg(
        F.count(F.lit(1)).alias("in_degree")
    )
    return (
        index.join(degree, FILE, "left")
        .withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
        .withColumn("score", F.col("in_degree") * 10 + F.col("line_count"))
    )


def top_files(index: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` heaviest files per project; the rank filter limits groups before the shuffle."""
    slim = index.select(*FILE, "line_count")
    w = Window.partitionBy("project").orderBy(F.col("score").desc(), path_parts(F.col("path")))
    return (
        file_weights(slim, edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    )


def project_totals(index: DataFrame) -> DataFrame:
    return index.groupBy("project").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("line_count").alias("total_lines"),
        F.sort_array(F.collect_set("language")).alias("languages"),
        F.count_if("has_global_state").alias("state_files"),
    )


def _state_paths(index: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("project").orderBy(path_parts(F.col("path")))
    first = (
        index.where("has_global_state").select(*FILE)
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    )
    return first.groupBy("project").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("state_paths")
    )


def _or(col: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))


def _facts(index: DataFrame, context: DataFrame) -> DataFrame:
    flags = ["is_web_app", "is_cli", "is_api", "is_serverless", "has_orm", "has_template_escaping"]
    dims = context.select("project", "deployment", "frameworks", *flags)
    rows = project_totals(index).join(dims, "project", "left").join(_state_paths(index), "project", "left")
    rows = rows.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
    return rows.withColumns(
        {
            "frameworks": F.array_join("frameworks", ", "),
            "languages": F.array_join("languages", ", "),
        }
    )


def _py_bool(col: str) -> Column:
    return F.initcap(F.col(col).cast("string"))


def architecture_summary(index: DataFrame, context: DataFrame) -> DataFrame:
    """(project, summary): a few lines of plain text per project."""
    kind = F.when(F.col("is_web_app"), "web app").when(F.col("is_cli"), "CLI").otherwise("library")
    state = F.when(
        F.col("state_paths").isNotNull(),
        F.concat(F.lit("Files with global state: "), F.array_join("state_paths", ", ")),
    )
    lines = [
        F.concat(F.lit("Project: "), "project"),
        F.concat(F.lit("Type: "), kind),
        F.concat(F.lit("Deployment: "), _or("deployment", "unknown")),
        F.concat(F.lit("Frameworks: "), _or("frameworks", "none")),
        F.concat(F.lit("Languages: "), "languages"),
        F.concat(F.lit("Files: "), "total_files", F.lit(", Lines: "), "total_lines"),
        F.concat(F.lit("Serverless: "), _py_bool("is_serverless")),
        state,
    ]
    return _facts(index, context).select("project", F.concat_ws("\n", *lines).alias("summary"))


def _chunk(path: Column, content: Column, lead: str = "") -> Column:
    return F.concat(F.lit(f"{lead}--- "), path, F.lit(" ---\n"), content, F.lit("\n"))


def directory_summary(files: DataFrame, max_chars: int = SUMMARY_CHARS) -> DataFrame:
    """(project, path, running, chunk): the files, in path order, that fit the budget.

    The prefix is found on paths and lengths; content is joined for the few files in it.
    A chunk has at least eleven characters, so a project keeps a bounded number of rows.
    """
    code = pack_files(files).where(F.col("ext").isin(*PACK_EXTS))
    sizes = code.select(*FILE, (F.length("path") + F.length("content") + 11).alias("chars"))
    prefix = budget_prefix(sizes, ["project"], [path_parts(F.col("path"))], "chars", max_chars)
    return (
        code.select(*FILE, "content")
        .join(prefix, FILE)
        .select(*FILE, "running", _chunk(F.col("path"), F.col("content"), "\n").alias("chunk"))
    )


def context_pack(
    files: DataFrame, index: DataFrame, edges: DataFrame, context: DataFrame, max_chars: int = PACK_CHARS
) -> DataFrame:
    """(project, section, name, pos, text): overview, configs, file tree, heaviest files.

    ``index`` is read by several branches and should be a stored table.  Rows, not one string: the tree has a line per file, so a pack can be larger than a row
    should be.  The heaviest files stop at the first that would pass ``max_chars``.
    """
    p = FILE
    head_lines = [
        F.concat(F.lit("PROJECT: "), "project"),
        F.concat(F.lit("Files: "), "total_files", F.lit(", Lines: "), "total_lines"),
        F.concat(F.lit("Languages: "), "languages"),
        F.concat(F.lit("Deployment: "), _or("deployment", "unknown")),
        F.concat(F.lit("Frameworks: "), _or("frameworks", "none detected")),
        F.concat(F.lit("Serverless: "), _py_bool("is_serverless")),
        F.concat(F.lit("Web app: "), _py_bool("is_web_app"), F.lit(", API: "), _py_bool("is_api"), F.lit(", CLI: "), _py_bool("is_cli")),
        F.concat(F.lit("ORM: "), _py_bool("has_orm"), F.lit(", Template escaping: "), _py_bool("has_template_escaping")),
    ]
    head = _facts(index, context).select(
        "project", F.lit(0).alias("section"), F.lit("").alias("name"), F.lit(0).alias("pos"),
        F.array_join(F.array(*head_lines, F.lit("")), "\n").alias("text"),
    )
    configs = config_files(files).select(
        "project", F.lit(1).alias("section"), "name", F.lit(0).alias("pos"),
        F.concat(F.lit("--- CONFIG: "), "name", F.lit(" ---\n"), F.substring("content", 1, PACK_CONFIG_CHARS), F.lit("\n")).alias("text"),
    )
    marks = F.array_compact(
        F.array(
            F.when(F.col("has_global_state"), "GLOBAL_STATE"),
            F.when(F.size("classes") > 0, F.concat(F.lit("classes:"), F.array_join(F.slice("classes", 1, 3), ","))),
            F.when(F.size("functions") > 0, F.concat(F.lit("fns:"), F.size("functions").cast("string"))),
        )
    )
    marked = F.when(F.size(marks) > 0, F.concat(F.lit(" ["), F.array_join(marks, ", "), F.lit("]"))).otherwise("")
    tree = index.select(
        "project", F.lit(2).alias("section"), F.col("path").alias("name"), F.lit(0).alias("pos"),
        F.concat(F.lit("  "), "path", F.lit(" ("), "line_count", F.lit("L)"), marked).alias("text"),
    )
    fixed = union_all([head, configs, tree])
    # pieces are counted without the line breaks between them (eight in the overview); the
    # heading of the tree counts too
    chars = F.length("text") - F.when(F.col("section") == 0, 8).otherwise(0)
    used = fixed.groupBy("project").agg((F.sum(chars) + len("--- FILE TREE ---")).alias("used"))
    top = (
        top_files(index, edges, PACK_FILES)
        .join(files.select(*p, F.length("content").alias("chars")), p)
        .withColumn("chars", F.length("path") + F.col("chars") + 10)
        .join(used, "project")
    )
    w = Window.partitionBy("project").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fits = top.withColumn("running", F.col("used") + F.sum("chars").over(w)).where(F.col("running") <= max_chars)
    bodies = fits.select(*p, "rank").join(files.select(*p, "content"), p).select(
        "project", F.lit(3).alias("section"), F.col("path").alias("name"), F.col("rank").alias("pos"),
        _chunk(F.col("path"), F.col("content")).alias("text"),
    )
    return fixed.unionByName(bodies)


