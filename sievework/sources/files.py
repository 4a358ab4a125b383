"""File tables: reading source trees, filters, incremental and changed-file selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions.text import (
    contains_any,
    file_name,
    glob_match,
    has_part,
    line_count,
    path_parts,
    stem,
    suffix,
)
from sievework.schema import FILE

# Extensions and their languages.
EXT_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
}
INDEX_EXTS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java")

# Directories never scanned, and name parts of bundled scripts.
IGNORE_DIRS = [
    "node_modules", "__pycache__", ".venv", "venv", ".git",
    ".vercel", ".next", ".nuxt", ".output",
    "dist", "build", "out", ".cache",
    "vendor", "third_party", "third-party", "browser-profile",
    ".tox", ".mypy_cache", ".ruff_cache", ".pytest_cache",
    "coverage", ".nyc_output",
    "eggs",
]
INDEX_SKIP_DIRS = [
    "node_modules", "__pycache__", ".venv", "venv", ".git", ".vercel", ".next",
    ".nuxt", "dist", "build", "out", ".cache", "coverage", ".nyc_output",
    "browser-profile", "vendor", "third_party", ".tox", ".mypy_cache",
]
PACK_SKIP_DIRS = ["node_modules", "__pycache__", "venv", ".venv", "dist", "build"]
BUNDLE_EXTS = (".js", ".cjs", ".mjs")
BUNDLE_MARKS = [".min", "-min", "bundle", "vendor", "chunk", "core"]

# Root files that describe a project, and their readme names in order.
CONFIG_NAMES = [
    "package.json", "tsconfig.json", "vercel.json", "netlify.toml",
    "railway.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    "serverless.yml", "serverless.yaml", ".env.example",
    "requirements.txt", "pyproject.toml", "Pipfile",
    "next.config.js", "next.config.mjs", "vite.config.ts", "webpack.config.js",
    "Procfile",
]
README_NAMES = ["README.md", "readme.md", "README.txt", "README"]
MANIFEST_CHARS = 5000
DEPENDENCY_KEYS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]


# Text files the checks look at beside source files, and the size up to which a file is read.
TEXT_EXTS = [".html", ".htm", ".css", ".scss", ".vue", ".svelte", ".json", ".toml", ".yml", ".yaml", ".md", ".txt"]
MAX_BYTES = 10_000_000


def path_reason(path: Column, size: Column, ignore: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is left out, as far as its path and size tell: ignored, unsupported or oversize; null if it is read."""
    known = suffix(path).isin(*EXT_LANGUAGE, *TEXT_EXTS) | file_name(path).isin(*CONFIG_NAMES, *README_NAMES)
    return F.when(ignored(path, ignore), "ignored").when(~known, "unsupported").when(size > max_bytes, "oversize")


def content_reason(path: Column, raw: Column) -> Column:
    """Why a file is left out once its bytes are there: undecodable or minified; null if it is scanned."""
    text = raw.cast("string")
    return F.when(~F.is_valid_utf8(text), "undecodable").when(suffix(path).isin(*EXT_LANGUAGE) & minified(line_ends(text)), "minified")


def line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def judged(raw: DataFrame, ignore: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """``raw`` (project, path, size_bytes, content as bytes) with the ``reason`` why a file is left out, or null.

    A file without content is empty; one without path or size is judged by what it has.
    """
    early = path_reason(F.col("path"), F.col("size_bytes"), ignore, max_bytes)
    return raw.withColumn("reason", F.coalesce(early, content_reason(F.col("path"), F.coalesce("content", F.lit(b"")))))


def rejected(judged_files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(project, path, size_bytes, reason) of the files left out, those that do not parse (``facts``) included."""
    out = judged_files.where("reason IS NOT NULL").select(*FILE, "size_bytes", "reason")
    if facts is None:
        return out
    broken = facts.where("kind = 'unparsed'").select(*FILE).distinct()
    seen = judged_files.where("reason IS NULL").select(*FILE, "size_bytes")
    return out.unionByName(seen.join(broken, FILE, "left_semi").withColumn("reason", F.lit("unparsed")))


def reject_counts(ledger: DataFrame) -> DataFrame:
    """Files and bytes left out, by project and reason."""
    return ledger.groupBy("project", "reason").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def _binary(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def _placed(found: DataFrame, root: str, *keep: Column) -> DataFrame:
    rel = _below(F.col("path"), root.rstrip("/") + "/")
    return found.select(
        F.substring_index(rel, "/", 1).alias("project"), F.regexp_replace(rel, r"^[^/]*/", "").alias("path"),
        F.col("length").alias("size_bytes"), *keep,
    )


def _read_judged(spark: SparkSession, root: str, ignore: Iterable[str], max_bytes: int) -> DataFrame:
    """Files whose path and size pass, with their bytes and the ``reason`` that these give.

    The first test is one on file metadata, so Spark leaves the other files out when it plans the read.
    """
    base = root.rstrip("/") + "/"
    uri = F.try_url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inside = F.regexp_replace(_below(uri, base), r"^[^/]*/", "")
    some = _binary(spark, root).where(path_reason(inside, F.col("_metadata.file_size"), ignore, max_bytes).isNull())
    placed = _placed(some, root, F.col("content"))
    return placed.withColumn("reason", content_reason(F.col("path"), F.col("content")))


def read_tree(spark: SparkSession, root: str, ignore: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """The files below ``root`` that the checks look at, one row each; the first directory level is the project.

    Files in ignored directories, of other kinds and above ``max_bytes`` are not read at all.  Of those read, bytes that
    are not UTF-8 text are left out; ``read_rejects`` tells which and why.  Line ends become '\\n' and the
    md5 is that of the normalised text.  The file listing and reading are Spark's own, which pass over empty files.
    """
    kept = _read_judged(spark, root, ignore, max_bytes).where("reason IS NULL OR reason = 'minified'")
    return file_table(kept.select("project", "path", line_ends(F.col("content").cast("string")).alias("content")))


def read_rejects(spark: SparkSession, root: str, ignore: Iterable[str] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """(project, path, size_bytes, reason) of every file below ``root`` that ``read_tree`` leaves out or that is minified.

    What the path and size tell comes from the listing alone; only the files ``read_tree`` reads are read here.
    """
    listed = read_assets(spark, root).withColumn("reason", path_reason(F.col("path"), F.col("size_bytes"), ignore, max_bytes))
    return rejected(listed).unionByName(rejected(_read_judged(spark, root, ignore, max_bytes)))


def _below(uri: Column, base: str) -> Column:
    return F.substring(uri, F.instr(uri, base) + len(base), F.length(uri))


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """(project, path, size_bytes) below ``root``; file bytes are never read."""
    return _placed(_binary(spark, root), root)


def language_of(ext: Column) -> Column:
    pairs = [F.lit(x) for kv in EXT_LANGUAGE.items() for x in kv]
    return F.element_at(F.create_map(*pairs), ext)


def file_table(df: DataFrame) -> DataFrame:
    """Add ext, language, size_bytes and md5 to (project, path, content)."""
    return (
        df.withColumn("ext", suffix(F.col("path")))
        .withColumn("language", language_of(F.col("ext")))
        .withColumn("size_bytes", F.octet_length("content").cast("long"))
        .withColumn("md5", F.md5("content"))
    )


def ignored(path: Column, ignore: Iterable[str] = ()) -> Column:
    """In an ignored directory, a bundled script, or matched by a user pattern."""
    parts = path_parts(path)
    bundle = suffix(path).isin(*BUNDLE_EXTS) & contains_any(F.lower(stem(path)), BUNDLE_MARKS)
    test = (
        has_part(path, IGNORE_DIRS)
        | F.exists(parts, lambda p: p.endswith(".egg-info"))
        | bundle
    )
    for pattern in ignore:
        test = test | glob_match(path, pattern)
        if "/" in pattern:
            test = test | path.contains(pattern.rstrip("/"))
    return test


def minified(content: Column) -> Column:
    """Fewer than 50 lines of more than 500 characters on average."""
    n = line_count(content)
    return (F.length(content) / n > 500) & (n < 50)


def is_source(ignore: Iterable[str] = ()) -> Column:
    return (
        F.col("ext").isin(*EXT_LANGUAGE)
        & ~ignored(F.col("path"), ignore)
        & ~minified(F.col("content"))
    )


def source_files(files: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Files a code scan looks at."""
    return files.where(is_source(ignore))


def index_files(files: DataFrame) -> DataFrame:
    """Files the project index looks at."""
    return files.where(
        F.col("ext").isin(*INDEX_EXTS)
        & ~has_part(F.col("path"), INDEX_SKIP_DIRS)
        & ~minified(F.col("content"))
    )


def is_pack_file(path: Column) -> Column:
    hidden = F.exists(path_parts(path), lambda p: p.startswith("."))
    return ~hidden & ~has_part(path, PACK_SKIP_DIRS)


def pack_files(files: DataFrame) -> DataFrame:
    """Files the rule packs look at: no hidden and no build directories."""
    return files.where(is_pack_file(F.col("path")))


def unchanged(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose md5 equals the stored one."""
    return files.join(state.select(*FILE, "md5"), [*FILE, "md5"], "left_semi")


def changed_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that are new or differ from ``state`` (project, path, md5).

    ``state`` holds the latest md5 per path, so a file that goes back to an older text is
    scanned again.  The comparison reads keys and hashes only; content is joined for what
    changed.  Both joins are on (project, path), the bucketing of a stored file table.
    """
    old = state.select(*FILE, F.col("md5").alias("old_md5"))
    keys = files.select(*FILE, "md5").join(old, FILE, "left").where(~F.col("md5").eqNullSafe(F.col("old_md5")))
    return files.join(keys.select(*FILE), FILE, "left_semi")


def marked_since(files: DataFrame, state: DataFrame) -> DataFrame:
    """All ``files`` with ``changed``, which is true for those that ``changed_since`` gives; the others come without content.

    Content is read once and meets ``state`` where it is; without a state it does not move.
    """
    named = F.col("project").isNotNull() & F.col("path").isNotNull()
    kept = F.when(F.col("changed"), F.col("content"))
    if state.isEmpty():
        return files.withColumn("changed", named & F.col("md5").isNotNull()).withColumn("content", kept)
    known = state.groupBy(*FILE).agg(
        F.count("*").alias("_all"), F.count("md5").alias("_texts"), F.min("md5").alias("_least"), F.max("md5").alias("_most")
    )
    # like every text the state has for the path; a path it does not have is like no text
    same = F.when(F.col("md5").isNull(), F.coalesce("_texts", F.lit(0)) == 0).otherwise(
        F.coalesce((F.col("_texts") == F.col("_all")) & (F.col("_least") == F.col("md5")) & (F.col("_most") == F.col("md5")), F.lit(False))
    )
    met = files.join(known, FILE, "left").withColumn("changed", ~same).drop("_all", "_texts", "_least", "_most")
    # of files with one path all are changed if one is
    met = met.withColumn("changed", named & F.max("changed").over(Window.partitionBy(*FILE)))
    return met.withColumn("content", kept)


def next_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` after a scan of ``files``; paths not seen keep their md5."""
    now = files.select(*FILE, "md5")
    return now.unionByName(state.select(*FILE, "md5").join(now, FILE, "left_anti"))


def parse_name_status(rows: DataFrame, line: str = "line") -> DataFrame:
    """(project, path, status, old_path) from tab-separated name-status lines."""
    cols = F.split(F.col(line), "\t")
    status = F.substring(F.element_at(cols, 1), 1, 1)
    return rows.where(F.trim(F.col(line)) != "").select(
        "project",
        F.element_at(cols, -1).alias("path"),
        status.alias("status"),
        F.when((status == "R") & (F.size(cols) > 2), F.element_at(cols, 2)).alias("old_path"),
    )


def changed_files(files: DataFrame, changes: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Files of a change set; deletions and ignored paths are left out."""
    live = changes.where((F.col("status") != "D") & ~ignored(F.col("path"), ignore))
    return files.join(live.select(*FILE), FILE, "left_semi")


def root_files(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").contains("/"))


def config_files(files: DataFrame, names: Iterable[str] = CONFIG_NAMES) -> DataFrame:
    """(project, name, content): known root files, first 5000 characters."""
    return files.where(F.col("path").isin(*names)).select(
        "project",
        F.col("path").alias("name"),
        F.substring("content", 1, MANIFEST_CHARS).alias("content"),
    )


def readmes(files: DataFrame) -> DataFrame:
    """(project, name, content): the first readme name a project has, first 5000 characters."""
    rank = F.array_position(F.array(*[F.lit(n) for n in README_NAMES]), F.col("path"))
    return (
        files.where(F.col("path").isin(*README_NAMES))
        .select(
            "project",
            F.struct(
                rank.alias("rank"),
                F.col("path").alias("name"),
                F.substring("content", 1, MANIFEST_CHARS).alias("content"),
            ).alias("r"),
        )
        .groupBy("project")
        .agg(F.min("r").alias("r"))
        .select("project", "r.name", "r.content")
    )


def dependency_names(content: Column, keys: Iterable[str]) -> Column:
    """Names under the dependency ``keys`` of a package manifest; empty for bad JSON."""
    none = F.array().cast("array<string>")
    parts = [
        F.coalesce(
            F.map_keys(F.from_json(F.get_json_object(content, f"$.{k}"), "map<string,string>")),
            none,
        )
        for k in keys
    ]
    return F.array_distinct(F.flatten(F.array(*parts)))


def npm_packages(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(project, ecosystem, name) declared in package manifests or present in node_modules.

    ``listing`` (project, path) adds paths that were listed but not read.
    """
    files = files.select(*FILE, "content")
    if listing is not None:
        inside = listing.where(F.col("path").startswith("node_modules/"))
        files = files.unionByName(inside.select(*FILE, F.lit(None).cast("string").alias("content")))
    path = F.col("path")
    found = F.when(path == "package.json", dependency_names(F.col("content"), DEPENDENCY_KEYS)).otherwise(
        F.array(node_module_name(path))
    )
    return (
        files.where((path == "package.json") | path.startswith("node_modules/"))
        .select("project", F.lit("npm").alias("ecosystem"), F.explode(found).alias("name"))
        .where(F.col("name").isNotNull() & ~F.col("name").startswith("."))
        .distinct()
    )


def node_module_name(path: Column) -> Column:
    """Package a path below the top-level node_modules belongs to; '@scope/name' for scopes."""
    p = path_parts(path)
    scoped = F.try_element_at(p, F.lit(2)).startswith("@")
    return F.when(
        scoped & (F.size(p) > 3), F.concat_ws("/", F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3)))
    ).when(~scoped & (F.size(p) > 2), F.try_element_at(p, F.lit(2)))


def installed_packages(listing: DataFrame) -> DataFrame:
    """(project, ecosystem, name) from a package listing: lower case, '-' as '_'."""
    return listing.select(
        "project",
        F.lit("pypi").alias("ecosystem"),
        F.replace(F.lower("name"), F.lit("-"), F.lit("_")).alias("name"),
    ).distinct()


def in_asset_dir(path: Column, dirs: Iterable[str]) -> Column:
    return path.contains("/") & F.substring_index(path, "/", 1).isin(*dirs)


