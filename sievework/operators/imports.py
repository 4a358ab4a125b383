"""Imports that resolve to nothing: not built in, not installed, not in the project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.predicates import isin, starts
from sievework.functions.skew import join_key
from sievework.functions.text import (
    contains_any,
    dialect,
    file_name,
    parent_dir,
    path_parts,
    stem,
    suffix,
)
from sievework.operators.lines import SCRIPT, Detector, describe, explode_lines
from sievework.operators.pyfacts import AST_RULES, ast_candidates
from sievework.schema import FILE, Rule, to_findings

# The standard library, whatever interpreter runs the job, and names importable everywhere.
STDLIB = [
    "abc", "aifc", "argparse", "array", "ast", "asyncio", "atexit", "base64", "binascii", "bisect", "builtins",
    "calendar", "cgi", "cgitb", "chunk", "cmath", "cmd", "code", "codecs", "codeop", "collections", "colorsys",
    "compileall", "concurrent", "configparser", "contextlib", "contextvars", "copy", "copyreg", "cProfile", "crypt",
    "csv", "ctypes", "curses", "dataclasses", "datetime", "dbm", "decimal", "difflib", "dis", "distutils", "doctest",
    "email", "encodings", "enum", "errno", "faulthandler", "fcntl", "filecmp", "fileinput", "fnmatch", "fractions",
    "ftplib", "functools", "gc", "getopt", "getpass", "gettext", "glob", "graphlib", "grp", "gzip", "hashlib",
    "heapq", "hmac", "html", "http", "idlelib", "imaplib", "imghdr", "imp", "importlib", "inspect", "io", "ipaddress",
    "itertools", "json", "keyword", "lib2to3", "linecache", "locale", "logging", "lzma", "mailbox", "mailcap",
    "marshal", "math", "mimetypes", "mmap", "modulefinder", "multiprocessing", "netrc", "nis", "nntplib", "numbers",
    "operator", "optparse", "os", "ossaudiodev", "pathlib", "pdb", "pickle", "pickletools", "pipes", "pkgutil",
    "platform", "plistlib", "poplib", "posix", "posixpath", "pprint", "profile", "pstats", "pty", "pwd", "py_compile",
    "pyclbr", "pydoc", "queue", "quopri", "random", "re", "readline", "reprlib", "resource", "rlcompleter", "runpy",
    "sched", "secrets", "select", "selectors", "shelve", "shlex", "shutil", "signal", "site", "smtpd", "smtplib",
    "sndhdr", "socket", "socketserver", "spwd", "sqlite3", "ssl", "stat", "statistics", "string", "stringprep",
    "struct", "subprocess", "sunau", "symtable", "sys", "sysconfig", "syslog", "tabnanny", "tarfile", "telnetlib",
    "tempfile", "termios", "test", "textwrap", "threading", "time", "timeit", "tkinter", "token", "tokenize",
    "tomllib", "trace", "traceback", "tracemalloc", "tty", "turtle", "turtledemo", "types", "typing", "unicodedata",
    "unittest", "urllib", "uu", "uuid", "venv", "warnings", "wave", "weakref", "webbrowser", "winreg", "winsound",
    "wsgiref", "xdrlib", "xml", "xmlrpc", "zipapp", "zipfile", "zipimport", "zlib", "_thread", "typing_extensions",
    "annotations", "__future__",
]

# Modules that come with the script runtime, alias prefixes, import patterns.
RUNTIME_MODULES = [
    "assert", "buffer", "child_process", "cluster", "console", "constants",
    "crypto", "dgram", "dns", "domain", "events", "fs", "http", "https",
    "module", "net", "os", "path", "perf_hooks", "process", "punycode",
    "querystring", "readline", "repl", "stream", "string_decoder", "sys",
    "timers", "tls", "tty", "url", "util", "v8", "vm", "wasi",
    "worker_threads", "zlib", "node:test", "node:assert",
]
ALIASES = ["node:", "@/", "~/", "#/"]
FROM_IMPORT = r"""(?:import|export)\s+.*?from\s+['"]([^'"./][^'"]*?)['"]"""
REQUIRE = r"""require\s*\(\s*['"]([^'"./][^'"]*?)['"]\s*\)"""

UNKNOWN = Rule("hallucinated-import", "critical", "import", 0.9, "code", "Hallucinated import",
               "Nothing installed or local has this name.", "Check the name, then install it or drop the import.")


def path_entries(files: DataFrame, *keep: str) -> DataFrame:
    """(project, dir, name, keep…): what each path makes importable, its module and the directories on its way.

    The project itself lies in the folder of all projects, which has no name: a package beside a checkout resolves.
    """
    path = F.col("path")
    parts = path_parts(path)
    module = F.when(
        suffix(path).isin(".py", ""),
        F.struct(
            F.col("project"), parent_dir(path).alias("dir"),
            F.when(suffix(path) == ".py", stem(path)).otherwise(file_name(path)).alias("name"),
        ),
    )
    folders = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda part, i: F.struct(F.col("project"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), part.alias("name")),
    )
    own = F.struct(F.lit("").alias("project"), F.lit("").alias("dir"), F.regexp_replace("project", r"\.py$", "").alias("name"))
    every = F.concat(F.array_compact(F.array(module)), folders, F.array(own))
    return files.select(*keep, F.explode(every).alias("e")).select("e.*", *keep)


def local_entries(files: DataFrame) -> DataFrame:
    """(project, dir, name): importable things by directory — sub-directories and .py files.

    One pass over the paths; the copies collapse before the shuffle.  Entries are taken as they are.
    """
    return files if "dir" in files.columns else path_entries(files).distinct()


def unknown_python_imports(
    rows: DataFrame, files: DataFrame, packages: DataFrame, importable: list[str] = ()
) -> DataFrame:
    """``rows`` of Python facts without the imports that resolve.

    The standard library is a literal list and goes first; the joins with the installed
    packages (project, ecosystem, name), the modules at the project root, those beside the
    importing file and those beside the project see only what is left.  Other facts pass through.
    """
    is_import = F.col("kind") == "import"
    root = F.split_part("name", F.lit("."), F.lit(1))
    left = rows.withColumn("_root", root).where(
        f"kind <> 'import' OR NOT {isin('_root', [*STDLIB, *importable])}"
    )
    left = left.withColumns(
        {
            "_k": join_key("project", is_import, "path", "idx"),
            "_low": F.lower("_root"),
            "_dir": parent_dir(F.col("path")),
            # the project root; not a literal, so that both lookups keep the same join and
            # Spark shuffles the entries once
            "_top": F.substring("path", 1, 0),
        }
    )
    pypi = packages.where(F.col("ecosystem") == "pypi").select(
        F.col("project").alias("_k"), F.lower("name").alias("_low")
    )
    entries = local_entries(files).select(
        F.col("project").alias("e_project"), F.col("dir").alias("e_dir"), F.col("name").alias("e_name")
    )

    def lookup(df: DataFrame, project: Column, directory: str) -> DataFrame:
        on = (project == entries["e_project"]) & (df[directory] == entries["e_dir"]) & (df["_root"] == entries["e_name"])
        return df.join(entries, on, "left_anti")

    left = left.join(pypi, ["_k", "_low"], "left_anti")
    left = lookup(lookup(left, F.col("_k"), "_top"), F.col("_k"), "_dir")
    return lookup(left, F.when(is_import, "").otherwise(F.col("_k")), "_top").drop("_k", "_low", "_dir", "_top", "_root")


def package_name(spec: Column) -> Column:
    """First path segment, or two for '@scope/name'."""
    parts = F.split(spec, "/")
    return F.when(spec.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(
        F.element_at(parts, 1)
    )


def script_imports(files: DataFrame) -> DataFrame:
    """(project, path, line_no, spec, package, seq): bare package imports, in reading order."""
    scripts = files.where(
        F.col("ext").isin(*SCRIPT) & contains_any(F.col("content"), ["require", "from"])
    )
    line = F.col("line")
    lines = explode_lines(scripts).where(contains_any(line, ["require", "from"]))
    specs = F.concat(
        F.regexp_extract_all(line, F.lit(dialect(FROM_IMPORT)), 1),
        F.regexp_extract_all(line, F.lit(dialect(REQUIRE)), 1),
    )
    each = lines.select(*FILE, "line_no", F.posexplode(specs).alias("seq", "spec"))
    return each.withColumn("package", package_name(F.col("spec")))


def unknown_script_imports(files: DataFrame, packages: DataFrame) -> DataFrame:
    found = script_imports(files).where(
        f"NOT {isin('package', RUNTIME_MODULES)} AND NOT {starts('package', *ALIASES)}"
    )
    npm = packages.where(F.col("ecosystem") == "npm").select("project", F.col("name").alias("package"))
    return found.join(npm, ["project", "package"], "left_anti")


def _finding(df: DataFrame, name: str, language: str, why: Column, idx: Column, order: int) -> DataFrame:
    quoted = F.concat(
        F.lit("Import '"), F.col(name), F.lit(f"' not found in installed {language} packages")
    )
    return to_findings(
        df, UNKNOWN, file=F.col("path"), line_no=F.col("line_no"),
        title=F.concat(F.lit("Hallucinated import: "), F.col(name)),
        description=why, evidence=quoted, order=order, seq=idx,
    )


def script_import_findings(files: DataFrame, packages: DataFrame, order: int = 0) -> DataFrame:
    why = F.concat(F.lit("Package '"), F.col("package"), F.lit("' is not in node_modules or package.json"))
    return _finding(unknown_script_imports(files, packages), "spec", "javascript", why, F.col("seq"), order)


def python_findings(
    facts: DataFrame, files: DataFrame | None, packages: DataFrame | None,
    importable: list[str] = (), rules: bool = True, order: int = 0,
) -> DataFrame:
    """Import and structure findings of Python files from one evaluation of their facts.

    ``files`` are those local modules are looked up in; without them imports are not checked.
    """
    rows = ast_candidates(facts)
    if files is not None:
        rows = unknown_python_imports(rows, files, packages, importable)
        is_import = F.col("kind") == "import"
        rows = rows.withColumn("rule", F.when(is_import, UNKNOWN.rule_id).otherwise(F.col("rule")))
    else:
        rows = rows.where("kind <> 'import'")
    if not rules:
        rows = rows.where("kind = 'import'")
    rules_said = [UNKNOWN, *AST_RULES]
    ids = F.array(*[F.lit(r.rule_id) for r in rules_said])
    quoted = (
        "CASE WHEN rule = 'hallucinated-import' THEN concat('Import \\'', name, '\\' not found in installed python packages') END"
    )
    found = rows.where(F.col("rule").isNotNull()).select(
        *FILE, "line_no", (F.array_position(ids, F.col("rule")) - 1).cast("int").alias("det"),
        F.expr(quoted).alias("line"), F.when(F.col("rule") == "nested-loop-on2", F.col("end_line")).alias("last"),
        "name",
        F.when(F.col("kind") == "import", F.col("walk") * 4096 + F.col("seq")).otherwise(F.col("walk")).alias("walk"),
    )
    titles = {
        UNKNOWN.rule_id: "concat('Hallucinated import: ', name)",
        "io-in-loop": "concat('I/O operation in loop: ', name)",
    }
    detectors = [
        Detector(r, "true", with_evidence=r is UNKNOWN, title=titles.get(r.rule_id)) for r in rules_said
    ]
    return (
        describe(found, detectors, "last", "walk")
        .withColumns({"end_line": F.col("last"), "seq": F.col("walk"), "ord": F.col("ord") + order})
        .drop("last", "walk")
    )


def import_findings(
    files: DataFrame, facts: DataFrame, packages: DataFrame,
    importable: list[str] = (), entries_from: DataFrame | None = None, order: int = 0,
) -> DataFrame:
    """Both languages; which check applies follows from the extension.

    ``entries_from`` are the files local modules are looked up in (default: ``files``).
    """
    lookup = files if entries_from is None else entries_from
    py = python_findings(facts, lookup, packages, list(importable), rules=False, order=order)
    return py.unionByName(script_import_findings(files, packages, order))
