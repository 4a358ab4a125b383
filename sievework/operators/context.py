"""What kind of project this is, and how that changes the weight of a finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.predicates import both, case, either, has, isin, text
from sievework.functions.skew import join_key
from sievework.sources.files import dependency_names

# Platforms in order of precedence (file names, platform, serverless, listed as).
PLATFORMS = [
    (["vercel.json"], "vercel", True, "vercel.json"),
    (["netlify.toml"], "netlify", True, "netlify.toml"),
    (["railway.json", "railway.toml"], "railway", False, "railway.json"),
    (["serverless.yml", "serverless.yaml"], "aws-lambda", True, "serverless.yml"),
    (["Dockerfile", "docker-compose.yml"], "docker", False, "Dockerfile"),
    (["Procfile"], "heroku", False, "Procfile"),
]
# Frameworks by how they are found, and what they bring.
PY_MANIFESTS = ["requirements.txt", "Pipfile", "pyproject.toml"]
PY_FRAMEWORKS = ["django", "flask", "fastapi"]
JS_FRAMEWORKS = {
    "next": ["next"], "react": ["react", "react-dom"], "vue": ["vue"], "svelte": ["svelte"],
    "express": ["express"], "fastify": ["fastify"],
}
PY_ORMS = ["django", "sqlalchemy", "prisma"]
JS_ORMS = ["prisma", "@prisma/client", "sequelize", "drizzle-orm"]
JS_CSRF = ["helmet", "csurf"]
UI_FRAMEWORKS = ["react", "next", "vue", "svelte"]
SERVER_FRAMEWORKS = ["express", "fastify", "fastapi", "flask", "django"]
CLI_MANIFESTS = ["setup.cfg", "pyproject.toml"]
INDEX_PAGES = ["index.html", "public/index.html", "src/index.html"]
XSS_RULES = ["xss-innerhtml", "xss-react-dangerous"]

CONTEXT_FILES = sorted(
    {n for names, *_ in PLATFORMS for n in names}
    | {*PY_MANIFESTS, *CLI_MANIFESTS, *INDEX_PAGES, "package.json"}
)


def project_context(files: DataFrame) -> DataFrame:
    """One row per project with a manifest; ``files`` has project, path, content.

    One aggregation of booleans with map-side partials: a project of any size sends one row
    per task.  Only manifest paths pass the pushed-down filter; a project without any has
    the default context (all false), which the joins fill in.
    """
    in_py, is_pkg = isin("path", PY_MANIFESTS), "path = 'package.json'"

    def says(*words: str) -> str:
        return both(in_py, has("lower(content)", *words))

    def depends(*names: str) -> str:
        return f"arrays_overlap(deps, array({', '.join(text(n) for n in names)}))"

    functions = "from_json(get_json_object(content, '$.functions'), 'map<string,string>')"
    flags = {
        **{f"on_{p.replace('-', '_')}": isin("path", names) for names, p, _, _ in PLATFORMS},
        "edge": both("path = 'vercel.json'", f"exists(map_values({functions}), v -> contains(lower(v), 'edge'))"),
        **{f"fw_{f}": says(f) for f in PY_FRAMEWORKS},
        **{f"fw_{f}": depends(*names) for f, names in JS_FRAMEWORKS.items()},
        "orm": either([says(*PY_ORMS), depends(*JS_ORMS)]),
        "csrf": depends(*JS_CSRF),
        "cors": depends("cors"),
        "pkg": is_pkg,
        "cli": either(
            [
                both(is_pkg, "get_json_object(content, '$.bin') IS NOT NULL"),
                both(isin("path", CLI_MANIFESTS), has("content", "[project.scripts]", "console_scripts")),
            ]
        ),
        "page": isin("path", INDEX_PAGES),
    }
    flags["on_vercel"] = either([flags["on_vercel"], "startswith(path, '.vercel/')"])

    # the dependency list is parsed once, for the manifest only
    deps = F.when(F.col("path") == "package.json", dependency_names(F.col("content"), ["dependencies", "devDependencies"]))
    seen = files.where(either([isin("path", CONTEXT_FILES), "startswith(path, '.vercel/')"])).select(
        "project", "path", "content", deps.alias("deps")
    )
    agg = seen.groupBy("project").agg(
        *[F.expr(f"bool_or(coalesce({sql}, false)) AS {name}") for name, sql in flags.items()]
    )

    def fw(names: list[str]) -> str:
        return either(f"fw_{n}" for n in names)

    def by_platform(value) -> str:
        return case(*[(f"on_{p.replace('-', '_')}", value(p, no_server, listed)) for _, p, no_server, listed in PLATFORMS])

    frameworks = ", ".join(f"CASE WHEN fw_{f} THEN {text(f)} END" for f in [*PY_FRAMEWORKS, *JS_FRAMEWORKS])
    ui, api = fw(UI_FRAMEWORKS), fw(SERVER_FRAMEWORKS)
    return agg.selectExpr(
        "project",
        f"{by_platform(lambda p, *_: text(p))} AS deployment",
        f"coalesce({by_platform(lambda p, no_server, _: str(no_server).lower())}, false) AS is_serverless",
        "on_vercel AND edge AS has_edge_runtime",
        f"{ui} OR {api} OR page AS is_web_app",
        "cli AS is_cli",
        "false AS is_library",
        f"{api} AS is_api",
        f"array_compact(array({frameworks})) AS frameworks",
        "orm AS has_orm",
        f"{ui} OR fw_django AS has_template_escaping",
        "csrf OR fw_django AS has_csrf_protection",
        "cors AS has_cors_configured",
        f"array_compact(array({by_platform(lambda p, _, listed: text(listed))}, CASE WHEN pkg THEN 'package.json' END)) AS config_files",
    )


def project_languages(files: DataFrame) -> DataFrame:
    """(project, languages): the languages of a project's source files."""
    return (
        files.where(F.col("language").isNotNull())
        .groupBy("project")
        .agg(F.sort_array(F.collect_set("language")).alias("languages"))
    )


def adjusted_severity(rule_id: Column, context: dict[str, Column]) -> Column:
    """'suppress', a new severity, or null to keep; the first rule that applies decides."""
    react = F.array_contains(context["frameworks"], "react")
    return (
        F.when(rule_id.isin(*XSS_RULES) & context["is_cli"] & ~context["is_web_app"], "suppress")
        .when((rule_id == "xss-react-dangerous") & react, "minor")
        .when((rule_id == "sql-injection") & context["has_orm"], "minor")
        .when((rule_id == "cors-wildcard") & ~context["is_api"], "info")
        .when((rule_id == "localstorage-sensitive") & context["is_cli"], "suppress")
    )


ADJUSTED_RULES = [*XSS_RULES, "sql-injection", "cors-wildcard", "localstorage-sensitive"]
CONTEXT_FLAGS = ["is_cli", "is_web_app", "is_api", "has_orm"]


def adjust_severity(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Change or drop findings by project context.

    The context has one row per project.  Spark broadcasts it only when it measures it below
    its threshold; otherwise a project with very many findings is split by the skew join.
    Findings of the rules that are never adjusted pass through without a partner.
    """
    touched = F.coalesce(F.col("rule_id").isin(*ADJUSTED_RULES), F.lit(False))
    dims = context.select(F.col("project").alias("_p"), "frameworks", *CONTEXT_FLAGS)
    cols = {c: F.coalesce(F.col(c), F.lit(False)) for c in CONTEXT_FLAGS}
    cols["frameworks"] = F.coalesce("frameworks", F.array().cast("array<string>"))
    keyed = findings.withColumn("_k", join_key("project", touched, "file", "line_no", "rule_id"))
    j = keyed.join(dims, F.col("_k") == F.col("_p"), "left")
    j = j.withColumn("_new", adjusted_severity(F.col("rule_id"), cols))
    kept = j.where(F.coalesce("_new", F.lit("")) != "suppress")
    return kept.withColumn("severity", F.coalesce("_new", "severity")).select(*findings.columns)
