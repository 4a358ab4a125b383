"""Code-like tables derived from the given tables, so that every query's work grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.predicates import text
from sievework.sources.files import file_table

# Lines put in place of prose; a line not covered keeps its text.
TEMPLATES = [
    "import os",
    "import quantum_widget",
    'import left from "left-pad-ultra"',
    'const ex = require("express")',
    'api_key = "sk-demo-abcdefghijklmnop123456"',
    'password = "dflt1234" or os.getenv("PW")',
    'password: "hunter2xyz"',
    'cursor.execute(f"SELECT * FROM t WHERE id = {uid}")',
    "subprocess.run(cmd, shell=True)",
    "result = eval(payload)",
    "data = pickle.loads(raw)",
    "cfg = yaml.load(stream)",
    "resp = session.send(req, verify=False)",
    "/* start of note",
    "end of note */",
    "/* one line note */",
    "# TODO: tidy this up",
    "// const old = 1",
    "el.innerHTML = bio",
    "<div dangerouslySetInnerHTML={{ __html: html }} />",
    "const query = `SELECT * FROM t WHERE n = ${n}`",
    "document.write(markup)",
    'localStorage.setItem("token", tok)',
    'app.use(cors({ origin: "*" }))',
    "for (const id of ids) {",
    "const r = await fetch(url)",
    'const node = document.querySelector("#row")',
    "}",
    'const text = fs.readFileSync("a.json")',
    "console.log(r)",
    'win.addEventListener("resize", onResize)',
    'win.removeEventListener("resize", onResize)',
    'win.addEventListener("scroll", onScroll)',
    "const href = URL.createObjectURL(blob)",
    "URL.revokeObjectURL(href)",
    "useEffect(() => {",
    "btn.onclick = async () => { await save() }",
    "isLoading = true",
    "const opts = { timeout: 600000 }",
    "requests.get(api_url)",
    "const f = input.files[0]; new FileReader()",
    "if (f.size > MAX_SIZE) return",
    "let store = new Map()",
    "cache = {}",
    "<p>The API payload is null</p>",
    "<p>status 500</p>",
    "throw new Error(`bad ${x}`)",
    "items.map((it) => it.name)",
    "if (items.length === 0) return null",
    'fetch("/api/self")',
    'params = (uid, "?")',
    "DEBUG = True",
    "const d = await UserModel.find({})",
    "from .util import helper",
    "class Widget(Base):",
    "def render(self):",
    "useEffect(watch)",
    'doc.addEventListener("click", () => go())',
    "}, [id])",
    'app.post("/pay", (req, res) => { res.json(req.body) })',
    "const pool = new Pool(cfg); bcrypt.hash(pw, 4)",
    'jwt.sign(user, "s3cretvalue")',
    'fs.writeFileSync("/tmp/out", err.message)',
    "let seen = new Set(); new XMLHttpRequest()",
    "rows.map((row, i) => <li key={i}>{row}</li>)",
    'cursor.execute("SELECT * FROM t WHERE id = " + uid)',
    'ddl = "CREATE TABLE t (id INT);',
    "CREATE TABLE jobs (id INT);",
    "res.json(error)",
    "useEffect(() => { load() });",
]
SLOTS = 71
EXTS = [".py", ".js", ".tsx", ".html"]


def _texts(values: list[str]) -> Column:
    return F.expr(f"array({', '.join(text(v) for v in values)})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, spread over the cores where the input has fewer splits than there are cores.

    A large table has many splits and is not shuffled.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def code_path(top: Column | None = None) -> Column:
    pick = F.floor(F.col("doc_id") / 7) % 4 + 1
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), pick.cast("int"))
    api = F.when(F.col("doc_id") % 3 == 0, "/api").otherwise("")
    return F.concat(F.lit("src/") if top is None else top, "lang", api, F.lit("/f"), F.col("doc_id").cast("string"), ext)


def code_files(
    spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, *keep: str | Column, shift: Column | int = 0, top: Column | None = None
) -> DataFrame:
    """One file per document, its lines replaced by templates in rotation."""
    docs = documents(spark, sf_dir) if docs is None else docs
    templates = _texts(TEMPLATES)

    def line(old: Column, i: Column) -> Column:
        slot = (F.col("doc_id") * 7 + shift + i + 1) % SLOTS
        return F.when(
            slot < len(TEMPLATES), F.element_at(templates, (slot + 1).cast("int"))
        ).otherwise(old)

    content = F.array_join(F.transform(F.split("text", "\n", -1), line), "\n")
    return file_table(
        docs.select(
            F.col("source").alias("project"), code_path(top).alias("path"), content.alias("content"), *keep
        )
    )


# The tree in four steps, as SQL over doc_id that Spark and DuckDB read alike: what a file's lines are shifted by,
# which files there are, and which have moved.
SHIFT = [
    "0", "CASE WHEN doc_id % 3 = 1 THEN 5 ELSE 0 END", "CASE WHEN doc_id % 6 = 1 THEN 5 ELSE 0 END",
    "CASE WHEN doc_id % 6 = 1 THEN 5 WHEN doc_id % 7 = 2 THEN 9 ELSE 0 END",
]
ALIVE = ["doc_id % 10 <> 4", *["doc_id % 10 <> 3"] * 3]
TOP = [*["'src/'"] * 2, *["CASE WHEN doc_id % 10 = 7 THEN 'moved/' ELSE 'src/' END"] * 2]


def tree_at(spark: SparkSession, sf_dir: str, step: int, *keep: str | Column) -> DataFrame:
    """All files as they are at a step."""
    docs = documents(spark, sf_dir).where(ALIVE[step])
    code = code_files(spark, sf_dir, docs, *keep, shift=F.expr(SHIFT[step]), top=F.expr(TOP[step]))
    return code.unionByName(py_files(spark, sf_dir, docs, *keep))


def versions_at(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    """What a step sends to a stream: files that are new or changed, every fifth one again as it is, and paths that are gone."""
    same = " AND ".join(f"({a[step]}) = ({a[step - 1]})" for a in (SHIFT, ALIVE, TOP)) if step else "false"
    now = tree_at(spark, sf_dir, step, F.expr(f"NOT ({same}) OR doc_id % 5 = 0").alias("sent")).where("sent").drop("sent")
    now = now.withColumns({"seq": F.lit(step).cast("long"), "deleted": F.lit(False)})
    if not step:
        return now
    gone = tree_at(spark, sf_dir, step - 1).join(tree_at(spark, sf_dir, step).select("project", "path"), ["project", "path"], "left_anti")
    return now.unionByName(gone.withColumns({"seq": F.lit(step).cast("long"), "deleted": F.lit(True), "content": F.lit(None).cast("string")}))


STYLES = [
    "a:hover { color: red }\nb { top: 0 }",
    "@media (hover: hover) {\na:hover { color: red }\n}",
    "b:hover { top: 0 }\nb:focus { top: 1 }",
    "@media print { a:hover { top: 0 } }\np { top: 0 }",
]


def style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One style sheet per document: its text as a comment, then one of four rules."""
    style = F.element_at(_texts(STYLES), (F.col("doc_id") % 4 + 1).cast("int"))
    return file_table(
        documents(spark, sf_dir).select(
            F.col("source").alias("project"),
            F.concat(F.lit("styles/s"), F.col("doc_id").cast("string"), F.lit(".css")).alias("path"),
            F.concat(F.lit("/* "), "text", F.lit(" */\n"), style).alias("content"),
        )
    )


# Parsable Python with known findings.
SNIPPETS = [
    "import os, json\nfrom .util import helper\nimport quantum_widget.core\n",
    "for user in users:\n    for perm in perms:\n        pass\n",
    "for i in range(5):\n    for j in range(5):\n        pass\n",
    "for uid in ids:\n    requests.get(uid)\n    text += uid\n",
    "while busy:\n    for x in range(len(xs)):\n        f.read()\n        total += 1\n",
    "async def go():\n    async for row in rows:\n        out += row\n        for c in row:\n            open(c)\n",
    "from flaskish.app import App\nfrom collections import deque\n",
    "for a in xs:\n    for b in range(3):\n        spread(b)\n    for c in xs:\n        box.items += c\n",
]


def py_files(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None, *keep: str | Column) -> DataFrame:
    """One Python file per document: three snippets in turn, then its text as comments; every eleventh does not parse."""
    docs = documents(spark, sf_dir) if docs is None else docs
    snippets = _texts(SNIPPETS)

    def pick(step: int) -> Column:
        return F.element_at(snippets, ((F.col("doc_id") + step) % len(SNIPPETS) + 1).cast("int"))

    broken = F.when(F.col("doc_id") % 11 == 0, "def broken(:\n").otherwise("")
    # replace looks for bytes; translate would take every character by itself
    flat = F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\x00"), F.lit(" "))
    comment = F.concat(F.lit("# "), F.replace(flat, F.lit("\n"), F.lit("\n# ")))
    return file_table(
        docs.select(
            F.col("source").alias("project"),
            F.concat(F.lit("app/"), "lang", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
            F.concat(pick(0), pick(3), pick(5), broken, comment).alias("content"), *keep,
        )
    )


#: Where a document's file lies and what is done to its text, by number: (divisor, remainder, SQL).
PLACES = [
    (11, 0, "'node_modules/dep/i' || doc_id || '.js'"), (11, 1, "'src/app.min.js' || doc_id || '.js'"), (11, 2, "'img/p' || doc_id || '.png'"),
    (11, 3, "'docs/guide' || doc_id || '.md'"), (11, 4, "'skip/me/f' || doc_id || '.py'"),
]
ELSEWHERE = "'src/f' || doc_id || '.ts'"
LEAST_LARGE = 3000


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, size_bytes, content): every document as the bytes of a file, some of them bad, some on one line."""
    path = " ".join(f"WHEN doc_id % {d} = {r} THEN {p}" for d, r, p in PLACES)
    flat = F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit(" "))).otherwise(F.col("text"))
    content = F.when(F.col("doc_id") % 13 == 0, F.concat(flat.cast("binary"), F.lit(b"\xff"))).otherwise(flat.cast("binary"))
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.expr(f"CASE {path} ELSE {ELSEWHERE} END").alias("path"), content.alias("content")
    )
    return rows.withColumn("size_bytes", F.octet_length("content").cast("long"))


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that import a shared module of their directory, a module above it and, every
    second one, the file 140 documents before."""
    ext = F.element_at(F.array(F.lit(".ts"), F.lit(".js"), F.lit(".tsx")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project"))
    d = F.col("doc_id")
    back = F.when(d % 2 == 0, F.concat(F.lit('import b from "./m'), (d - 140).cast("string"), F.lit('"'))).otherwise("b()")
    content = F.concat_ws("\n", F.lit('import s from "./shared"'), F.lit('const x = require("../base")'), back, F.lit('import r from "react"'))
    own = docs.select(
        "project",
        F.concat(F.lit("lib/d"), (d % 7).cast("string"), F.lit("/m"), d.cast("string"), ext).alias("path"),
        content.alias("content"),
    )
    shared = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.concat(F.lit("lib/d"), k.cast("string"), F.lit("/shared/index.ts")))
    common = docs.select("project").distinct().select(
        "project", F.explode(F.concat(shared, F.array(F.lit("lib/base.js")))).alias("path"), F.lit("run()").alias("content")
    )
    return file_table(own.unionByName(common))


#: Rules that each document gives, and what tells them apart: (languages, files, severity).
RULE_KINDS = [
    (None, None, "error"), (["python"], None, "warning"), (["javascript", "typescript"], None, "minor"),
    (None, ["src/*/api/*"], "info"), (None, None, "major"),
]


def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as users write them, five per document: two neighbouring words of each fifth of its text.

    The last one leaves out lines with the text's first word.  Documents with too few words give fewer.
    """
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))
    n = F.size("words")

    def word(at: Column) -> Column:
        return F.regexp_replace(F.try_element_at("words", at), r"([!-/:-@\[-`{-~])", r"\\$1")

    def rule(j: int) -> Column:
        at = (F.floor(n * j / 5) + 1).cast("int")
        languages, files, severity = RULE_KINDS[j]
        return F.struct(
            (F.col("doc_id") * 5 + j).alias("rule_no"),
            F.concat(F.lit("pair-"), F.col("doc_id").cast("string"), F.lit(f"-{j}")).alias("id"),
            F.concat(F.lit(r"(?:^|[ \t])"), word(at), F.lit(r"[ \t]+"), word(at + 1), F.lit(r"(?:[ \t]|$)")).alias("regex"),
            (word(F.lit(1)) if j == 4 else F.lit(None).cast("string")).alias("regex-not"),
            F.lit(languages).cast("array<string>").alias("languages"), F.lit(files).cast("array<string>").alias("files"),
            F.lit(severity).alias("severity"), F.lit("style").alias("category"),
        )

    each = docs.select(F.explode(F.array(*[rule(j) for j in range(5)])).alias("r")).select("r.*")
    return each.where(F.col("regex").isNotNull())


def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed script packages: a plain and a scoped one per document."""
    docs = table(spark, sf_dir, "documents")
    names = F.array(
        F.concat(F.lit("node_modules/pkg"), "lang", F.lit("/index.js")),
        F.concat(F.lit("node_modules/@scope/p"), (F.col("doc_id") % 3).cast("string"), F.lit("/i.js")),
        F.lit("node_modules/.bin/run.js"),
    )
    return file_table(docs.select(F.col("source").alias("project"), F.explode(names).alias("path"), F.lit("").alias("content")))


def package_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("src"), F.col("p_size").cast("string")).alias("project"),
        F.concat("p_brand", F.lit("-"), "p_type").alias("name"),
    )


# Manifests by project number: (file name, divisor, remainder, content).
MANIFESTS = [
    ("vercel.json", 10, 0, '{\n"headers": [{"key": "Access-Control-Allow-Origin",\n"value": "*"}],\n"functions": {"a.js": {"runtime": "edge"}}}'),
    ("vercel.json", 10, 5, '{"headers": [{"key": "Cache-Control", "value": "max-age=60"}]}'),
    ("netlify.toml", 5, 1, "[build]\ncommand = build"),
    ("Dockerfile", 5, 2, "FROM node:20"),
    ("serverless.yml", 5, 3, "service: demo"),
    ("Procfile", 5, 4, "web: run"),
    ("package.json", 3, 0, '{"dependencies": {"react": "18", "express": "4"}, "devDependencies": {"@prisma/client": "5"}}'),
    ("package.json", 3, 1, '{"bin": {"tool": "./i.js"}, "dependencies": {"left-pad-ultra": "1"}}'),
    ("package.json", 3, 2, '{"dependencies": {"vue": '),
    ("requirements.txt", 4, 0, "Django==4.2\nrequests"),
    ("requirements.txt", 4, 1, "flask\nSQLAlchemy"),
    ("pyproject.toml", 6, 0, '[project.scripts]\ntool = "a:b"'),
    ("index.html", 7, 0, "<html><body>hello</body></html>"),
    ("README.md", 2, 0, "# Demo project"),
    ("README.txt", 3, 1, "Plain readme"),
]


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files of the projects that occur in ``documents``."""
    projects = table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()
    number = F.substring("project", 4, 10).cast("int")
    rows = F.array(
        *[
            F.when(
                number % d == r, F.struct(F.lit(name).alias("path"), F.lit(text).alias("content"))
            )
            for name, d, r, text in MANIFESTS
        ]
    )
    each = projects.select("project", F.explode(F.array_compact(rows)).alias("m"))
    return file_table(each.select("project", "m.path", "m.content"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole scans look at: sources, manifests and Python files that parse."""
    return project_files(spark, sf_dir).unionByName(py_files(spark, sf_dir))


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files and manifests of all projects."""
    return code_files(spark, sf_dir).unionByName(manifests(spark, sf_dir))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed packages: express everywhere but in projects whose number divides by four."""
    projects = table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct()
    number = F.substring("project", 4, 10).cast("int")
    def entry(cond: Column, ecosystem: str, name: str) -> Column:
        return F.when(cond, F.struct(F.lit(ecosystem).alias("ecosystem"), F.lit(name).alias("name")))

    rows = F.array(entry(number % 4 != 0, "npm", "express"), entry(number % 3 == 0, "pypi", "Quantum_Widget"))
    return projects.select("project", F.explode(F.array_compact(rows)).alias("e")).select("project", "e.*")


def issue_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    e = F.col("event_id")
    ext = F.when(F.col("user_id") % 2 == 0, ".py").otherwise(".js")
    file = F.when(
        e % 97 != 0, F.concat(F.lit("src/f"), (F.col("user_id") % 13).cast("string"), ext)
    )
    severity = (
        F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "major")
        .when(F.col("event_type") == "click", "minor").otherwise("info")
    )
    category = (
        F.when(F.col("event_type") == "error", "security").when(F.col("event_type") == "purchase", "performance")
        .when(F.col("event_type") == "click", "ai_pattern").otherwise("logic")
    )
    return events.select(
        F.day("ts").alias("scan_id"), "ts",
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("project"),
        F.concat(F.lit("rule"), (e % 4).cast("string")).alias("rule_id"),
        file.alias("file"), (e % 3).cast("int").alias("line"), severity.alias("severity"),
        category.alias("category"), e.alias("seq"),
    )


def dismissal_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events") if events is None else events
    e = F.col("event_id")
    return events.where(F.col("event_type") == "view").select(
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("project"), e.alias("seq"), "ts", F.concat(F.lit("rule"), (e % 4).cast("string")).alias("rule_id"),
        F.when(e % 12 != 0, F.concat(F.lit("F"), (F.col("user_id") % 13).cast("string"), F.lit("."))).alias("file_pattern"),
        F.concat(F.lit("reason "), F.col("user_id").cast("string")).alias("reason"),
    )


def dismissal_clears(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clears: every 101st event clears a pattern, every 997th a whole rule."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").where((e % 101 == 0) | (e % 997 == 0)).select(
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("project"), e.alias("seq"), F.concat(F.lit("rule"), (e % 4).cast("string")).alias("rule_id"),
        F.when(e % 997 != 0, F.concat(F.lit("F"), (F.col("user_id") % 13).cast("string"), F.lit("."))).alias("file_pattern"),
    )


def journey_events(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Journey steps before they are numbered."""
    events = table(spark, sf_dir, "events") if events is None else events
    t = F.col("event_type")
    feeling = (
        F.when(t.isin("signup", "purchase"), "smooth").when(t == "view", "confused")
        .when(t == "click", "frustrated").otherwise("lost")
    )
    friction = F.when(F.col("value") > 20, F.concat(F.lit("slow step "), t)).when(F.col("value") > 15, "")
    action = F.when(t == "purchase", "done").when((t == "error") & (F.col("value") > 10), "give_up").otherwise("click")
    return events.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.day("ts").cast("string")).alias("journey_id"),
        "user_id", "ts", "event_id", feeling.alias("feeling"), friction.alias("friction"), action.alias("action"),
    )


def assertion_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(assertions, results) per order: one assertion per line number, one result per line."""
    names = ["dependency", "route", "behavior", "security", "function", "file", "pattern", "ui"]
    kind = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("idx") % 8 + 1)
    status = (
        F.when(F.col("l_returnflag") == "A", "pass").when(F.col("l_returnflag") == "N", "partial")
        .when(F.col("l_returnflag") == "R", "fail").otherwise("odd")
    )
    li = table(spark, sf_dir, "lineitem")
    key = [F.col("l_orderkey").alias("intent_id"), F.col("l_linenumber").alias("idx")]
    part, supplier = F.min("l_partkey").cast("string"), F.min("l_suppkey")
    asserted = li.groupBy(*key).agg(
        F.concat(F.lit("src"), (supplier % 20).cast("string")).alias("project"),
        F.concat(F.lit("part "), part).alias("description"),
        F.concat(F.lit("supplier "), supplier.cast("string")).alias("expect"),
        (F.max("l_quantity") / 50).alias("importance"),
    ).withColumn("type", kind)
    results = li.select(
        *key, status.alias("status"), (F.col("l_discount") * 10).alias("score"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("evidence"),
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("src/p"), F.col("l_partkey").cast("string"), F.lit(".py"))).alias("location"),
    )
    return asserted, results


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    top = F.element_at(F.array(*[F.lit(d) for d in ("public", "static", "assets", "dist", "misc")]), (k % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(d) for d in (".wasm", ".js", ".png", ".css")]), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("src"), (k % 20).cast("string")).alias("project"),
        F.concat(top, F.lit("/a"), k.cast("string"), ext).alias("path"),
        (F.col("p_size").cast("long") * 262144).alias("size_bytes"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-status lines of a third of the files."""
    d = F.col("doc_id") % 7
    status = F.when(d == 0, "A").when(d == 1, "D").when(d == 2, "R087").otherwise("M")
    old = F.when(d == 2, F.concat(F.lit("\told/f"), F.col("doc_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == 0).select(
        F.col("source").alias("project"), F.concat(status, old, F.lit("\t"), code_path()).alias("line")
    )


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plain files, for the incremental source."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"),
        F.md5("text").alias("md5"),
    )


def scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == 0).select(
        F.col("source").alias("project"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"),
        F.md5(text).alias("md5"),
    )


# Features by number, so that every kind of persona occurs: (divisor, remainder).
FEATURES = {
    "has_video_audio": (5, 0), "has_file_upload": (7, 0), "has_dashboard": (2, 0), "has_data_tables": (3, 0),
    "has_api_docs": (4, 1), "has_admin": (6, 2), "has_roles": (9, 4), "has_mobile_meta": (8, 3),
    "has_responsive_css": (10, 7), "has_forms": (11, 1), "has_payments": (13, 5), "has_export": (3, 1),
}


def features(spark: SparkSession, sf_dir: str, customers: bool = True) -> DataFrame:
    """Project features, for one project per customer or for the projects of ``documents``."""
    if customers:
        base = table(spark, sf_dir, "customer").select(
            F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("project"), F.col("c_custkey").alias("k")
        )
    else:
        base = table(spark, sf_dir, "documents").select(F.col("source").alias("project")).distinct().select(
            "project", F.substring("project", 4, 10).cast("int").alias("k")
        )
    return base.select("project", *[(F.col("k") % d == r).alias(n) for n, (d, r) in FEATURES.items()])


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with a route, a message and a text."""
    d = F.col("doc_id")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    content = F.concat(
        F.lit('route: "/r'), (d % 45).cast("string"), F.lit('"\nmessage = "'),
        flat, F.lit('"\n<b>'), F.upper("lang"),
        F.lit(" text "), (d % 33).cast("string"), F.lit("</b>"),
    )
    return file_table(
        documents(spark, sf_dir).select(
            F.col("source").alias("project"),
            F.concat(F.lit("ui/f"), d.cast("string"), F.lit(".tsx")).alias("path"), content.alias("content"),
        )
    )


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    source = F.when(k % 4 == 0, "git_commit").when(k % 4 == 1, "spec_file").when(k % 4 == 2, "cli").otherwise("chat")
    text = F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("order "), k.cast("string")))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project"), source.alias("source"), text.alias("text")
    )


def _in_text(body: Column) -> Column:
    """JSON as reviewers send it: bare, fenced with and without a tag, or not at all."""
    e = F.col("event_id") % 5
    return (
        F.when(e == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(e == 2, F.concat(F.lit("Here:\n```\n"), body, F.lit("\n```\nbye")))
        .when(e == 3, "cannot say { more")
        .otherwise(F.concat(F.lit(" "), body))
    )


def review_payloads(spark: SparkSession, sf_dir: str, whole_project: bool) -> DataFrame:
    """(project, path, payload): three review entries per event."""
    e = F.col("event_id")
    path = F.concat(F.lit("src/f"), (F.col("user_id") % 13).cast("string"), F.lit(".js"))

    def entry(seq: int) -> Column:
        n = e + seq
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.when(n % 4 == 0, "Critical").when(n % 4 == 1, "INFO").when(n % 4 == 2, "blocker").alias("severity"),
            F.when(n % 3 == 0, "security").when(n % 3 == 1, "import").otherwise("other").alias("category"),
            (nothing if seq == 2 else F.concat_ws(" ", "event_type", e.cast("string"))).alias("title"),
            (nothing if seq == 1 else path).alias("file"),
            F.when(n % 6 != 0, n % 40).alias("line"),
            F.when(n % 7 == 0, "1.5").when(n % 7 == 1, None).when(n % 7 == 2, "high").otherwise("0.25").alias("confidence"),
        )

    issues = F.array(*[entry(i) for i in range(3)])
    body = F.to_json(issues) if whole_project else F.to_json(F.struct(issues.alias("issues")))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("project"), path.alias("path"),
        _in_text(body).alias("payload"),
    )


def assertion_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")

    def entry(i: int) -> Column:
        n = e + i
        return F.struct(
            F.when(n % 4 == 0, "Route").when(n % 4 == 1, "UI").when(n % 4 == 2, "widget").alias("type"),
            F.concat_ws(" ", "event_type", F.lit(str(i))).alias("description"),
            F.concat(F.lit("expect "), e.cast("string")).alias("expect"),
            F.when(n % 3 == 0, 0.5).when(n % 3 == 2, 2.5).alias("importance"),
        )

    body = F.to_json(F.array(*[entry(i) for i in range(3)]))
    return table(spark, sf_dir, "events").select(e.alias("intent_id"), _in_text(body).alias("payload"))


def step_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("saw "), e.cast("string")).alias("observation"), F.col("event_type").alias("feeling"),
            F.when(e % 2 == 0, "slow").alias("friction"), F.lit("click").alias("action"),
        )
    )
    return table(spark, sf_dir, "events").select("event_id", _in_text(body).alias("payload"))


def proposed_fixes(findings: DataFrame) -> DataFrame:
    """A fix for each eval, certificate and SQL finding; the last kind matches nothing."""
    rule = F.col("rule_id")
    old = (
        F.when(rule == "dangerous-eval", "result = eval(payload)").when(rule == "ssl-disabled", "verify=False ")
        .otherwise("not in the file")
    )
    new = F.when(rule == "dangerous-eval", "result = json.loads(payload)").otherwise("verify=True")
    return findings.where(rule.isin("dangerous-eval", "ssl-disabled", "sql-injection")).select(
        "project", F.col("file").alias("path"), "line_no", "rule_id", old.alias("old_code"), new.alias("new_code"),
        F.lit("safer").alias("explanation"), F.when(F.col("line_no") % 2 == 0, 0.95).otherwise(0.75).alias("confidence"),
    )


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
