"""Rule tables too large to be written into a plan: an index of required literals, joined with the lines.

Every regex of a table is analysed for literals that each of its matches contains, white space of any length counted
as one blank (``sources/literals.py``).  The rarest run of each literal is its key in the index (``operators/runs.py``).
A line is cut into its runs of all lengths a key may have; those that no rule asks for are dropped at once, the others
meet the index in an equi-join by their hashes, and a rule's regex is only tried on lines that contain its literals.
Rules without a literal, and those with the most frequent ones, are tried on every line, as many at a time as one
projection holds.  Equal regexes are tried once, on distinct lines; what they find is joined with the places of the
lines, and last with the rules, so that findings, whose number may grow with the square of the input, are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import dialect, glob_regex
from sievework.operators.lines import evidence, explode_lines
from sievework.operators.packs import PACK_EXTS
from sievework.operators.runs import SIZES, maybe, once, rarest, runs, shares
from sievework.schema import FINDING, union_all
from sievework.sources.literals import BLANKS, GRAM, needles
from sievework.sources.rules import LineRuleSpec, check_rule
from sievework.sources.stage import staged

#: Bits of the filter that drops runs no rule asks for, in all and in one part of it.
MOST_BITS, REGION = 1 << 28, 1 << 20
#: Files that tell rare runs from frequent ones, characters of their lines, rules of one line pass, findings of one
#: task, tasks at most.
SAMPLE, LONGEST, PER_PASS, PER_TASK, MOST_TASKS = 200, 1 << 16, 150, 1_000_000, 20_000
#: Share of the lines above which a rule's literals do not narrow the search, and rules of one test that meet a line at a time.
OFTEN, TOGETHER = 0.02, 500

_RAW = (
    "rule_no long, id string, regex string, pattern string, `regex-not` string, languages array<string>, files array<string>, "
    "severity string, category string, message string, description string, suggestion string, confidence double"
)
_CHECKED = (
    "rule_no long, rule_id string, regex string, exclude string, exts array<string>, globs array<string>, severity string, "
    "category string, message string, description string, suggestion string, confidence double, sets array<array<string>>, "
    "test string, test_not string, path_test string, python string, error string"
)
_NAMES = [c.split()[0].strip("`") for c in _RAW.split(", ")]
_OUT = [c.split()[0] for c in _CHECKED.split(", ")]


_OWN = [f.name for f in fields(LineRuleSpec) if f.name in _OUT]
_STRINGS = pa.list_(pa.string())
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<string>": _STRINGS, "array<array<string>>": pa.list_(_STRINGS)}
_CHECKED_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in _CHECKED.split(", "))])


def _check(raw: dict) -> dict:
    number = raw.pop("rule_no")
    raw = {k: v for k, v in raw.items() if v is not None}
    try:
        spec = check_rule(raw, "table")
        found = needles(spec.python, spaced=True)
    except (ValueError, TypeError, AttributeError) as e:
        return {"rule_no": number, "rule_id": raw.get("id", "custom-rule"), "error": str(e).split("\n")[0]}
    own = {name: getattr(spec, name) for name in _OWN}
    return own | {
        "rule_no": number, "sets": found, "test": dialect(spec.regex), "path_test": "|".join(map(glob_regex, spec.globs)) or None,
        "test_not": dialect(spec.exclude) if spec.exclude else None,
    }


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([_check(raw) for raw in batch.to_pylist()], schema=_CHECKED_ARROW)


def rule_table(raw: DataFrame) -> DataFrame:
    """A table of rules as users write them, checked: one row each, with its literals or with the ``error`` it has.

    ``raw`` has ``rule_no`` (the order of rules) and any of id, regex, pattern, regex-not, languages, files, severity,
    category, message, description, suggestion and confidence.
    """
    kinds = dict(zip(_NAMES, [c.rsplit(" ", 1)[1] for c in _RAW.split(", ")], strict=True))
    given = [F.col(f"`{n}`").cast(kinds[n]) if n in raw.columns else F.lit(None).cast(kinds[n]) for n in _NAMES]
    given = raw.select(*[c.alias(n) for c, n in zip(given, _NAMES, strict=True)])
    # a rule is short and its check is long, so few splits of rules are dealt over all cores
    tasks = 4 * raw.sparkSession.sparkContext.defaultParallelism
    return given.repartition(tasks, "rule_no", "regex").mapInArrow(_checked, _CHECKED)


def spaced(text: Column) -> Column:
    """``text`` as the literals of ``needles(…, spaced=True)`` are made for."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), f"[{BLANKS}]+", " ")


def literal_keys(literals: DataFrame, files: DataFrame, flat: bool = True) -> DataFrame:
    """(needle, key, n): for each literal the hash of the run that is its key, the one that the fewest lines of SAMPLE files hold.

    ``n`` is their share of these lines.  Which run is taken only matters for speed.  ``flat`` literals are those of
    spaced lines; others have runs of GRAM characters only.
    """
    line = spaced(F.col("line")) if flat else F.col("line")
    sizes = SIZES if flat else (GRAM,)
    sampled = [r.line for r in explode_lines(files.limit(SAMPLE)).select(F.substring(line, 1, LONGEST).alias("line")).collect()]
    known = shares(sampled, sizes)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, n = rarest(batch.column("needle").to_pylist(), known, sizes)
                yield pa.RecordBatch.from_arrays([batch.column("needle"), pa.array(keys.view("int64")), pa.array(n)], names=["needle", "key", "n"])

    return literals.select("needle").mapInArrow(keyed, "needle string, key long, n double")


def _region(table: pa.Table) -> pa.Table:
    slots = table.column("slot").to_numpy()
    bits = np.zeros(REGION // 8, dtype=np.uint8)
    np.bitwise_or.at(bits, (slots % REGION) >> 3, (1 << (slots & 7)).astype(np.uint8))
    return pa.table({"region": [int(slots[0]) // REGION], "bits": [bits.tobytes()]}, schema=pa.schema([("region", pa.int64()), ("bits", pa.binary())]))


def _filter(keys: DataFrame) -> bytes:
    """Bits that tell which runs some rule may ask for: about sixteen for each key, 32 MB at most, made in parts."""
    size = min(MOST_BITS, max(REGION, 1 << (16 * keys.count()).bit_length()))
    low, high = F.col("key").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(size - 1))
    slots = keys.select(F.explode(F.array(low, high)).alias("slot"))
    out = bytearray(size // 8)
    for row in slots.groupBy(F.floor(F.col("slot") / REGION).alias("region")).applyInArrow(_region, "region long, bits binary").toLocalIterator():
        out[row.region * REGION // 8 : (row.region + 1) * REGION // 8] = row.bits
    return bytes(out)


def _asked_for(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(line_id, key): the runs of spaced lines that some rule may ask for, each once a line."""
    filled = lines.sparkSession.sparkContext.broadcast(_filter(keys))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filled.value, dtype=np.uint8)
        for batch in batches:
            ids, hits = batch.column("line_id").to_numpy(), []
            for owner, key in runs(batch.column("flat").to_pylist()):
                asked = maybe(key, bits)
                hits.append((owner[asked], key[asked]))
            if hits:
                owner, key = once(np.concatenate([o for o, _ in hits]), np.concatenate([k for _, k in hits]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(key.view("int64"))], names=["line_id", "key"])

    return lines.select("line_id", spaced(F.col("line")).alias("flat")).mapInArrow(found, "line_id long, key long")


def _joined(patterns: DataFrame, literals: DataFrame, keys: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, pattern, chunks): lines that match a pattern, found through its literals, each pair once.

    ``literals`` has the literals (pattern, at, needle) of the patterns' sets.  Lines meet the literals, each once however
    many patterns share it.  A pattern then meets the lines of the set of its that the fewest lines hold, all counted.
    """
    keys = staged(keys.join(literals.select("needle").distinct(), "needle", "left_semi"))
    held = staged(_asked_for(lines, keys).join(keys.select("needle", "key"), "key").select("needle", "line_id"))
    counts = held.groupBy("needle").agg(F.count("*").alias("held"))
    of_set = literals.join(counts, "needle", "left").groupBy("pattern", "at").agg(F.sum(F.coalesce("held", F.lit(0))).alias("held"))
    best = of_set.groupBy("pattern").agg(F.min_by("at", F.struct("held", "at")).alias("at"), F.min("held").alias("held")).where("held > 0")
    others = F.filter("sets", lambda x, i: i != F.col("at"))
    needles = F.element_at("sets", F.col("at") + 1)
    used = patterns.join(best, "pattern").select("pattern", "chunks", "test", needles.alias("needles"), others.alias("others"))
    used = used.withColumn("needle", F.explode("needles"))

    def here(needle: Column) -> Column:
        return F.contains(F.col("flat"), needle)

    first = F.try_element_at(F.filter("needles", here), F.lit(1))
    # lines come to the few pairs that are left, by their ids
    alike = held.join(used, "needle").join(lines.withColumn("flat", spaced(F.col("line"))), "line_id")
    alike = alike.where((first == F.col("needle")) & F.forall("others", lambda some: F.exists(some, here)))
    return alike.where(F.rlike("line", F.col("test"))).select("line_id", "pattern", "chunks")


def _passed(patterns: DataFrame, lines: DataFrame) -> list[DataFrame]:
    """(line_id, pattern, chunks) as ``_joined``, by trying every pattern on every line, PER_PASS patterns in a pass."""
    parts, chunk = [], []
    for row in [*patterns.select("pattern", "chunks", "test").orderBy("pattern").toLocalIterator(), None]:
        if row is not None:
            chunk.append(row)
        if chunk and (row is None or len(chunk) == PER_PASS):
            tests = [F.when(F.rlike("line", F.lit(r.test)), F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.chunks).alias("chunks"))) for r in chunk]
            parts.append(lines.select("line_id", F.explode(F.array_compact(F.array(*tests))).alias("m")).select("line_id", "m.*"))
            chunk = []
    return parts


def _with_texts(numbered: DataFrame, rules: DataFrame, files: DataFrame, said: Sequence[str]) -> DataFrame:
    """``numbered`` with the texts findings get.  Of rules that share a number, those found by literals get the texts of all.

    For this, but for nothing else, a rule is found by literals if few lines hold the runs of GRAM characters of its
    literals, white space as it stands.  It is only asked for rules that share a number.
    """
    numbers = staged(rules.where("rule_no IS NOT NULL").groupBy("rule_no").agg(F.count("*").alias("k")).where("k > 1").select("rule_no"))
    scope = [c for c in numbered.columns if c != "python"]
    if numbers.isEmpty():
        return numbered.select(*scope)
    shared = staged(numbered.join(numbers, "rule_no", "left_semi"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [needles(x) for x in batch.column("python").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("python"), pa.array(found, type=_ARROW["array<array<string>>"])], names=["python", "sets"])

    own = staged(shared.select("python").distinct().mapInArrow(sets, "python string, sets array<array<string>>"))
    literals = own.select("python", F.posexplode("sets").alias("at", "needles")).select("python", "at", F.explode("needles").alias("needle"))
    n = literals.join(literal_keys(literals.select("needle").distinct(), files, flat=False).select("needle", "n"), "needle")
    n = n.groupBy("python", "at").agg(F.sum("n").alias("n")).groupBy("python").agg(F.min("n").alias("n"))
    rare = staged(n.where(F.col("n") <= OFTEN).select("python"))
    texts = rules.join(numbers, "rule_no", "left_semi").select(*said)
    all_texts = shared.join(rare, "python", "left_semi").select("rule_no", *[c for c in scope if c not in said]).join(texts, "rule_no")
    parts = [numbered.join(numbers, "rule_no", "left_anti"), shared.join(rare, "python", "left_anti"), all_texts]
    return union_all([p.select(*scope) for p in parts])


def table_findings(files: DataFrame, rules: DataFrame, exts: Sequence[str] = PACK_EXTS) -> DataFrame:
    """Findings of a checked rule table, the same as those of ``pack_findings`` with the rules as a list.

    Rows with an error are no rules.  ``ord`` is the rule's number.
    """
    spark = files.sparkSession
    rules = staged(rules.where("error IS NULL").drop("error"))
    seen = files.where(F.col("ext").isin(*exts))
    # a test that many rules share and a line that many files hold meet once
    patterns = staged(
        rules.groupBy("test", "sets").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("chunks")).withColumn("pattern", F.monotonically_increasing_id())
    )
    places = explode_lines(seen).select("project", "path", "ext", "line_no", "line")
    lines = staged(places.select("line").distinct().withColumn("line_id", F.monotonically_increasing_id()))
    literals = staged(
        patterns.select("pattern", F.posexplode("sets").alias("at", "needles")).select("pattern", "at", F.explode("needles").alias("needle"))
    )
    keys = staged(literal_keys(literals.select("needle").distinct(), seen))
    share = literals.join(keys.select("needle", "n"), "needle").groupBy("pattern", "at").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.min("n").alias("n"))
    patterns = staged(patterns.join(share, "pattern", "left").withColumn("rare", F.coalesce(F.col("n") <= OFTEN, F.lit(False))))
    # a pass is cheaper for literals that many lines hold, but there is only one for them: their number may grow
    frequent = staged(patterns.where("NOT rare AND n IS NOT NULL").orderBy(F.desc("n"), "pattern").limit(PER_PASS))
    plain = patterns.where("n IS NULL").unionByName(frequent)
    joined = patterns.where("n IS NOT NULL").join(frequent.select("pattern"), "pattern", "left_anti")
    own = literals.join(joined.select("pattern"), "pattern", "left_semi")
    matches = staged(union_all([_joined(joined, own, keys, lines), *_passed(plain, lines)]))

    said = ["rule_no", "rule_id", "severity", "category", "message", "description", "suggestion", "confidence"]
    scope = ["pattern", "chunk", "test_not", "exts", "path_test"]
    here = staged(patterns.join(matches.groupBy("pattern").agg(F.count("*").alias("met")), "pattern").select("test", "sets", "pattern", "chunks", "met"))
    numbered = rules.join(here, ["test", "sets"])
    numbered = numbered.withColumn("chunk", F.pmod(F.xxhash64("rule_no", "rule_id", "test_not"), F.col("chunks")))
    told = _with_texts(numbered.select(*scope, *said, "python", "met"), rules, seen, said)
    # rules that look alike at a place are tried there once
    told = staged(told.groupBy(*scope).agg(F.collect_list(F.struct(*said)).alias("rules"), F.max("met").alias("met")))
    most = told.agg(F.sum(F.size("rules") * F.col("met"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, most // PER_TASK))

    held = lines.join(matches.select("line_id").distinct(), "line_id", "left_semi")
    placed = places.join(held, "line").withColumn("evidence", evidence(F.col("line")))
    # a pattern of many rules is dealt in parts, so that its lines do not meet all of them in one task
    spread = matches.select("line_id", "pattern", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    by = ["pattern", "chunk"]
    met = spread.join(placed, "line_id").repartition(tasks, *by).join(told.repartition(tasks, *by), by).where(
        ((F.size("exts") == 0) | F.array_contains("exts", F.col("ext")))
        & (F.col("path_test").isNull() | F.rlike("path", F.col("path_test")))
        & (F.col("test_not").isNull() | ~F.rlike("line", F.col("test_not")))
    )
    found = met.select("project", "path", "line_no", "evidence", F.explode("rules").alias("rule")).select("project", "path", "line_no", "evidence", "rule.*")
    none = F.lit(None)
    columns = {
        "file": F.col("path"), "line_no": F.col("line_no").cast("int"), "end_line": none.cast("int"), "title": F.col("message"),
        "engine": F.lit("rules"), "ord": F.col("rule_no").cast("int"), "seq": F.lit(0).cast("long"),
    }
    return found.select(*[columns.get(c, F.col(c)).alias(c) for c in FINDING])
