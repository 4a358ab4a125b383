"""The three jobs: code scan, deep analysis, persona analysis.  Each returns one lazy plan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.predicates import both
from sievework.operators.context import adjust_severity, project_context
from sievework.operators.deep import deep_findings
from sievework.operators.findings import STRICTNESS, by_strictness, dedupe
from sievework.operators.history import carry_forward, unsuppressed
from sievework.operators.imports import UNKNOWN, python_findings, script_import_findings
from sievework.operators.lines import Detector, line_findings
from sievework.operators.loops import loop_detectors
from sievework.operators.packs import pack_detectors
from sievework.operators.persona import persona_findings, personas, project_signals
from sievework.operators.pyfacts import AST_RULES, py_facts
from sievework.operators.security import security_detectors
from sievework.schema import FILE, FINDING, FINDING_DDL, union_all
from sievework.sources.files import (
    changed_files,
    changed_since,
    is_pack_file,
    is_source,
    marked_since,
    source_files,
    unchanged,
)
from sievework.sources.rules import LineRuleSpec, built_in
from sievework.sources.sinks import last_issues, last_state, save_scan
from sievework.sources.stage import remove, shared_folder, staged


@dataclass(frozen=True)
class ScanOptions:
    """What a project may configure."""

    strictness: str = "medium"
    ignore: Sequence[str] = ()
    security: bool = True
    performance: bool = True
    ai_patterns: bool = True
    importable: Sequence[str] = ()
    rules: Sequence[LineRuleSpec] = field(default_factory=built_in)


def line_detectors(options: ScanOptions) -> list[Detector]:
    """Security, loop and pack rules.  Built-in detectors see source files, the packs their own set; strictness
    applies to the former only."""
    allowed = STRICTNESS.get(options.strictness, STRICTNESS["medium"])
    own = [
        *(security_detectors() if options.security else []),
        *(loop_detectors() if options.performance else []),
    ]
    detectors = [replace(d, match=both("in_source", d.match)) for d in own if d.rule.severity in allowed]
    detectors += [replace(d, match=both("in_packs", d.match)) for d in pack_detectors(options.rules)]
    return detectors


def line_rules(files: DataFrame, options: ScanOptions) -> DataFrame | None:
    """The line rules in one pass over the lines."""
    detectors = line_detectors(options)
    if not detectors:
        return None
    marked = files.withColumns(
        {"in_source": is_source(options.ignore), "in_packs": is_pack_file(F.col("path"))}
    ).where("in_source OR in_packs")
    return line_findings(marked, detectors, "in_source", "in_packs").drop("in_source", "in_packs")


def checked_findings(files: DataFrame, packages: DataFrame, options: ScanOptions = ScanOptions(),
                     lookup: DataFrame | None = None) -> list[DataFrame]:
    """Findings of Python facts and of script imports, each from a read of the files of its language.

    Local modules are looked up in ``lookup`` (default: the same files).
    """
    lookup = files if lookup is None else lookup
    src = source_files(files, options.ignore)
    first = -1  # imports come before the line rules
    checked = []
    if options.ai_patterns or options.performance:
        checked.append(
            python_findings(
                py_facts(src), lookup if options.ai_patterns else None, packages,
                list(options.importable), rules=options.performance, order=first,
            )
        )
    if options.ai_patterns:
        checked.append(script_import_findings(src, packages, first))
    return [by_strictness(c, options.strictness) for c in checked]


def code_findings(files: DataFrame, packages: DataFrame, options: ScanOptions = ScanOptions(), lookup: DataFrame | None = None,
                  extra: Iterable[DataFrame] = ()) -> DataFrame | None:
    """Findings of all detectors and reviews, the first of each (project, file, line, rule).

    A line rule hits a line once.  So where no other detector shares its id, as among the built-in ones, line findings
    have no doubles and are neither shuffled nor sorted for it; only the imports, facts and reviews are.
    """
    lines = line_rules(files, options)
    others = [*checked_findings(files, packages, options, lookup), *[e.select(*FINDING) for e in extra]]
    ids = [d.rule.rule_id for d in line_detectors(options)]
    alone = len(set(ids)) == len(ids) and not extra and not set(ids) & {UNKNOWN.rule_id, *[r.rule_id for r in AST_RULES]}
    if lines is None:
        return dedupe(union_all(others)) if others else None
    if alone:
        return lines.select(*FINDING).unionByName(dedupe(union_all(others))) if others else lines.select(*FINDING)
    return dedupe(union_all([lines, *others]))


def scan(
    files: DataFrame, packages: DataFrame, options: ScanOptions = ScanOptions(),
    context: DataFrame | None = None, dismissed: DataFrame | None = None,
    state: DataFrame | None = None, changes: DataFrame | None = None,
    extra: Iterable[DataFrame] = (), intent: DataFrame | None = None, lookup: DataFrame | None = None,
) -> DataFrame:
    """Findings of a code scan: detect, dedupe, weigh by context, drop the silenced ones.

    ``state`` limits the scan to files changed since it, ``changes`` to a change set; local
    modules are still looked up among ``lookup`` (project, path; or project, dir, name), by default all ``files``.  ``extra`` are findings from
    reviews, treated like the scan's own.  ``intent`` findings have no place in a file; they are
    added as they are, after the other steps.
    """
    todo = files
    if changes is not None:
        todo = changed_files(todo, changes, options.ignore)
    if state is not None:
        todo = changed_since(todo, state)
    found = code_findings(todo, packages, options, files if lookup is None else lookup, list(extra))
    if found is None:
        found = files.sparkSession.createDataFrame([], FINDING_DDL)
    context = project_context(files) if context is None else context
    found = adjust_severity(found, context)
    found = found if dismissed is None else unsuppressed(found, dismissed)
    return found if intent is None else found.unionByName(intent.select(*found.columns))


def incremental_scan(
    files: DataFrame, packages: DataFrame, root: str, scan_id: int, options: ScanOptions = ScanOptions(), scan_mode: str = "full",
    context: DataFrame | None = None, dismissed: DataFrame | None = None, **report: object,
) -> None:
    """Scan what changed since each project's last complete scan in ``root`` and append the whole result as scan ``scan_id``.

    Issues of files that did not change are taken over from the last scan, those of files that are gone
    are not, so the log of every scan is complete and its delta shows no issue as fixed that is still there.
    A project without a scan is scanned whole.  Issues taken over keep the severity they had; dismissals hold
    for them too.  ``report`` goes to ``save_scan``.  A scan that is run again reads the scans before it only.
    """
    spark = files.sparkSession
    context = project_context(files) if context is None else context
    state = staged(last_state(spark, root, scan_mode, scan_id))
    # the tree is read once: all keys and hashes, and the content of what changed
    folder = shared_folder(spark, "tree")
    marked_since(files, state).write.parquet(folder)
    tree = spark.read.parquet(folder)
    every = tree.select(*FILE, "md5")
    found = scan(tree.where("changed").drop("changed"), packages, options, context, dismissed, lookup=every)
    kept = last_issues(spark, root, scan_mode, scan_id)
    carried = carry_forward(kept.limit(0), kept, unchanged(every, state))
    if dismissed is not None:
        carried = unsuppressed(carried, dismissed)
    save_scan(found, root, scan_id, scan_mode, projects=every, carried=carried, state=every, **report)
    remove(spark, folder)


def deep_scan(
    files: DataFrame, assets: DataFrame | None = None, context: DataFrame | None = None,
    parity: bool = False,
) -> DataFrame:
    """Findings of the deep analysis: architecture, runtime and domain packs."""
    context = project_context(files) if context is None else context
    return deep_findings(files, context, assets, packs=True, parity=parity)


def persona_scan(
    files: DataFrame, assets: DataFrame | None = None, persona: str | None = None
) -> DataFrame:
    """Findings of the persona analysis, one copy per persona concerned."""
    signals = project_signals(files)
    return persona_findings(files, signals, personas(signals, persona), assets)
