"""Data-driven line rules: every rule becomes one predicate of the shared line pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sievework.functions.predicates import both, either, isin, match, text
from sievework.functions.text import glob_regex
from sievework.operators.lines import Detector, line_findings
from sievework.schema import Rule
from sievework.sources.literals import signs
from sievework.sources.rules import LineRuleSpec, built_in

# Files the rule packs look at in a project scan and in a deep scan.
PACK_EXTS = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java")
DEEP_PACK_EXTS = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")


def pack_detector(spec: LineRuleSpec, exts: Sequence[str] = PACK_EXTS) -> Detector:
    scope = [e for e in exts if not spec.exts or e in spec.exts]

    test = [isin("ext", scope)]
    if spec.globs:
        test.append(either(f"path RLIKE {text(glob_regex(g))}" for g in spec.globs))
    test.append(match("line", spec.regex, hints=spec.hints))
    if spec.exclude:
        test.append(f"NOT {match('line', spec.exclude)}")
    return Detector(
        Rule(spec.rule_id, spec.severity, spec.category, spec.confidence, "rules",
             spec.message, spec.description, spec.suggestion),
        both(*test),
        signs=signs(spec.python),
    )


def pack_detectors(
    specs: Sequence[LineRuleSpec] | None = None, exts: Sequence[str] = PACK_EXTS
) -> list[Detector]:
    return [pack_detector(s, exts) for s in (built_in() if specs is None else specs)]


def pack_findings(
    files: DataFrame, specs: Sequence[LineRuleSpec] | None = None, exts: Sequence[str] = PACK_EXTS
) -> DataFrame:
    return line_findings(files, pack_detectors(specs, exts))
