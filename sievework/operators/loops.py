"""Script performance rules: network and DOM access in loops, blocking file access."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievework.functions.predicates import both, has, isin, match
from sievework.operators.lines import SCRIPT_LOOPS, Detector, line_findings
from sievework.schema import Rule

# Patterns, severities, confidences and titles.
FETCH = r"\b(?:fetch|axios\.\w+|http\.\w+)\s*\("
DOM = "document.querySelector"
SYNC = r"\bfs\.readFileSync\b|\bfs\.writeFileSync\b"


IN_SCRIPT = isin("ext", SCRIPT_LOOPS)
INSIDE = "loop_depth > 0"


def loop_detectors() -> list[Detector]:
    return [
        Detector(
            Rule("fetch-in-loop", "major", "performance", 0.8, "code", "HTTP request in loop",
                 "One network call per iteration.", "Batch the calls or await them together."),
            both(IN_SCRIPT, match("line", FETCH, hints=["fetch", "axios.", "http."])),
            needs=("loop_depth",), keep=INSIDE, with_evidence=False,
        ),
        Detector(
            Rule("dom-in-loop", "minor", "performance", 0.7, "code", "DOM query in loop",
                 "The document is searched in every iteration.", "Look the element up once, before the loop."),
            both(IN_SCRIPT, has("line", DOM)),
            needs=("loop_depth",), keep=INSIDE, with_evidence=False,
        ),
        Detector(
            Rule("sync-io", "minor", "performance", 0.9, "code", "Synchronous file I/O",
                 "A synchronous file call blocks the event loop.", "Use the promise-based file functions."),
            both(IN_SCRIPT, match("line", SYNC, hints=["fs.readFileSync", "fs.writeFileSync"])),
            with_evidence=False,
        ),
    ]


def loop_findings(files: DataFrame) -> DataFrame:
    return line_findings(files, loop_detectors())
