"""Structural facts of Python files and the performance rules on them.

Parsing is the one step Spark has no expression for: ``mapInPandas`` turns each file into a
few fact rows.  What is a finding is decided on the facts, relationally.
"""

from __future__ import annotations

import ast
import sys
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sievework.functions.predicates import either, has, text
from sievework.schema import FILE, Rule

# executors need no copy of this package: the parser travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT_COLUMNS = [
    "project", "path", "idx", "kind", "name", "line_no", "loops", "loop", "plain_loop", "is_data", "seq", "inner_line", "inner_data",
]
FACTS_DDL = (
    "project string, path string, idx int, kind string, name string, line_no int, "
    "loops array<int>, loop int, plain_loop int, is_data boolean, seq int, inner_line int, inner_data boolean"
)

# Names of calls that do input or output, and the largest harmless range.
IO_CALLS = [
    "open", "read", "write",
    "requests.get", "requests.post", "requests.put", "requests.delete",
    "urllib.request.urlopen", "httpx.get", "httpx.post",
]
SMALL_RANGE = 20


def dotted_name(func: ast.expr) -> str | None:
    """'a.b.c' for a name or an attribute chain (only the attributes if it starts elsewhere)."""
    parts: list[str] = []
    while isinstance(func, ast.Attribute):
        parts.insert(0, func.attr)
        func = func.value
    if isinstance(func, ast.Name):
        parts.insert(0, func.id)
    return ".".join(parts) or None


def over_data(loop: ast.For | ast.AsyncFor) -> bool:
    """The loop is not over a small constant range."""
    it = loop.iter
    is_range = isinstance(it, ast.Call) and isinstance(it.func, ast.Name) and it.func.id == "range"
    if not is_range or not it.args:
        return True
    first = it.args[0]
    small = (
        isinstance(first, ast.Constant)
        and isinstance(first.value, int)
        and first.value <= SMALL_RANGE
    )
    return not small


def file_facts(content: str) -> Iterator[tuple]:
    """(idx, kind, name, line_no, for-ancestors, first loop, first plain loop, is_data, seq).

    ``idx`` is the breadth-first place of the node, so of two nodes of one subtree the smaller
    comes first in a walk of that subtree.
    """
    todo: deque = deque([(ast.parse(content), (), None, None)])
    idx = -1
    while todo:
        node, fors, loop, plain = todo.popleft()
        idx += 1
        mine = (fors, loop, plain)
        if isinstance(node, ast.Import):
            for seq, alias in enumerate(node.names):
                yield (idx, "import", alias.name, node.lineno, [], loop, plain, None, seq)
        elif isinstance(node, ast.ImportFrom):
            if node.module and not node.level:
                yield (idx, "import", node.module, node.lineno, [], loop, plain, None, 0)
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            yield (idx, "for", None, node.lineno, list(fors), loop, plain, over_data(node), 0)
            first_plain = plain if plain is not None or isinstance(node, ast.AsyncFor) else idx
            mine = (fors + (idx,), idx if loop is None else loop, first_plain)
        elif isinstance(node, ast.While):
            mine = (fors, idx if loop is None else loop, idx if plain is None else plain)
        elif isinstance(node, ast.Call) and loop is not None:
            name = dotted_name(node.func)
            if name:
                yield (idx, "call", name, node.lineno, [], loop, plain, None, 0)
        elif isinstance(node, ast.AugAssign) and plain is not None:
            if isinstance(node.op, ast.Add) and isinstance(node.target, ast.Name):
                yield (idx, "append", node.target.id, node.lineno, [], loop, plain, None, 0)
        todo.extend((child, *mine) for child in ast.iter_child_nodes(node))


def facts_with_inner(content: str) -> Iterator[tuple]:
    """Facts, each loop with line and kind of the first loop nested in it; a file that does not parse is one fact."""
    try:
        facts = list(file_facts(content))
    except (SyntaxError, ValueError, RecursionError) as e:
        # said, not passed over; no rule looks at this kind
        yield (-1, "unparsed", type(e).__name__, getattr(e, "lineno", None) or 1, [], None, None, None, 0, None, None)
        return
    inner: dict[int, tuple] = {}  # facts come in the order of idx, so the first one met is the first in the walk
    for _, kind, _, line_no, loops, _, _, is_data, _ in facts:
        if kind == "for":
            for outer in loops:
                inner.setdefault(outer, (line_no, is_data))
    for fact in facts:
        yield (*fact, *(inner.get(fact[0], (None, None)) if fact[1] == "for" else (None, None)))


def _facts_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for project, path, content in zip(batch["project"], batch["path"], batch["content"]):
            rows += [(project, path, *fact) for fact in facts_with_inner(content)]
        out = pd.DataFrame(rows, columns=FACT_COLUMNS)
        yield out.astype({"loop": "Int32", "plain_loop": "Int32", "is_data": "boolean", "inner_line": "Int32", "inner_data": "boolean"})


def py_facts(files: DataFrame) -> DataFrame:
    """Facts of the .py files; files without an import or a loop never reach Python."""
    py = files.where(f"ext = '.py' AND {has('content', 'import', 'for', 'while')}")
    return py.select(*FILE, "content").mapInPandas(_facts_of_batches, FACTS_DDL)


class PyFacts:
    """Table function: the facts of one file."""

    def eval(self, project: str, path: str, content: str) -> Iterator[tuple]:
        if content is not None:
            for fact in facts_with_inner(content):
                yield (project, path, *fact)


def register(spark: SparkSession, name: str = "py_facts") -> None:
    """Makes the facts a table function: SELECT f.* FROM files, LATERAL py_facts(project, path, content) f.

    Lateral, so that each file is parsed where its row is; ``py_facts`` the DataFrame function parses by batches.
    """
    spark.udtf.register(name, udtf(PyFacts, returnType=FACTS_DDL))


NESTED = Rule("nested-loop-on2", "major", "performance", 0.7, "code", "Potential O(n²) nested loop",
              "A loop over data inside a loop over data.", "Index one side in a dict or set.")
IO_LOOP = Rule("io-in-loop", "major", "performance", 0.8, "code", "I/O operation in loop",
               "Input or output in every iteration.", "Batch it outside the loop.")
CONCAT = Rule("concat-in-loop", "minor", "performance", 0.6, "code", "Concatenation in loop",
              "Repeated += copies what was built so far.", "Append to a list and join once.")


AST_RULES = [NESTED, IO_LOOP, CONCAT]


def _order(first: str) -> Column:
    """Walk order within a file: the loop it was reached from, then the node."""
    return F.col(first).cast("long") * (1 << 31) + F.col("idx")


def ast_candidates(facts: DataFrame) -> DataFrame:
    """(project, path, line_no, end_line, rule, name, seq, …): what each fact gives rise to.

    ``rule`` is null for facts without a finding; a line may have several candidates of one
    rule, of which the dedupe keeps the first.
    """
    io = F.expr(either(f"endswith(name, {text(c)})" for c in IO_CALLS))
    kind = F.col("kind")
    rule = (
        F.when((kind == "for") & F.col("is_data") & F.col("inner_data"), NESTED.rule_id)
        .when((kind == "call") & io, IO_LOOP.rule_id)
        .when(kind == "append", CONCAT.rule_id)
    )
    seq = F.when(kind == "call", _order("loop")).when(kind == "append", _order("plain_loop")).otherwise(
        F.col("idx").cast("long")
    )
    return facts.select(
        *FILE, "line_no", F.col("inner_line").alias("end_line"), rule.alias("rule"), "kind", "name",
        "idx", "seq", seq.alias("walk"),
    )
