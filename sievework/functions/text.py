"""Column helpers for text, regexes, globs and paths."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NEEDS_UNICODE = re.compile(r"\\[wWdDsSbB]")


def dialect(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Java spelling of a Python regex: '\\n' is the only line end, classes are Unicode.

    The Unicode classes slow Java down, so the flag is set only where a pattern can notice.
    """
    flags = "d"
    if ignore_case or _NEEDS_UNICODE.search(pattern):
        flags += "U"
    if ignore_case:
        flags += "i"
    if multiline:
        flags += "m"
    return f"(?{flags}){pattern}"


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    return any_of(col.contains(n) for n in needles)


def any_of(conds: Iterable[Column]) -> Column:
    out = None
    for c in conds:
        out = c if out is None else (out | c)
    return F.lit(False) if out is None else out


def strip(col: Column) -> Column:
    """Strip every Unicode white space, as Python does (``trim`` only strips blanks)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def glob_regex(glob: str) -> str:
    """Shell glob over the whole path; ``*`` also crosses '/'.  Usable in Java and RE2."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        i += 1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            if body.startswith("!"):
                body = "^" + body[1:]
            elif body.startswith("^"):
                body = "\\" + body
            out += f"[{body}]"
            i = end + 1
        else:
            out += re.escape(ch)
    return rf"(?s)^{out}\z"


def glob_match(col: Column, glob: str) -> Column:
    return col.rlike(glob_regex(glob))


def path_parts(path: Column) -> Column:
    """Path components; also the sort key for path order (``a/b`` before ``a.b``)."""
    return F.split(path, "/")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a relative path, '' at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)).otherwise(
        F.lit("")
    )


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.coalesce(
        F.nullif(F.regexp_extract(name, r"(?s)^(.+)\.[^.]+\z", 1), F.lit("")), name
    )


def join_path(directory: Column, name: Column) -> Column:
    return F.when(directory == "", name).otherwise(F.concat(directory, F.lit("/"), name))


def normal_path(path: Column) -> Column:
    """Resolve '.' and '..'; null when the path leaves its root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.array_join(F.aggregate(parts, start, step), "/")


def has_part(path: Column, names: Iterable[str]) -> Column:
    """Some path component is one of ``names``."""
    return F.arrays_overlap(path_parts(path), F.array(*[F.lit(n) for n in sorted(names)]))


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def line_at(content: Column, position: Column) -> Column:
    """1-based line of a 1-based character position."""
    head = F.substring(content, F.lit(1), position)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("int") + 1


def count_char(col: Column, ch: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))


def fixed_point(amount: Column, unit: int, digits: int) -> Column:
    """``amount / unit`` with ``digits`` decimals as text, ties to even.

    Done on integers: the quotient of two longs is rounded exactly, whatever its double form.
    """
    scaled = amount.cast("long") * 10**digits
    rest = F.pmod(scaled, F.lit(unit))
    whole = ((scaled - rest) / unit).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    rounded = whole + F.when(up, 1).otherwise(0)
    if digits == 0:
        return rounded.cast("string")
    base = 10**digits
    fraction = F.lpad((rounded % base).cast("string"), digits, "0")
    return F.concat(((rounded - rounded % base) / base).cast("long").cast("string"), F.lit("."), fraction)
