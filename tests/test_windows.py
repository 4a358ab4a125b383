"""State over lines and skew-safe windows against plain loops."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sievework.functions.skew import (
    budget_prefix, numbered, preceding_rows, previous_value, salted_anti_join,
)
from sievework.functions.text import fixed_point, glob_regex, normal_path, path_parts, stem, strip, suffix
from sievework.operators.lines import line_signals

PIECES = ["/*", "*/", "x", "/* a */", "*/ b /*", ""]
LOOPS = ["for (a) {", "}", "}}", "x.map(() => {", "fetch(u)", "y", "while (b) { }"]


def test_block_comment_state(files):
    rng = random.Random(1)
    content = {f"f{i}.js": "\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for i in range(40)}
    got = {(r.path, r.line_no): r.in_block for r in line_signals(files(content), "in_block").collect()}
    for path, text in content.items():
        inside = False
        for n, line in enumerate(text.split("\n"), 1):
            assert got[path, n] == inside, (path, n)
            if "/*" in line:
                inside = inside or "*/" not in line
            elif "*/" in line:
                inside = False


def test_loop_depth(files):
    rng = random.Random(2)
    content = {f"f{i}.js": "\n".join(["fetch(u)"] + [rng.choice(LOOPS) for _ in range(60)]) for i in range(30)}
    got = {(r.path, r.line_no): r.loop_depth for r in line_signals(files(content), "loop_depth").collect()}
    for path, text in content.items():
        depth = 0
        for n, line in enumerate(text.split("\n"), 1):
            depth += line.startswith(("for", "while")) or ".map" in line
            assert got[path, n] == depth, (path, n)
            depth = max(0, depth - line.count("}"))


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows under one key."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", i, rng.randint(1, 30)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, n int, size int")


@pytest.mark.parametrize("budget", [0, 5, 200, 5000, 100000])
def test_budget_prefix(hot, budget):
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    plain = hot.withColumn("running", F.sum("size").over(w)).where(F.col("running") <= budget)
    got = budget_prefix(hot, ["k"], [F.col("n")], "size", budget, salts=7)
    assert sorted(got.collect()) == sorted(plain.select(got.columns).collect())


def test_budget_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 500), ("a", 3, 1)], "k string, n int, size int")
    assert [r.n for r in budget_prefix(df, ["k"], [F.col("n")], "size", 100).collect()] == [1]


def test_numbered(hot):
    got = numbered(hot, ["k"], F.floor(F.col("n") / 100), [F.col("n")], "rn")
    w = Window.partitionBy("k").orderBy("n")
    assert got.withColumn("plain", F.row_number().over(w)).where("rn <> plain").count() == 0
    assert got.count() == 3000


@pytest.mark.parametrize("block", [6, 64])
def test_preceding_rows(hot, block):
    rows = hot.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("n")))
    got = preceding_rows(rows, ["k"], "pos", 5, F.col("size"), "before", block)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(-5, -1)
    plain = rows.withColumn("before", F.collect_list("size").over(w))
    assert sorted(got.select("k", "pos", "before").collect()) == sorted(plain.select("k", "pos", "before").collect())


def test_previous_value(hot):
    got = previous_value(hot.select("k", "n"), ["k"], "n", "prev", width=64)
    plain = hot.select("k", "n", F.lag("n").over(Window.partitionBy("k").orderBy("n")).alias("prev"))
    key = lambda r: (r.k, r.n)
    assert sorted(got.select("k", "n", "prev").collect(), key=key) == sorted(plain.collect(), key=key)


def test_salted_anti_join(hot, spark):
    right = spark.createDataFrame([("hot", 50), ("k1", 10)], "r_k string, lim int")
    got = salted_anti_join(hot, right, ["k"], F.col("n") < F.col("lim"), ["n"])
    assert got.count() == hot.where("NOT (k = 'hot' AND n < 50) AND NOT (k = 'k1' AND n < 10)").count()


def test_paths(spark):
    import fnmatch

    df = spark.createDataFrame(
        [("a/b.py",), ("a.py",), ("A/.hid",), ("x/../y/./z.JS",), ("../up.ts",), ("m.min.js",)], "p string"
    )
    p = F.col("p")
    rows = df.select("p", suffix(p).alias("s"), stem(p).alias("t"), normal_path(p).alias("n")).collect()
    assert {r.p: (r.s, r.t, r.n) for r in rows} == {
        "a/b.py": (".py", "b", "a/b.py"), "a.py": (".py", "a", "a.py"), "A/.hid": ("", ".hid", "A/.hid"),
        "x/../y/./z.JS": (".js", "z", "y/z.JS"), "../up.ts": (".ts", "up", None), "m.min.js": (".js", "m.min", "m.min.js"),
    }
    ordered = [r.p for r in df.where("p like 'a%'").orderBy(path_parts(p)).collect()]
    assert ordered == ["a/b.py", "a.py"]
    for glob in ["*.py", "a/*", "[!a]*", "?.py", "*.min.js", "x[", "a.b"]:
        got = {r.p for r in df.where(p.rlike(glob_regex(glob))).collect()}
        assert got == {r.p for r in rows if fnmatch.fnmatchcase(r.p, glob)}, glob


def test_strip_and_fixed_point(spark):
    df = spark.createDataFrame([("\t  x y \n",)], "s string")
    assert df.select(strip(F.col("s"))).first()[0] == "x y"
    sizes = [0, 1, 1048576, 5505024, 5767168, 13107200, 5872025, 9999999999]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = df.select("n", fixed_point(F.col("n"), 1 << 20, 1).alias("a"), fixed_point(F.col("n"), 1 << 20, 0).alias("b"))
    for r in got.collect():
        assert (r.a, r.b) == (f"{r.n / (1 << 20):.1f}", f"{r.n / (1 << 20):.0f}")
