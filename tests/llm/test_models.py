import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from conftest_llm import DOCS, LONG, ODD

from sievework.llm import boosting, decontaminate, hmm, html, urls


# ---- op6


def tokens(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def test_base_scores_like_brute_force(table):
    rows = [*ODD, (60, "one one two"), (61, "unseen words here zzz")]
    counts = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    got = hmm.hmm_scores(table(DOCS, rows)).collect()
    want = []
    for d, x in rows:
        ts = tokens(x)
        want.append((str(d), held(d), len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)))
    for r, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(want), strict=True):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert abs(r.base_score - w[5]) < 1e-6 * abs(w[5])
        assert r.score < 0 and math.isfinite(r.score)
    assert hmm.hmm_scores(table(DOCS, [])).count() == 0
    only = next(i for i in range(100) if held(i))
    r = hmm.hmm_scores(table(DOCS, [(only, "nothing to learn from")])).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 5) and math.isfinite(r.score)


def test_forward_is_exact_and_baum_welch_climbs():
    rng = np.random.default_rng(0)
    share = np.full(hmm.SYMBOLS, 1 / hmm.SYMBOLS)
    model = hmm.maximised(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)) * 9, rng.random((hmm.SYMBOLS, hmm.STATES)), share)
    seqs = [rng.integers(0, 6, n) for n in (1, 5, 3, 40, 2)]
    sizes, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    for got, s in zip(hmm.forward(model, flat, sizes), seqs, strict=True):
        a = model.start * model.emit[s[0]]
        for x in s[1:]:
            a = (a @ model.move) * model.emit[x]
        assert abs(got - math.log(a.sum())) < 1e-9
    starts, moves, emits = hmm.expected(model, flat, sizes)
    assert abs(starts.sum() - 5) < 1e-4 and abs(moves.sum() - (sizes - 1).sum()) < 1e-3 and abs(emits.sum() - sizes.sum()) < 1e-3
    before = hmm.forward(model, flat, sizes).sum()
    for _ in range(5):
        model = hmm.maximised(*hmm.expected(model, flat, sizes), share)
        after = hmm.forward(model, flat, sizes).sum()
        assert after > before - 1e-6
        before = after
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)


def test_model_beats_unigrams_on_held_out_texts(spark):
    got = hmm.hmm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)


# ---- op7


def test_url_parts_and_rules(table):
    cases = {
        "https://A.Example.NET/en/1?x=/y#z": ("a.example.net", "/en/1", "example.net/en/"),
        "http://example.net": ("example.net", "", None),
        "http://example.net/de/": ("example.net", "/de/", "net/"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None),
        "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/"),
        "HTTPS://b.org/fr/?a=://c": ("b.org", "/fr/", "org/fr/"),
        "a/b://C.ORG#/fr/": ("c.org", "", None),
        "http://é.org/fr/ü": ("é.org", "/fr/ü", "org/fr/"),
        "no scheme": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://x.org/" + "y" * 30_000: ("x.org", "/" + "y" * 30_000, None),
    }
    rows = [(i, u) for i, u in enumerate(cases)] + [(None, None), (0, next(iter(cases)))]
    got = urls.verdicts(table("page_id long, url string", rows)).collect()
    assert len(got) == len(rows)
    given = dict(rows[: len(cases)])
    verdict = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    for r in got:
        host, path, rule = cases[given.get(r.page_id)]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict.get(rule, "block" if r.score < urls.BLOCK_BELOW else "allow")
    assert urls.verdicts(table("page_id long, url string", [])).count() == 0


def test_regression_tells_words_it_was_not_shown(table):
    bad = ["http://lucky-casino-slots.example.org/en/1", "http://poker-bets.example.com/en/2", "http://cheap-viagra-pills.example.com/"]
    good = ["http://harbour-museum.example.org/en/1", "http://garden-notes.example.com/en/2", "http://science-library.example.com/"]
    rows = [(i, u) for i, u in enumerate(bad + good)]
    got = {r.page_id: r.verdict for r in urls.verdicts(table("page_id long, url string", rows), rules=()).collect()}
    assert [got[i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3


# ---- op8


def test_leaks_are_the_planted_passages(spark, table):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, ". ".join(prose(rng.randrange(6, 20)) for _ in range(3)) + ".") for i in range(20)] + [(90, None), (91, ""), (92, " \n")]
    docs, want = [], set()
    for i in range(200):
        text = prose(rng.randrange(10, 300))
        if i % 10 == 0:
            k = rng.randrange(20)
            passage = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: some words replaced, case changed
                for at in rng.sample(range(len(passage)), len(passage) // 10):
                    passage[at] = word()
                passage = [w.upper() for w in passage]
            text = " ".join([*text.split()[:50], *passage, *text.split()[50:]])
            want.add((i, k))
        docs.append((i, text))
    docs += [(None, items[3][1]), (7, None), (8, ""), (300, LONG + " " + items[4][1]), (300, LONG + " " + items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(table(DOCS, docs), bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted([*((str(a), b) for a, b in want), ("None", 3), ("300", 4), ("300", 4)])
    kept = decontaminate.drop_leaked(table(DOCS, docs), bench)
    assert kept.count() == len(docs) - len(want) - 3
    assert kept.columns == table(DOCS, docs).columns
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(table(DOCS, docs[:3]), empty).count() == 0
    assert decontaminate.drop_leaked(table(DOCS, docs[:3]), empty).count() == 3
    assert decontaminate.leaks(table(DOCS, []), bench).count() == 0


def test_latent_space_counts_every_text(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('common w', id) AS text")
    term = decontaminate.Cut.of(pa.array([b"common"], pa.large_binary())).terms[0]
    space = decontaminate.latent_space(docs)
    assert space.df[term] >= 40_000 and space.df.sum() >= 79_000


def test_leaks_of_the_tables_like_shared_runs_of_words(spark):
    """Every document with eight words of an item in a row is found, no other."""
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    runs = set()
    for r in bench.collect():
        ws = (r.text or "").lower().split()
        runs |= {tuple(ws[i : i + 8]) for i in range(len(ws) - 7)}
    want = set()
    for r in docs.collect():
        ws = (r.text or "").lower().split()
        if any(tuple(ws[i : i + 8]) in runs for i in range(len(ws) - 7)):
            want.add(r.doc_id)
    assert {r.doc_id for r in decontaminate.leaks(docs, bench).collect()} == want


def test_windows_near_an_item_come_with_row_and_bounds():
    """Segments are summed as by reduceat; a candidate names its row and the words to compare, inside the row."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(300)]
    item = words[40:76]
    rows = [words[:n] for n in (0, 1, 12, 13, 24, 25, 300)] + [words[200:] + item + words[:30]]
    cut = decontaminate.Cut.of(pa.array([" ".join(r).encode() for r in rows], pa.large_binary()))
    vectors = rng.standard_normal((decontaminate.TERMS, 20), dtype=np.float32)
    # bit for bit, so that cosines do not depend on how segments are summed
    assert (cut.sums(vectors) == np.add.reduceat(vectors[cut.terms], cut.starts, axis=0)).all()
    items = decontaminate._items([{"item_id": 1, "text": " ".join(item)}])
    finder = decontaminate.Finder(items, decontaminate.Space(vectors, np.ones(decontaminate.TERMS, np.int64)))
    got = list(finder.candidates(cut))
    assert {row for row, *_ in got} == {6, 7}
    for row, i, a, b, cos in got:
        assert i == 0 and cos >= decontaminate.COSINE and cut.first[row] <= a < b <= cut.first[row + 1]
    hashes = finder.items[0].words
    assert all(any(set(hashes) <= set(cut.hashes[a:b].tolist()) for row, _, a, b, _ in got if row == r) for r in (6, 7))


def test_leak_of_a_passage_that_a_third_of_the_documents_share(spark, table):
    sf = "/root/testdata/sf0.01"
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 0")
    passage, docs, want = bench.first().text.split(), [], []
    for i, (_, text) in enumerate(texts[:600]):
        words = (text or "").split()[:200]
        if i % 3 == 0:
            at = len(words) * (i % 7) // 6
            words[at:at] = passage
            want.append(i)
        docs.append((i, " ".join(words)))
    docs = table(DOCS, docs).repartition(4).cache()
    found = {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
    assert found >= set(want) and len(found) <= len(want) + 2
    assert decontaminate.drop_leaked(docs, bench).count() == 600 - len(found)


def test_leaks_of_short_and_long_items(spark, table):
    """Copies of items of any length are found in prose, scattered words of a short one are not."""
    sf = "/root/testdata/sf0.01"
    texts = [r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text]
    pool = [t for t in texts if len(t) > 700]
    for n in (6, 10, 12, 500):
        items = [(k, " ".join(pool[k][k * 7 : k * 7 + n])) for k in range(20)]
        docs = []
        for i in range(120):
            words = texts[500 + i][:400]
            at = len(words) * (i % 11) // 10
            docs.append((i, " ".join([*words[:at], *items[i % 20][1].split(), *words[at:]])))
        found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(table(DOCS, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
        assert found >= {(i, i % 20) for i in range(120)}
    short = [(0, "Who wrote it?"), (1, "Name the oldest river of all")]
    apart = " ".join(f"{w} " + " ".join(f"f{j}{k}" for k in range(7)) for j, w in enumerate("who wrote it? name the oldest river of all".split()))
    items = decontaminate._items([{"item_id": i, "text": t} for i, t in short])
    shared = decontaminate.Shared(items, np.zeros(decontaminate.TERMS, np.int64))
    look = lambda text: {w[1] for w in shared.windows(decontaminate.Cut.of(pa.array([text.encode()], pa.large_binary())))}
    assert look(apart) == set()
    assert look(f"{apart} who wrote it? and name the oldest river of all") == {0, 1}


def test_bad_bytes_leave_the_case_of_their_neighbours_alone(spark, table):
    texts = ["ÀB Σ".encode(), b"Ab \xff\xc3 \xc3\x89C\xe2\x82", b"", b"PLAIN"]
    got = decontaminate.lowered(pa.array(texts, pa.large_binary())).to_pylist()
    assert got == ["àb σ".encode(), b"ab \xff\xc3 \xc3\xa9c\xe2\x82", b"", b"plain"]
    item = "Which old bridge crossed the slow river behind the town hall? The narrow stone one."
    rows = [(1, item.upper()), *((i, f"some other words of text {i} stand here") for i in range(2, 20))]
    docs = table(DOCS, rows).selectExpr("doc_id", "if(doc_id = 9, cast(X'41FF42C3' AS string), text) AS text").coalesce(1)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate._masks(a), len(a), b) == rows[-1][-1]


# ---- op5


def test_trees_fit_and_generalise():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)) & (x[:, 2] < 0.9)
    model = boosting.fit(x[:3000], y[:3000].astype(int))
    assert ((model(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    one = boosting.fit(x[:50], np.ones(50, int))
    assert (one(x) > 0).all()


def test_pages_keep_the_article_only(table):
    prose = "The river rose in the night &amp; the town\n  was <b>quiet</b>ly\twaiting for&nbsp;news of it. "
    want = "The river rose in the night & the town was quietly waiting for news of it."
    page = (
        "<!DOCTYPE html><html><head><title>Head</title><style>p{}</style><script>var a='</p><p>no';</script></head><body>"
        "<header class='site-header'><h2>Site</h2></header><nav><ul><li><a href='/a'>Menu</a></li><li><a href='/b'>Other</a></li></ul></nav>"
        f"<div class=\"cookie-banner\"><p>We use cookies.</p></div><!-- no --><article><h1>Title here</h1><p>{prose}<p>Next<br>line &#233;.</p>"
        f"<div class='ad'>Buy now</div><p>{prose}</p></article><aside class='sidebar'><p>Related {prose}</p></aside>"
        f"<section id='comments'><div class='comment'><p>First! {prose}</p></div></section><form><input><label>Name</label></form>"
        "<footer>&copy; site</footer>"
    )
    rows = [(1, "u", page + "</body></html>"), (2, None, None), (3, "", ""), (None, "u", page), (1, "u", page), (4, "u", "plain text only"), (5, "u", "<p " * 5000)]
    df = table("page_id long, url string, html string", rows)
    got = html.main_texts(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id in (1, None):
            assert r.text == f"Title here {want} Next line é. {want}"
        elif r.page_id in (2, 3):
            assert r.text == ""
    assert html.main_texts(table("page_id long, url string, html string", [])).count() == 0


def test_elements_without_end_tag_do_not_swallow_the_page():
    words = lambda page: " ".join(run for node in html.parse(page) for _, run in node.runs)
    after = "<article><h1>Title</h1><p>The river rose.</p></article>"
    left = "Title The river rose."
    for before in (
        "<form><input list=x><datalist id=x><option value=a><option value=b>B</datalist></form>",
        "<datalist id=x><option value=a>A",
        "<option value=a>A<option value=b>B",
        "<div><select><option>A<option>B</div>",
        "<div><button>Menu</div>",
        "<button>Menu",
        "<button>Menu <b>now</b>",
        "<div><button>Menu<svg><path/></div>",
        "<div><object data=x>No<video src=y>No</div>",
        "<svg><g><path d=z>",
        "<button><p>Menu</p><h3>Open</h3></button>",
        "<div><object>No<object><p>no</p></object><p>no</p></object></div>",
        "<svg/><button/>",
    ):
        assert words(f"<html><body>{before}{after}</body></html>") == left, before
    assert words(f"<body><div><button><div>Menu</div></div>{after}") == f"Menu {left}"
    assert words(f"<body><button>Menu{after}<p>See <button>Share</button> it.</p>") == f"{left} See it."
    assert words("<p>See <svg><title>t</title><text>no</text></svg>it") == "See it"
    many = "<svg><button><object>" * 20_000
    assert words(f"<body>{many}{after}") == left


def test_names_that_the_trees_have_not_seen_say_nothing():
    """An article's blocks are judged the same under any unknown class, and known names do not share a column."""
    prose = "The river rose in the night and the town was quietly waiting for news of it. " * 3
    rows = {}
    for name in ("qzqz", "intro", "single", "rich", "primary", "news", "hentry", "chapter", "lede"):
        rows[name] = html.features(html.parse(f"<body><div class='{name}'><h1>Title</h1><p class='{name}'>{prose}</p></div></body>"))
        assert (rows[name] == rows["qzqz"]).all(), name
    at = lambda name: html.features(html.parse(f"<body><div class='{name}'><p>{prose}</p></div></body>")).tobytes()
    known = [re.split("[^a-z]", n) for n in (*html.CONTENT, *(n for kind in html.PARTS.values() for n in kind))]
    known = {w for ws in known for w in ws}
    assert len({at(w) for w in known}) == len(known)
    model = boosting.fit(*html.labelled([], 250))
    page = f"<body><div class='menu'><a href=x>Menu</a></div><div class='intro single'><h1>Title</h1><p class='news'>{prose}</p></div></body>"
    nodes = html.parse(page)
    assert prose.strip() in html.main_text(nodes, html.decode(nodes, model(html.features(nodes))))


def test_written_pages_held_out():
    """Blocks of pages that the trees have not seen are told apart, and no choice contradicts an ancestor's."""
    model = boosting.fit(*html.labelled([], 250))
    rng, right, all_ = random.Random(77), 0, 0
    for _ in range(60):
        source = html._Writer(rng, []).page()
        nodes = html.parse(source)
        keep = html.decode(nodes, model(html.features(nodes)))
        marks = iter(int(m) for m in html._GOOD.findall(source))
        for i, node in enumerate(nodes):
            good = next(marks) if node.tag not in ("html", "body") else None
            assert node.parent < 0 or keep[node.parent] or not keep[i]
            if good is not None and node.runs:
                right, all_ = right + (bool(keep[i]) == bool(good)), all_ + 1
    assert right / all_ > 0.95


def test_table_pages_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html as h

    for r, p in zip(sorted(html.main_texts(pages).collect()), sorted(pages.collect()), strict=True):
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = (" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == " ".join(b for b in blocks if b)
