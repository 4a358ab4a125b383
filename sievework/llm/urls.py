"""URL verdicts: the longest fitting rule, else logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features and lengths of the n-grams.
FEATURES, GRAMS = 1 << 14, (3, 4, 5)
#: A URL is blocked by the model if its probability of being wanted is lower: only clear cases.
BLOCK_BELOW = 0.2

#: The small labelled table: words that name unwanted and wanted hosts or sections, each set into the same URLs.
UNWANTED = (
    "adult", "ads", "adserver", "banner", "bet", "bets", "betting", "bingo", "bonus", "casino", "cheap", "cheap-pills", "click",
    "clicks", "coupon", "crack", "dating", "escort", "farm", "free-bets", "gamble", "jackpot", "keygen", "lottery", "loans", "malware",
    "payday", "pharmacy", "phish", "pills", "poker", "popup", "porn", "prize", "promo", "replica", "roulette", "sex", "slots", "spam",
    "spam-farm", "spyware", "torrent", "track", "tracker", "tracking", "viagra", "warez", "win", "win-cash", "xxx", "x-cams",
)
WANTED = (
    "about", "academy", "archive", "article", "art", "blog", "books", "city", "college", "community", "cooking", "culture", "daily",
    "data", "developer", "docs", "education", "encyclopedia", "engineering", "essays", "events", "forum", "garden", "gazette",
    "geography", "government", "guide", "health", "help", "history", "home", "institute", "journal", "kitchen", "learn", "letters",
    "library", "magazine", "mail", "manual", "maps", "math", "media", "museum", "music", "nature", "news", "notes", "open", "papers",
    "people", "photos", "physics", "poetry", "press", "project", "public", "recipes", "reference", "research", "review", "school",
    "science", "shop", "society", "sports", "station", "stories", "study", "support", "teacher", "the-times", "theatre", "today",
    "travel", "tutorial", "university", "village", "weather", "wiki", "world", "writing",
    "anderson", "ashford", "bathory", "berlin", "brighton", "bristol", "canterbury", "dresden", "eastern", "edinburgh", "essen",
    "granada", "hamilton", "hannover", "hathaway", "heidelberg", "johnson", "lancaster", "leipzig", "lyon", "madrid", "marston",
    "montreal", "nantes", "northern", "ontario", "orleans", "oxford", "paris", "portland", "preston", "reading", "rennes", "salamanca",
    "sheffield", "sherwood", "southern", "stratton", "sutherland", "thornton", "toulouse", "trenton", "valencia", "western", "weston",
    "whitby", "winchester", "yorkshire", "theresa", "matthew", "heather", "timothy", "elizabeth", "thetford", "athens", "bethany",
    "keith", "edith", "ethan", "judith", "martha", "dorothy", "nathan", "smith", "worth", "north", "earth", "month", "youth",
)
URLS = (
    "https://{0}.example.com/en/1", "http://www.{0}.example.org/de/22.html", "https://m.{0}.example.net/fr/333/",
    "https://blog.{0}.example.com/es/4", "https://my-{0}.example.org/", "http://www.{0}-online.example.net/en/55",
)


def labelled() -> list[tuple[str, float]]:
    """(url, 1 if wanted)."""
    return [(u.format(w), label) for words, label in ((UNWANTED, 0.0), (WANTED, 1.0)) for w in words for u in URLS]


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits this host and all its subdomains
    path: str  # what the path starts with

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    """From the end of the host up to a question mark, hash or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does; of equally long ones the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.text)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _grams(text: Column, n: int, mark: str) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), text.substr(i, F.lit(n))))


def grams(host: Column, path: Column) -> Column:
    """The distinct n-grams of the host and of the path, each between two marks, told apart by a letter."""
    sides = [(mark, F.concat(F.lit("^"), part, F.lit("$"))) for mark, part in (("h", host), ("p", path))]
    return F.array_distinct(F.concat(*(_grams(text, n, mark) for mark, text in sides for n in GRAMS)))


def verdicts(
    pages: DataFrame, rules: Sequence[Rule] = RULES, table: Sequence[tuple[str, float]] = (), id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Every row of ``pages``: page_id, host, path, rule, verdict, and ``score``, the model's probability of allow.

    A rule decides the URLs it fits.  The rest is decided at 0.2 by logistic regression on the hashed
    n-grams of host and path, learned from ``table`` (url, 1 if wanted), by default ``labelled()``.  The table is given with
    the call, so it is small at any size of ``pages``; both kinds of label must occur.

    A null URL or one without :// has an empty host and path, fits no rule and is judged like a URL without
    known n-grams.  Repeated rows and ids are judged alike; an empty table gives no rows; other
    columns are not read.  No shuffle.
    """
    spark = pages.sparkSession
    tf = HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True)
    with_grams = lambda df: tf.transform(df.withColumn("grams", grams(F.col("host"), F.col("path"))))
    small = spark.createDataFrame(list(table) or labelled(), "url string, label double").coalesce(1)
    small = with_grams(small.select("label", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")))
    model = LogisticRegression(maxIter=50, regParam=0.003).fit(small.select("label", "features"))

    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    name, ruled = fitting(rules, F.col("host"), F.col("path"))
    judged = model.transform(with_grams(parsed.withColumn("rule", name).withColumn("ruled", ruled)))
    judged = judged.withColumn("score", vector_to_array("probability")[1])
    by_model = F.when(F.col("score") < BLOCK_BELOW, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
