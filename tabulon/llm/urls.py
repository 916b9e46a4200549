"""URL filter: host and path rules first, a logistic regression on hashed character n-grams for the rest.

The model is trained from a small labelled table of URLs.  Its features are runs of ``GRAMS`` characters of host and
path (told apart by a mark), hashed into ``PLACES`` places; all of it, the splitting, the hashing, the fitting
and the scoring, is Spark SQL and Spark ML, so no row leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
GRAMS = (3, 4, 5)
PLACES = 1 << 14
FIT_ROWS = 20_000  # labelled rows per task

# Words of unwanted and of plain host names, and the parts around them, of the small labelled table.
UNWANTED = """casino slots jackpot poker bets betting lottery prize winner pills viagra tablets meds diet loans payday cash credit money rich
replica rolex cheap free discount adult cams webcam xxx sexy singles dating torrent warez crack keygen spam links seo followers clicks bonus
offers deals ads tracker promo gambling""".split()
PLAIN = """weather library museum garden news university docs encyclopedia recipes astronomy railway novel archive history standard north health
institute science parliament theatre nation winter region travel book school district kitchen council therapy learning birds market radio
cinema developer eastern city water river mountain music theory nature house people station bridge mention thousand rather other tension
hospital forest painting harbour letters""".split()
STARTS, ENDS = ("", "www.", "m.", "blog."), ("net", "org", "info", "com")
PATHS = ("/en/{}", "/fr/{}.html", "/es/{}/", "/de/{}", "/{}", "/page/{}?id=1")
LABELLED = 240  # rows per label


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, under a path prefix; ``text`` reads like ``example.com/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://`` or for null."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.regexp_extract(url, ADDRESS, 2)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equally long ones the first given); nulls where none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # stable: later and longer ones are asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _grams(letters: str, mark: str) -> Column:
    """Runs of the characters in the array column ``letters``, each with the part's own mark."""
    def runs(k: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(letters) - (k - 1)))
        return F.transform(places, lambda i: F.concat(F.lit(mark), F.array_join(F.slice(F.col(letters), i, k), "")))

    return F.concat(*[runs(k) for k in GRAMS])


def features(df: DataFrame) -> DataFrame:
    """Add the vector ``features`` of the columns ``host`` and ``path``, each between end marks."""
    # characters are a column of their own, so that they are split once per row and not once per run
    split = df.withColumns({f"__{part}": F.split(F.concat(F.lit("^"), F.col(part), F.lit("$")), "") for part in ("host", "path")})
    listed = split.withColumn("__grams", F.array_distinct(F.concat(_grams("__host", "h"), _grams("__path", "p"))))
    counted = HashingTF(numFeatures=PLACES, binary=True, inputCol="__grams", outputCol="features").transform(listed)
    return counted.drop("__host", "__path", "__grams")


def fit(labelled: DataFrame, regularisation: float = 0.0003) -> LogisticRegressionModel:
    """Model of ``labelled`` (url, label: 1 for block, 0 for allow); rows without a label are left out.

    Repeated rows count as often as they occur; null urls have no host and path; with one label only the model
    gives that label; an empty table is refused.
    """
    host, path = host_and_path(F.col("url"))
    rows = features(labelled.where(F.col("label").isNotNull()).select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    n = rows.count()
    if not n:
        raise ValueError("no labelled address")
    rows = rows.coalesce(-(-n // FIT_ROWS))  # a small table needs no more than one task per step
    return LogisticRegression(regParam=regularisation, maxIter=100, standardization=False).fit(rows)


def judged(pages: DataFrame, rules: Sequence[Rule], model: LogisticRegressionModel, block_from: float = 2 / 3) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the rule's verdict, else ``block`` where the model's score is ``block_from`` or more.

    The labelled table holds as many unwanted rows as plain ones, unlike the web, so an address is blocked where unwanted is
    twice as likely; a name unlike any in the table scores near one half and passes.

    ``score`` is the model's probability of ``block``.  Null and malformed urls have empty host and path and are
    left to the model; urls of any length are read whole; repeated rows give repeated results; null ids stay null; other
    columns are left out; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = best_rule(F.col("host"), F.col("path"), rules)
    scored = model.transform(features(split)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("page_id", "host", "path", text.alias("rule"), F.coalesce(
        verdict, F.when(F.col("score") >= block_from, "block").otherwise("allow")).alias("verdict"), "score")


def labelled_rows() -> list[tuple[str, int]]:
    """The labelled table: hosts of two words of a kind, joined by a hyphen mostly (unwanted) or seldom (plain), with like paths."""
    rows = []
    for words, label in ((UNWANTED, 1), (PLAIN, 0)):
        for i in range(LABELLED):
            first, second = words[i % len(words)], words[(7 * i + i // len(words) + 3) % len(words)]
            hyphen = "-" if (i % 4 != 3) == bool(label) else ""
            host = first if i % 5 == 4 else first + hyphen + second
            path = PATHS[i % len(PATHS)].format(37 * i % 1000)
            rows.append((f"http{'s' * (i % 2)}://{STARTS[i // 3 % 4]}{host}.{ENDS[i // 2 % 4]}{path}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table (url, label)."""
    return spark.createDataFrame(labelled_rows(), "url string, label int")
