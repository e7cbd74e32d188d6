"""URL filters with DataFrame functions only: rules by host and path, and for what no rule fits a logistic regression
on hashed character n-grams, trained from a small labelled table of URLs, generated from words of either kind."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The rules, as host, path and verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Words of what is to be blocked, of what is not, and of either; syllables of names that mean nothing.
BAD = "adult porn sex xxx escort cams nude casino poker bingo lottery jackpot gambling betting bets slots pills pharmacy viagra cialis steroids spam phishing malware scam ads adverts banners popups tracker tracking clicks warez crack keygen".split()
GOOD = "news university library weather museum research archive recipes garden council hospital history science journal travel documentation theatre school radio health music sports economy nature books kitchen maps culture village church software engineering law insurance energy railway airport market".split()
EITHER = "best online top super mega my the club world zone city shop web net hub central direct express first global local daily live plus pro".split()
SYLLABLES = "ba ben cor da del en fi gra hol in jo kel la lor ma mir no os pe qui ra sal te un vor wen xa yor zu bri clo dre fla gro ku ny pli rom sten tas vil".split()
#: Subdomains and parts of paths, dealt to hosts of either kind.
SUBDOMAINS = ("", "www.", "m.", "blog.", "shop.")
PATHS = ("", "en/{}", "de/{}.html", "{}/index", "article/{}", "{}", "a/b/{}/", "fr/{}?page=2")


def labelled_urls(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """(url, bad): generated from the fixed words by hashes of the row's number; a third bad by its host, a ninth by its
    path. Names are pairs of words, so that whole hosts of any table at hand are not what is learnt."""

    def made(i: int) -> tuple[str, int]:
        draws = random.Random(i)
        pick, kind = draws.choice, i % 9
        nonsense = "".join(draws.choices(SYLLABLES, k=draws.randint(2, 4)))
        plain = pick((nonsense, f"{nonsense}{pick(('', '-'))}{pick(EITHER)}", f"{pick(GOOD)}{pick(('', '-'))}{pick(EITHER)}", f"{pick(EITHER)}{pick(('', '-'))}{pick(GOOD)}", pick(GOOD)))
        bad = pick((f"{pick(BAD)}{pick(('', '-'))}{pick(EITHER)}", f"{pick(EITHER)}{pick(('', '-'))}{pick(BAD)}", f"{pick(BAD)}-{nonsense}", f"{nonsense}-{pick(BAD)}", f"{pick(BAD)}{pick(BAD)}"))
        path = pick(PATHS).format(pick((draws.randint(1, 99_999), pick(GOOD), nonsense)))
        if kind == 3:
            path = f"{pick(BAD)}/{path}"
        host = f"{pick(SUBDOMAINS)}{bad if kind < 3 else plain}.{pick(('example', 'invalid', 'test'))}{pick(('.org', '.net', '.com', ''))}"
        return f"http{pick(('', 's'))}://{host}/{path}", int(kind < 4)

    return spark.createDataFrame([made(i) for i in range(rows)], "url string, bad int")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none. Null: empty."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _features(host: Column, path: Column, sizes: tuple[int, ...], bits: int) -> Column:
    """Distinct hashed character n-grams of host and path, each set apart by its mark and bounded by ^ and $."""

    def grams(mark: str, part: Column, n: int) -> Column:
        whole = F.concat(F.lit("^"), part, F.lit("$"))
        last = F.greatest(F.length(whole) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substr(whole, i, F.lit(n))), F.lit(1 << bits)).cast("int"))

    return F.array_distinct(F.flatten(F.array(*[grams(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in sizes])))


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4, 5), bits: int = 13, rounds: int = 400, rate: float = 1.0, decay: float = 2e-4, most: int = 10_000) -> list[float]:
    """2**bits weights and a bias last, by full gradient descent. The labelled table must be small: more than `most`
    rows are an error. Its features are made in Spark by the expression that scoring uses; rows with a null don't count."""
    url = F.col("url")
    rows = labelled.where("url is not null and bad is not null").select(_features(host_of(url), path_of(url), sizes, bits).alias("x"), "bad").orderBy("url", "bad").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labelled urls")
    w = np.zeros((1 << bits) + 1)
    if rows:
        n = np.array([len(x) for x, _ in rows])
        at, of = np.concatenate([x for x, _ in rows]), np.repeat(np.arange(len(rows)), n)
        scale, bad = 1 / np.sqrt(n), np.array([bad for _, bad in rows])
        for _ in range(rounds):
            miss = bad - 1 / (1 + np.exp(-w[-1] - scale * np.bincount(of, w[at], len(rows))))
            step = np.r_[np.bincount(at, (miss * scale)[of], len(w) - 1), miss.sum()]
            w += rate * (step / len(rows) * 8 - decay * w)
    return np.round(w, 6).tolist()


def judge(pages: DataFrame, weights: list[float], sizes: tuple[int, ...] = (3, 4, 5), rules: list[tuple[str, str, str]] = RULES, cut: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's probability that the url is bad), a row per row.

    A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest wins, by the length
    of host and path together. Without a rule the verdict is the method's: block from `cut` on. A null url, or one
    without ://, has an empty host and path, fits no rule and is judged by the method. Null ids and repeated rows stay."""
    bits = (len(weights) - 1).bit_length() - 1
    own = pages.select("page_id", F.col("url").alias("u")).select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    first = lambda k: F.coalesce(*[F.when(fits(h, p), F.lit((h + p, v)[k])) for h, p, v in by_length], F.lit(None).cast("string"))
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in weights) + ")")
    x = _features(F.col("host"), F.col("path"), sizes, bits)
    total = F.aggregate("x", F.lit(0.0), lambda s, i: s + F.get(table, i))
    score = 1 / (1 + F.exp(-(total / F.sqrt(F.size("x").cast("double")) + F.lit(weights[-1]))))
    scored = own.withColumn("x", x).withColumn("score", score).drop("x")
    rule, verdict = first(0), first(1)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"), "score")
