"""URL filters: rules on host and path, then logistic regression on hashed character n-grams.

The model is trained from a small table of labelled URLs (a parameter; ``LABELLED`` by default, at
most ``MOST_LABELLED`` rows) by full-batch gradient descent from zero, so it is the same every time. A
URL's features are the distinct character n-grams of its host, with label edges, and of its path,
hashed into ``BUCKETS``, either set scaled to length 1; digits count as one character. Pages are judged in one scan.

The default table is put together by rule (``labelled_urls``): words, hyphens, prefixes, top-level domains and paths are
drawn independently of the label, which is 1 where the host or the path holds a word of the kind to block. Made-up names
without meaning are labelled 0, so that the method allows what it does not know. tests/llm holds out
words in new hosts and paths and states precision and recall.

Null URLs and URLs without ``://`` have an empty host and path; no rule fits them, and the method
allows what has no feature. The longest fitting rule wins (then the longest host, then block). Repeated urls are
judged alike, each in its row; very long ones whole.
"""

from __future__ import annotations

import re
import zlib
from random import Random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
MOST_LABELLED = 20_000
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# General words of hosts and paths to block, and of others.
_BLOCK = """casino poker roulette blackjack jackpot slots lottery betting bets bookmaker wager gambling bingo prize winner
pills viagra cialis meds pharmacy steroids slimming porn xxx sex adult nude escort hentai camgirls hookup erotic
ads adserver advert banner popup tracker tracking clicks affiliate doubleclick payday loans forex crypto doubler
replica fakes warez crack keygen torrents malware phishing spam followers clickbait cheap free""".split()
_ALLOW = """news weather library museum garden station history science gazette journal university school recipes cooking
travel railway harbour mountain river theatre music gallery archive forum wiki docs handbook atlas orchestra county
council hospital clinic bakery bookshop teacher student notes physics therapy other stones forest island bridge winter
summer city health media press letters code data maps open world daily times church parish village club sport football
art design studio kitchen farm energy water solar street market bank law court police fire safety research institute
college academy books reading writing language english french german spanish culture heritage nature birds animals""".split()
_FRONTS = ("", "", "www.", "m.", "blog.", "en.", "shop.", "cdn.")
_ENDS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "co.uk", "example.com", "example.org", "example.net")


def labelled_urls(seed: int = 7, rounds: int = 24) -> list[tuple[str, int]]:
    """(url, 1 to block): every word to block in ``rounds`` hosts and as many paths, and some more URLs of other words and
    of made-up names; everything else is drawn by the same rule for both labels."""
    draw = Random(seed)
    onsets = [*"bcdfghjklmnprstvwxyz", "th", "st", "br", "ch", "pr", "tr", "sh", "wh", "cl", "gr", "pl", "sp", "qu", ""]
    syllables = [c + v + e for c in onsets for v in ("a", "e", "i", "o", "u", "ea", "ou") for e in ("", "", "n", "r", "s", "nd", "ng", "st", "l", "th")]

    def plain() -> str:
        return draw.choice(_ALLOW) if draw.random() < 0.4 else "".join(draw.choices(syllables, k=draw.randrange(1, 4)))

    def name(*words: str) -> str:
        return draw.choice(("", "-", "-")).join(draw.sample(words, len(words)))

    def host(*words: str) -> str:
        return f"{draw.choice(_FRONTS)}{name(*words)}.{draw.choice(_ENDS)}"

    def path(*words: str) -> str:
        parts = [draw.choice(("en", "de", "fr", "es", plain(), str(draw.randrange(3000)))) for _ in range(draw.randrange(3))]
        if words:
            parts.insert(draw.randrange(len(parts) + 1), name(*words))
        return "/" + "/".join(parts) + draw.choice(("", "/", ".html"))

    def some(count: int) -> list[str]:
        return [plain() for _ in range(count)]

    out = []
    for word in _BLOCK:
        for _ in range(rounds):
            out.append((f"https://{host(word, *some(draw.randrange(2)))}{path()}", 1))
            out.append((f"https://{host(*some(draw.randrange(1, 3)))}{path(word, *some(draw.randrange(2)))}", 1))
    for _ in range(2 * len(out)):
        out.append((f"https://{host(*some(draw.randrange(1, 3)))}{path(*some(draw.randrange(3)))}", 0))
    return out


LABELLED = labelled_urls()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))), F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule's host ends at its first /."""
    listed = F.array(*(
        F.struct(
            F.lit(len(rule)).alias("n"), F.lit(len(rule.partition("/")[0])).alias("h"), F.lit(verdict == "block").alias("b"),
            F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
            F.lit(rule.partition("/")[0]).alias("host"), F.lit("/" + rule.partition("/")[2]).alias("path"),
        )
        for rule, verdict in rules
    ))
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.array_max(fits)


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct n-grams of 3 to 5 characters, and their values: the host's and the path's share length 1 each."""
    at, value = [], []
    for kind, text in (("h", f".{host}." if host else ""), ("p", path)):
        text = re.sub(r"\d+", "0", text)
        found = {
            zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in (3, 4, 5) for i in range(len(text) - n + 1)
        }
        at += sorted(found)
        value += [max(1, len(found)) ** -0.5] * len(found)
    return np.array(at, np.int64), np.array(value)


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.lower(), re.match(r"[^?#]*", rest[len(host):])[0]


def train(labelled: list[tuple[str, int]], steps: int = 800, rate: float = 2.0, penalty: float = 3e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept of the regression on the features' unit vectors."""
    if len(labelled) > MOST_LABELLED:
        raise ValueError(f"the labelled table is meant to be small: at most {MOST_LABELLED} rows")
    weights, intercept = np.zeros(BUCKETS), 0.0
    rows = [(features(*_split(u)), y) for u, y in labelled if u]
    if not rows:
        return weights, -1.0
    at, value = (np.concatenate([x[i] for x, _ in rows]) for i in (0, 1))
    of = np.repeat(np.arange(len(rows)), [len(x[0]) for x, _ in rows])
    y = np.array([y for _, y in rows], float)
    speed, ahead = np.zeros(BUCKETS), 0.0
    for _ in range(steps):  # full gradients with momentum
        p = 1 / (1 + np.exp(-(np.bincount(of, weights[at] * value, len(rows)) + intercept)))
        wrong = p - y
        speed = 0.9 * speed - rate * (np.bincount(at, wrong[of] * value, BUCKETS) / len(rows) + penalty * weights)
        ahead = 0.9 * ahead - rate * wrong.mean()
        weights, intercept = weights + speed, intercept + ahead
    return weights, float(intercept)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] = LABELLED, block_from: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, score) of ``pages`` (id, url); score is the model's probability to block."""
    weights, intercept = train(labelled)

    @F.pandas_udf("double")
    def score(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for host, path in zip(hosts, paths):
            at, value = features(host, path)
            out.append(float(1 / (1 + np.exp(-(weights[at] @ value + intercept)))) if len(at) else 0.0)
        return pd.Series(out, dtype="float64")

    url = F.col("url")
    host, path = split_url(url)
    rows = pages.select("id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("score", score("host", "path"))
    found = rule_of(F.col("host"), F.col("path"), rules) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    verdict = F.coalesce(found["verdict"], F.when(F.col("score") >= block_from, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("id", "host", "path", found["rule"].alias("rule"), verdict.alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("id"), "url")
    return judge(pages).withColumnRenamed("id", "page_id")
