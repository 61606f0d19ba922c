"""URL filters: allow/block rules by host and path, and a logistic regression for the rest.

A url's host runs from the first ``://`` to ``/``, ``?``, ``#`` or the end
(A-Z lower-cased), its path from there to ``?``, ``#`` or the end.  A rule
``host/path`` fits its host and all subdomains where the path starts with the
rule's; the longest fitting rule decides (of equal length the one that sorts
last).  Urls without a rule are judged by a logistic regression on hashed
character n-grams of host and path, trained in numpy from a small labelled
url table.  Scoring is an expression over the url column: no shuffle, no
Python; the weights (``BUCKETS`` numbers) and the rules (at most
``MAX_RULES``) are literals of the plan.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged on no n-grams, by the intercept; rows that repeat
are judged alike, each for itself; other columns and ids are carried along;
an empty table gives an empty result; without labels of both kinds the
regression has weight zero and the verdict is allow.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, col, fresh

BUCKETS = 4096
GRAMS = (3, 4)
MAX_RULES = 10_000
#: Bound of the labelled table: at most so many rows are fitted on.
MAX_LABELLED = 20_000
ROUNDS, STEP, MOMENTUM, PENALTY = 300, 3.0, 0.9, 1e-4
#: Two of three labels are harmless, so names in doubt are blocked from somewhat less than one half on.
BLOCK_AT = 0.4

#: Words of harmful names, by the usual kinds of block lists (gambling, medicine, adult, money, counterfeits, piracy,
#: advertising, fraud), and words of harmless ones, by the kinds of a web directory.
_HARMFUL_WORDS = """casino poker slots jackpot roulette blackjack baccarat bingo bookmaker sportsbook bet bets betting wager odds lottery lotto
 gambling gamble bonus win winner winning spin lucky vegas
 pills pill pharma pharmacy viagra cialis levitra tramadol xanax valium meds medication rx steroids testosterone diet slimming
 weightloss keto detox miracle cure botox enlargement
 adult xxx porn porno sex sexy cams webcam nude naked escort escorts hookup dating milf teen fetish erotic hentai camgirl
 loan loans payday cash cashback debt credit refinance forex crypto bitcoin ethereum doubler profit profits rich millionaire earn
 income invest trading binary airdrop
 cheap discount outlet replica rolex gucci fake knockoff wholesale clearance coupon
 warez crack cracked keygen serial nulled torrent torrents pirate free freebies download downloader streamz mp3
 ads adserver adclick banner banners popunder popup track tracker tracking pixel click clicks clickbait affiliate traffic seo
 backlinks spam spammer farm linkfarm bulk mailer
 phish phishing verify verification login signin password unlock suspended update account wallet refund invoice prize
 prizes giftcard giveaway claim reward rewards survey deal deals hot girls instant guaranteed urgent limited exclusive""".split()
_HARMLESS_WORDS = """library university school college news daily times herald weather climate museum gallery art music opera theatre
 recipes kitchen bakery coffee garden flowers history archive science physics chemistry biology maths research journal docs wiki
 manual guide travel hotel rail airport city council county village sussex essex middlesex parish church charity hospital clinic
 doctor nurse dental health pharmacist law court justice parliament government office tax post bank insurance energy water
 electric motor cycle bike run runner football cricket tennis rugby swim sailing mountain river forest lake farmers field bird
 animal horse dog cat vet design studio print paper book books reader writer poetry letters language dictionary alphabet better
 address advice adventure tracks railtrack credits classic shop store market furniture wood metal tools engineering software
 code data cloud open source linux kernel python forum community people family children toys games chess puzzle photo camera film
 cinema radio green blue north south east west old new first world national royal house home street bridge tower harbour
 freedom window winter wine winchester spinach pillow pillar hotpot dealer castle click-clack steel stone glass""".split()
_SHARED_PATHS = ("", "/", "/index.html", "/about", "/contact", "/search?q=a", "/p/{n}", "/{n}", "/item/{n}", "/en/{n}", "/de/{n}/", "/fr/{n}.html",
                 "/blog/{n}", "/2021/06/{n}", "/category/a/{n}", "/page/{n}.html", "/user/{n}", "/news/{n}", "/view?id={n}")
_HARMFUL_PATHS = ("/buy-now", "/win/free-bonus", "/cheap/pills.html", "/xxx/cams", "/casino/spin", "/loan?now=1", "/signup-bonus", "/click/{n}")
_ENDINGS = ("com", "net", "org", "info", "co.uk", "de", "fr", "io", "example.com", "example.net", "example.org", "site")
LABELLED_NAMES = 800  # harmful ones; there are twice as many others
#: Share of names of two words whose words a hyphen joins: harmful names have more of them.
_HYPHENS = {1: 0.6, 0: 0.15}


def example_labels(without: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """A labelled url table (1: block) of made-up names, two urls for each: harmful and harmless ones of one or
    two words, and harmless ones that mean nothing.  Both kinds have the same hosts' shapes, endings and
    mostly the same paths, so that names decide.  Names are drawn from word lists alone; with ``without``,
    no harmful name has one of these words, which is how recall on unseen words is measured."""
    rng, out = random.Random(1), []

    def urls(name: str, label: int) -> None:
        for _ in range(2):
            host = rng.choice(("", "www.", "blog.", "m.", "shop.", "my.")) + name + "." + rng.choice(_ENDINGS)
            path = rng.choice(_HARMFUL_PATHS if label and rng.random() < 0.2 else _SHARED_PATHS)
            out.append((f"http{rng.choice(('', 's'))}://{host}{path.format(n=rng.randint(1, 9999))}", label))

    def compound(words: list[str], label: int) -> str:
        return ("-" if rng.random() < _HYPHENS[label] else "").join(rng.sample(words, rng.choice((1, 2, 2))))

    def nonsense() -> str:
        return "".join(rng.choice((*"bcdfghjklmnprstvwz", "ch", "sh", "th", "st", "br", "tr", "gl")) + rng.choice(("a", "e", "i", "o", "u", "an", "er", "ing", "ou", "ea", "in", "on"))
                       for _ in range(rng.randint(2, 4)))

    harmful = [w for w in _HARMFUL_WORDS if w not in without]
    for _ in range(LABELLED_NAMES):
        urls(compound(harmful, 1), 1)
        urls(compound(_HARMLESS_WORDS, 0), 0)
        urls(nonsense(), 0)
    return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """Struct (size, rule, verdict) of the deciding rule, or null.

    Only the host's last labels can name a rule, as many as the longest rule has,
    so the work on a url does not grow with the number of rules.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules.items():
        if "/" not in rule or verdict not in ("allow", "block"):
            raise ValueError(f"bad rule {rule!r}: {verdict!r}")
        name, _, _ = rule.partition("/")
        by_host.setdefault(name, []).append((rule[len(name):], rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,path:string>")
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*[
        F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
        for p, r, v in own]))])
    labels = max(name.count(".") + 1 for name in by_host)
    none = F.array().cast("array<struct<size:int,rule:string,verdict:string,path:string>>")
    known = F.flatten(F.array(*[F.coalesce(F.try_element_at(table, F.substring_index(host, ".", -k)), none)
                                for k in range(1, labels + 1)]))
    return F.array_max(F.filter(known, lambda r: F.startswith(path, r["path"])))


def url_grams(host: Column, path: Column) -> Column:
    """Buckets of the hashed character n-grams of host and path."""
    def grams(text, mark, n):
        places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[grams(text, mark, n) for text, mark in ((host, "host"), (path, "path")) for n in GRAMS])


def fit_urls(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> tuple[float, np.ndarray]:
    """Intercept and bucket weights by gradient descent with momentum on the labelled table."""
    check_columns(labelled, url_col, label_col)
    url = col(url_col).cast("string")
    rows = (labelled.where(col(label_col).isin(0, 1)).orderBy(F.xxhash64(url), url, col(label_col)).limit(MAX_LABELLED)
            .select(url_grams(host_of(url), path_of(url)).alias("g"), col(label_col).cast("int").alias("y")).collect())
    rows.sort(key=lambda r: (r["y"], r["g"]))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return (-1.0, np.zeros(BUCKETS))
    x = np.stack([np.bincount(r["g"], minlength=BUCKETS) / max(1, len(r["g"])) for r in rows]).astype(np.float32)
    x *= 10  # about one for a bucket that holds a tenth of the n-grams
    bias, w = 0.0, np.zeros(BUCKETS, np.float32)
    moved, shift = np.zeros(BUCKETS, np.float32), 0.0
    for _ in range(ROUNDS):
        gap = (y - 1 / (1 + np.exp(-(x @ w + bias)))).astype(np.float32)
        moved = MOMENTUM * moved + STEP * (gap @ x / len(y) - PENALTY * w)
        shift = MOMENTUM * shift + STEP * float(gap.mean())
        w, bias = w + moved, bias + shift
    return bias, w.astype(float) * 10


def block_chance(host: Column, path: Column, model: tuple[float, np.ndarray]) -> Column:
    bias, w = model
    weights = F.array(*[F.lit(float(round(v, 9))) for v in w])
    grams = url_grams(host, path)
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.element_at(weights, g + 1))
    return 1 / (1 + F.exp(-(F.lit(bias) + total / F.greatest(F.size(grams), F.lit(1)))))


def filter_urls(pages: DataFrame, rules: dict[str, str], model: tuple[float, np.ndarray], url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and block_chance; clashing names get leading underscores."""
    check_columns(pages, url_col)
    host, path, best, chance = fresh(pages, "host", "path", "best", "chance")
    url = col(url_col).cast("string")
    judged = (pages.select("*", host_of(url).alias(host), path_of(url).alias(path))
              .select("*", matching_rule(col(host), col(path), rules).alias(best),
                      block_chance(col(host), col(path), model).alias(chance)))
    taken = {c.lower() for c in pages.columns}
    out = {"host": col(host), "path": col(path), "rule": col(best)["rule"],
           "verdict": F.coalesce(col(best)["verdict"], F.when(col(chance) >= BLOCK_AT, "block").otherwise("allow")),
           "block_chance": col(chance)}
    return judged.select(*[col(c) for c in pages.columns],
                         *[v.alias(k if k not in taken else f"_{k}") for k, v in out.items()])
