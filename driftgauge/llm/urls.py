"""URL filter: rules first, else logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table (at most ``MOST_ROWS`` rows). The default table is made by rule from two
lists of words, by kind of site, and one list of places and paths that both share (``labelled``), so that only words tell. Its weights are whole
numbers of 1/1,000,000, so that sums don't depend on their order. Scoring uses DataFrame functions only: no shuffle,
one narrow pass over the urls.

A url's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; its path what
follows up to ``?``, ``#`` or the end. A null url, or one without ``://``, has both empty. A rule (host, path) fits its host
and all subdomains if the url's path starts with the rule's; the longest rule (host and path together, then the later
one in the alphabet) wins. Urls that no rule fits are blocked if the model's score is 0 or more. Repeated rows and
ties give equal verdicts; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
BASE = 131
SCALE = 1_000_000
#: The share of urls that a crawl is taken to have to block.
PRIOR = 0.3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of hosts that are blocked, by kind: gambling, adult, drugs, loans, piracy, malware, link spam, fakes.
BLOCKED = """casino roulette blackjack poker jackpot slots bingo sportsbook wager gambling baccarat bookmaker
    porn xxx nude escorts camgirls hookup milf hentai fetish stripper
    viagra cialis steroids painkillers slimming detox testosterone pharmacy-deal
    payday loans fast-cash easy-money get-rich forex-signals doubler giveaway prize-winner lottery
    torrent warez crack keygen serials nulled free-movies modapk
    malware spyware phishing ransomware botnet exploit
    linkfarm clickbait popads popunder doorway backlinks adserver traffic-boost
    replica-watches fake-bags counterfeit cheap-rolex""".split()
#: Words of hosts that are allowed, by kind: schools, professions, food, homes, nature, travel, culture, health, trade, technology.
ALLOWED = """school university college library seminar lesson physics chemistry biology history grammar algebra
    doctor lawyer plumber carpenter architect engineer farmer tailor pilot dentist barber electrician
    bread cheese apple coffee soup pasta rice salad olive honey pepper lemon
    kitchen garden roof window carpet sofa lamp curtain garage cellar balcony mirror
    river forest mountain island desert glacier meadow valley beach volcano lake canyon
    hotel airport railway ferry museum castle harbor campsite passport luggage tour hostel
    music opera cinema novel poetry painting sculpture ballet drama orchestra comic folklore
    hospital clinic nursing surgery vaccine nutrition fitness yoga physiotherapy optician vision allergy
    market furniture fashion jewelry toys bicycle tractor paper printing textile ceramic leather
    software database network compiler robot satellite sensor battery camera keyboard monitor printer
    parliament council mayor police fire-brigade court embassy census election budget ministry archive
    football tennis rowing chess cycling swimming climbing hockey skating marathon fencing judo""".split()
#: Forms of hosts and paths, as the web has them.
PLACES = ["{}.com", "www.{}.com", "{}.org", "www.{}.net", "shop.{}.com", "my{}.info", "the{}.co.uk", "{}online.com", "{}-world.net", "best-{}.biz"]
PATHS = ["", "/", "/index.html", "/about", "/contact/", "/blog/2021/05/", "/products/113", "/news.php", "/category/all", "/terms"]


def labelled(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, places: list[str] = PLACES, paths: list[str] = PATHS) -> list[tuple[str, int]]:
    """(host and path, 1 for blocked): each word in each place; places and paths go round alike for both kinds."""
    rows = []
    for words, y in ((blocked, 1), (allowed, 0)):
        for i, w in enumerate(dict.fromkeys(words)):
            rows += [(p.format(w) + paths[(7 * i + 5 * j) % len(paths)], y) for j, p in enumerate(places)]
    return rows


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def _grams(codes: list[int]) -> list[int]:
    out = []
    for n in GRAMS:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = h * BASE + c
            out.append(h % BUCKETS)
    return out


@cache
def train(rows: tuple[tuple[str, int], ...] | None = None, rounds: int = 300, ridge: float = 0.002, prior: float = PRIOR) -> tuple[tuple[int, ...], int]:
    """(weights, bias) from (host and path, 1 for blocked) rows; a deterministic gradient fit in NumPy. Without rows of both kinds nothing is blocked.

    The kinds weigh alike in the fit, whatever their numbers; the bias is then moved to the share ``prior`` of urls to block.
    """
    rows = rows if rows is not None else tuple(labelled())
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} labelled rows")
    y = np.array([r[1] for r in rows], float)
    if not len(rows) or len(set(y)) < 2:
        return (0,) * BUCKETS, -SCALE
    grams = [_grams([ord(c) for c in f"^{text}$"]) for text, _ in rows]
    at, who = np.concatenate([np.array(g, int) for g in grams]), np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(who, w[at], len(rows)) + b)))
        g = each * (p - y)
        w -= 0.5 * (np.bincount(at, g[who], BUCKETS) + ridge * w)
        b -= 0.5 * float(g.sum())
    return tuple(int(round(v * SCALE)) for v in w), int(round((b + np.log(prior / (1 - prior))) * SCALE))


def logit(text: Column, weights: tuple[int, ...], bias: int) -> Column:
    """The model's score of a host with its path, in units of 1/SCALE."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<bigint>")  # a literal that is parsed once

    def adder(c: Column, n: int):
        def add(s: Column, i: Column) -> Column:
            h = F.get(c, i)
            for j in range(1, n):
                h = h * BASE + F.get(c, i + j)
            return s + F.get(table, F.pmod(h, F.lit(BUCKETS)).cast("int"))

        return add

    def total(c: Column) -> Column:
        sums = F.lit(bias).cast("long")
        for n in GRAMS:
            starts = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
            sums = sums + F.aggregate(starts, F.lit(0).cast("long"), adder(c, n))
        return sums

    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda ch: F.ascii(ch).cast("long"))
    codes = F.transform(F.array(codes), total)
    return F.element_at(codes, 1)


#: (host, path, verdict)
Rule = tuple[str, str, str]


def fitting(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as struct<rule, verdict>, or null."""
    struct = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(struct)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the last that fits wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(df: DataFrame, rules: list[Rule], model: tuple[tuple[int, ...], int] | None = None, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, host, path, rule, score, verdict) of each row; ``score`` is the model's probability of blocking."""
    weights, bias = model or train()
    parts = df.select(*[F.col(c) for c in keep or []], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    scored = parts.withColumn("fits", fitting(F.col("host"), F.col("path"), rules)).withColumn("z", logit(F.concat("host", "path"), weights, bias))
    return scored.select(
        *[F.col(c) for c in keep or []],
        "host",
        "path",
        F.col("fits.rule").alias("rule"),
        (1 / (1 + F.exp(-F.col("z") / SCALE))).alias("score"),
        F.coalesce("fits.verdict", F.when(F.col("z") >= 0, "block").otherwise("allow")).alias("verdict"),
    )


def duckdb_sql(rules: list[Rule], model: tuple[tuple[int, ...], int] | None = None) -> str:
    """The same in DuckDB SQL over ``pages``."""
    weights, bias = model or train()
    table = "[" + ",".join(map(str, weights)) + "]::BIGINT[]"
    sums = " + ".join(
        f"coalesce(list_sum(list_transform(range(1, len(c) - {n - 2}), lambda i: w[1 + ({'+'.join(f'c[i + {j}] * {BASE ** (n - 1 - j)}' for j in range(n))}) % {BUCKETS}])), 0)" for n in GRAMS
    )
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}:{v}'" for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1]), reverse=True))
    return f"""
    WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
    d AS (SELECT *, list_transform(string_split('^' || host || path || '$', ''), lambda x: unicode(x)::BIGINT) AS c, CASE {cases} END AS fit FROM b),
    e AS (SELECT *, {bias} + {sums} AS z FROM d, (SELECT {table} AS w))
    SELECT page_id, host, path, split_part(fit, ':', 1) AS rule, coalesce(split_part(fit, ':', 2), CASE WHEN z >= 0 THEN 'block' ELSE 'allow' END) AS verdict FROM e
    """
