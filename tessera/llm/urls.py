"""URL verdicts: host and path rules, and logistic regression on hashed character n-grams of host and path for the rest.

The model is fitted in numpy on the labelled URLs below and compiled into a Spark column: a literal array of weights,
looked up by a hash of code points that SQL can compute too. Rules are compiled to one CASE expression.

Defined cases: a null URL, and one without `://`, has an empty host and path and no rule, and the method judges the
empty string (allowed, as the labelled table says); repeated rows are each judged; an empty table gives no rows."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (rule, verdict); host, then a path prefix.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The labelled table: hosts and paths that are unwanted ...
BLOCKED = """
www.casino-royal.example/en/1 casino-win.example.org/en/14 lucky-casino.example/play best-casino-bonus.example/fr/7 online-poker.example/es/20
poker-stars-win.example/en/301.html win-big-prize.example/de/9 jackpot-win.example/en/81 slots-casino.example/en/2 m.free-bets.example.com/en/27
free-bets.example/en/112 sport-bets-free.example/fr/63 bets-today.example/es/5 betting-tips.example/en/444 cheap-pills.example.com/en/450
www.cheap-pills.example/de/17 buy-pills-online.example/en/3 diet-pills.example/fr/90 pills-pharmacy.example/en/661 cheap-viagra.example/en/70
cheap-watches.example/es/8 cheap-loans.example/en/19 payday-loans.example/de/40 fast-cash-loans.example/en/77 spam-farm.example.org/en/728
link-farm.example/en/610 content-farm.example/fr/4 seo-spam.example/en/31 spam-links.example/es/255 ads-track.example.org/en/584
ads-server.example/banner/1 track-ads.example/en/98 ad-click-track.example/de/33 popup-ads.example/en/12 click-track.example/en/430.html
adult-cams.example/en/6 xxx-videos.example/fr/11 hot-singles.example/en/15 free-download-crack.example/en/210 warez-crack.example/en/9
free-iphone-prize.example/en/2 work-from-home-cash.example/en/88 crypto-double.example/en/5 miracle-cure.example/de/21 fake-designer-bags.example/en/62
www.spam-farm.example/es/35 m.casino-win.example/fr/208 blog.cheap-pills.example/es/575 ads-track.example/de/925 www.free-bets.example/en/369
"""
#: ... and others.
ALLOWED = """
www.library.example/en/1 news.example.org/en/14 blog.garden-notes.example/play school-books.example/fr/7 museum-guide.example/es/20
weather-today.example/en/301.html city-council.example/de/9 open-maps.example/en/81 recipes-kitchen.example/en/2 m.trains.example.com/en/27
history-archive.example/en/112 sport-club.example/fr/63 music-review.example/es/5 hiking-trails.example/en/444 docs-python.example.com/en/450
www.university.example/de/17 research-papers.example/en/3 health-advice.example/fr/90 hospital-info.example/en/661 astronomy.example/en/70
watchmakers-guild.example/es/8 bank-holidays.example/en/19 language-course.example/de/40 chess-problems.example/en/77 farmers-union.example.org/en/728
birds-of-europe.example/en/610 theatre.example/fr/4 physics-lectures.example/en/31 local-paper.example/es/255 tram-timetable.example.org/en/584
photo-walks.example/gallery/1 rail-track-history.example/en/98 poetry.example/de/33 cinema-listings.example/en/12 gardening.example/en/430.html
therapists.example/en/6 videos-lectures.example/fr/11 mathematics.example/en/15 software-manual.example/en/210 cooking.example/en/9
ththre.example.com/fr/825 m.ththth.example.net/en/25 blog.ththan.example.net/en/960 ththin.example.com/en/671 www.ththen.example.com/en/148.html
thering.example.com/en/328 www.therti.example.org/en/334 blog.theren.example.net/en/455 tionble.example.org/de/252 blog.tionsh.example.net/es/533
onand.example.com/en/53 www.hather.example.org/de/61 erish.example.net/es/7 m.ingest.example.com/fr/870 blog.theres.example.com/en/519
deutsch.example/de/70 francais.example/fr/5 espanol.example/es/14 english.example/en/72 home.example/ index.example/index.html
"""

LENGTHS, DIMENSION, PENALTY, ROUNDS = (3, 4), 4096, 0.002, 600
#: Multipliers of the n-gram hash; sums stay below 2^53 for every code point.
MULTIPLIERS = (31, 1009, 50021, 700001)


def ngrams(text: str) -> list[int]:
    """Distinct hashed n-grams of the text between its two marks."""
    codes = [ord(c) for c in f"^{text}$"]
    return sorted({(sum(c * m for c, m in zip(codes[i : i + n], MULTIPLIERS, strict=False)) + n) % DIMENSION for n in LENGTHS for i in range(len(codes) - n + 1)})


@lru_cache(1)
def model() -> tuple[np.ndarray, float]:
    """Weights and bias, fitted by gradient descent with momentum; the empty text counts as allowed."""
    rows = [(x, 1.0) for x in BLOCKED.split()] + [(x, 0.0) for x in ALLOWED.split()] + [("", 0.0)]
    x, y = np.zeros((len(rows), DIMENSION)), np.array([r[1] for r in rows])
    for i, (text, _) in enumerate(rows):
        x[i, ngrams(text)] = 1
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b, vw, vb = np.zeros(DIMENSION), 0.0, np.zeros(DIMENSION), 0.0
    for _ in range(ROUNDS):
        error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * share
        vw, vb = 0.9 * vw - 0.3 * (x.T @ error + PENALTY * w), 0.9 * vb - 0.3 * error.sum()
        w, b = w + vw, b + vb
    return np.round(w, 6), round(float(b), 6)


def score_of(text: str) -> float:
    """The log-odds of `block`."""
    w, b = model()
    return b + float(w[ngrams(text)].sum())


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, prefix = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{prefix}")
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def score(text: Column) -> Column:
    """score_of() as a column."""
    w, b = model()
    codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))

    def hashed(codes: Column, n: int) -> Column:
        def at(i: Column) -> Column:
            total = F.get(codes, i) * MULTIPLIERS[0]
            for k in range(1, n):
                total = total + F.get(codes, i + k) * MULTIPLIERS[k]
            return F.pmod(total + n, F.lit(DIMENSION))

        return F.when(F.size(codes) >= n, F.transform(F.sequence(F.lit(0), F.size(codes) - n), at)).otherwise(F.array().cast("array<bigint>"))

    # the one-element list lets the lambda hold the codes, computed once
    found = F.flatten(F.transform(F.array(codes), lambda c: F.array_distinct(F.concat(*[hashed(c, n) for n in LENGTHS]))))
    return F.aggregate(found, F.lit(b), lambda s, i: s + F.get(F.lit(w), i.cast("int")))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict)."""
    host, path = host_and_path(F.col(url))
    split = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    verdict = F.lit(None).cast("string")
    for rule, says in RULES:
        verdict = F.when(F.col("rule") == rule, says).otherwise(verdict)
    method = F.when(score(F.concat("host", "path")) > 0, "block").otherwise("allow")
    return ruled.withColumn("verdict", F.when(F.col("rule").isNotNull(), verdict).otherwise(method))


def oracle_sql() -> str:
    """judge() in DuckDB, with the weights as literals."""
    w, b = model()
    rules = "".join(f" WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in sorted(RULES, key=lambda r: (-len(r[0]), r[0])))
    verdicts = "".join(f" WHEN '{r}' THEN '{v}'" for r, v in RULES)
    lists = " UNION ALL ".join(f"SELECT page_key, ({' + '.join(f'unicode(s[i + {k}]) * {MULTIPLIERS[k]}' for k in range(n))} + {n}) % {DIMENSION} AS h FROM t, range(1, length(s) - {n} + 2) r(i)" for n in LENGTHS)
    return f"""
WITH u AS (SELECT row_number() OVER () AS page_key, page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_key, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, CASE{rules} END AS rule FROM p),
t AS (SELECT page_key, '^' || host || path || '$' AS s FROM q),
g AS (SELECT DISTINCT page_key, h FROM ({lists})),
m AS (SELECT list_value({", ".join(f"{x:.6f}" for x in w)}) AS w),
z AS (SELECT page_key, {b:.6f} + sum(w[h + 1]) AS score FROM g, m GROUP BY page_key)
SELECT page_id, host, path, rule, CASE rule{verdicts} ELSE CASE WHEN coalesce(score, {b:.6f}) > 0 THEN 'block' ELSE 'allow' END END AS verdict
FROM q LEFT JOIN z USING (page_key)"""
