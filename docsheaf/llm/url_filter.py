"""Operator 1, URL filters: rules, then logistic regression on hashed character n-grams. DataFrame functions only.

Host and path are cut from the url; a rule fits its host and all subdomains if the path starts
with the rule's path, and the longest rule wins. Any other url is judged by a logistic
regression over the hashed n-grams of host and path (binary features, scaled by the root of
their number). The model is fitted from a labelled url table of at most ``MAX_LABELLED`` rows
whose features come from the same column expression; only those few rows reach the driver.

Defined results: a null url or one without ``://`` has empty host and path, no rule fits it and
the model judges it with no feature (the intercept alone: allow). Repeated rows give repeated
results; other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SIZES, MAX_LABELLED = 4096, (3, 4, 5), 5000

#: labelled urls: 1 is unwanted (spam, scams, gambling, adult, piracy), 0 is wanted
UNWANTED = """
http://www.cheap-meds-online.test/buy/viagra
https://discount-pharmacy.test/pills/no-prescription
http://buy-pills-now.test/
https://shop.pills-without-doctor.test/order/12
http://best-casino-bonus.test/slots/free-spins
https://online-casino.test/win-money
http://poker-jackpot.test/play/betting
https://sports-betting-odds.test/bet/live
https://www.bets-and-tips.test/en/free-bets
http://lucky-slots.test/spin?bonus=100
http://spam-site.test/click-here
http://link-farm.test/page/links
http://seo-spam.test/cheap-backlinks
http://www.farm-of-links.test/exchange/450
https://payday-loans-fast.test/apply/cash
http://fast-cash-loan.test/credit/no-check
http://free-money-now.test/claim-prize
http://win-free-iphone.test/prize/winner
https://free-gift-cards.test/survey/77.html
https://xxx-videos.test/porn/free
http://hot-girls-chat.test/adult/cams
http://adult-dating.test/sex/meet
https://cams-adult-live.test/room/5
http://m.sexy-singles.test/de/12
http://replica-watches.test/rolex/cheap
https://cheap-replica-bags.test/sale
http://cheap-followers.test/buy/likes
http://crack-keygen.test/warez/download
http://free-movies-torrent.test/pirate/stream
http://full-version-cracked.test/serial/88
http://crypto-doubler.test/invest/profit
https://get-rich-quick.test/earn-money
http://forex-signals-profit.test/fr/9
http://weight-loss-miracle.test/diet/pills
http://miracle-cure.test/buy/now
http://account-verify-login.test/secure/update
https://secure-login-verify.test/bank/confirm?id=3
http://cheap-essay-writer.test/order/essay
http://clickbait-daily.test/you-wont-believe
http://www.ads-popunder.test/pixel
https://click-ads-network.test/track/2
http://tracker-of-clicks.test/ad/redirect?u=1
http://popup-ads.test/es/banner
https://www.parked-domains-for-sale.test/offer
http://casino-royal.test/bonus
""".split()
WANTED = """
https://www.university.test/research/papers/1234
https://news.city.test/en/2021/05/12/council.html
https://blog.gardens.test/en/roses
https://docs.library.test/fr/manuel/index.html
https://m.weather.test/de/wetter
https://www.museum.test/es/colecciones/88
https://wiki.history.test/en/12345
https://blog.cooking.test/fr/recettes/4411?page=2
https://www.school.test/timetable
https://www.hospital.test/departments/cardiology
https://www.government.test/forms/tax
https://journal.science.test/articles/10
https://shop.books.test/catalogue/fiction
https://forum.linux.test/thread/99812
https://api.maps.test/v1/places
https://www.football-club.test/fixtures
https://data.statistics.test/population
https://www.bank.test/contact
https://www.orchestra.test/concerts
https://blog.photography.test/en/2020/lens
https://www.bakery.test/bread
https://theatre.test/programme/autumn
https://www.weather-station.test/en/17
http://bridges.test/history
https://www.railway.test/timetables/north
https://m.harbour.test/es/barcos
https://astronomy.test/telescope/guide
https://www.translation.test/dictionary/german
https://nation.test/constitution/article-5
https://blog.mountain-hut.test/hiking
http://physics.test/lecture/12.pdf
https://www.therapy-centre.test/appointments
https://archive.letters.test/1890/03
https://www.botany.test/trees/oak
https://music.teacher.test/lessons
https://www.fire-brigade.test/en/safety
https://www.parliament.test/debates/2019
http://www.athletics.test/results/marathon
https://blog.knitting.test/patterns/3
https://www.insurance.test/claims/form
https://www.airport.test/departures
https://town.test/council/minutes
https://rivers.test/en/levels
http://www.printing.test/paper-sizes
https://www.breathing.test/exercise
https://lighthouse.test/visit
https://www.chess-club.test/games/44
http://www.engineering.test/standards/steel
https://www.brewery.test/tours
https://poetry.test/poem/771
https://www.translators.test/fr/contact
https://www.kitchen.test/tools
https://www.ferry.test/timetable?route=2
https://encyclopedia.test/entry/whale
https://www.recycling.test/glass
https://www.fishing.test/permits
https://software.test/release-notes/4.2
https://www.nursery.test/plants
https://hotel.test/rooms
https://www.newspaper.test/opinion/letters
https://www.zoo.test/animals/otter
https://blog.sailing.test/en/knots
https://www.courts.test/judgments/2004
https://www.geology.test/maps/9
https://grammar.test/verbs/irregular
https://www.economy.test/reports/inflation
https://www.cathedral.test/services
https://www.choir.test/rehearsals
https://www.observatory.test/images/moon
https://street-maps.test/town/centre
http://www.heritage.test/castles/33
https://teaching.test/mathematics/fractions
https://www.nature-reserve.test/birds
https://www.post-office.test/parcels
""".split()
#: rule strings host + path
ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):  # longer rules are tested first, so they come last here
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def ngram_buckets(host: Column, path: Column, buckets: int = BUCKETS, sizes: tuple = SIZES) -> Column:
    """array<int>: the distinct hashed n-grams; marks at both ends of host and path are part of
    them, and runs of digits read as one zero."""
    parts = []
    for mark, s in (("h", host), ("p", path)):
        s = F.when(s == "", "").otherwise(F.concat(F.lit("^"), F.regexp_replace(s, "[0-9]+", "0"), F.lit("$")))
        for n in sizes:
            grams = F.transform(F.sequence(F.lit(1), F.char_length(s) - (n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(f"{mark}{n}"), F.substring(s, i, F.lit(n))), F.lit(buckets)).cast("int"))
            parts.append(F.when(F.char_length(s) >= n, grams).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.concat(*parts))


def fit(labelled: DataFrame, buckets: int = BUCKETS, sizes: tuple = SIZES, limit: int = MAX_LABELLED, epochs: int = 600, rate: float = 0.5, l2: float = 1e-4) -> tuple[list[float], float]:
    """(weights, intercept) from (url, label). The table may have ``limit`` rows at most."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(F.col("url"), F.col("label").cast("double"), ngram_buckets(host, path, buckets, sizes).alias("b")).sort("url", "label").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the labelled url table has more than {limit} rows")
    w, c = [0.0] * buckets, 0.0
    total = len(rows) or 1
    scaled = [(r["b"], 1 / math.sqrt(len(r["b"])) if r["b"] else 0.0, r["label"]) for r in rows]
    for _ in range(epochs):
        grad, g0 = {}, 0.0
        for b, scale, y in scaled:
            d = 1 / (1 + math.exp(-(c + scale * sum(w[i] for i in b)))) - y
            g0 += d
            for i in b:
                grad[i] = grad.get(i, 0.0) + d * scale
        c -= rate * g0 / total
        for i, g in grad.items():
            w[i] -= rate * 100 * (g / total + l2 * w[i])
    return w, c


def labelled_urls(spark) -> DataFrame:
    """The small table that comes with the operator."""
    both = ",".join(f"('{u}', {y})" for y, urls in ((1, UNWANTED), (0, WANTED)) for u in urls)
    return spark.sql(f"SELECT * FROM VALUES {both} AS t(url, label)")


def probability(found: Column, model: tuple[list[float], float]) -> Column:
    weights, intercept = model
    # one foldable literal, not one expression for each bucket
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in weights)), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return 1 / (1 + F.exp(-(intercept + total / F.sqrt(F.greatest(F.size(found), F.lit(1))))))


def judge(df: DataFrame, model: tuple[list[float], float], rules: dict[str, str] | None = None, url: str = "url", key: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, probability): the rule's verdict, else block from ``threshold`` on."""
    rules = {**dict.fromkeys(ALLOW, "allow"), **dict.fromkeys(BLOCK, "block")} if rules is None else rules
    host, path = host_and_path(F.col(url))
    parts = df.select(F.col(key), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = parts.select(key, "host", "path", rule.alias("rule"), verdict.alias("__v"), probability(ngram_buckets(F.col("host"), F.col("path")), model).alias("probability"))
    return scored.select(key, "host", "path", "rule", F.coalesce("__v", F.when(F.col("probability") >= threshold, "block").otherwise("allow")).alias("verdict"), "probability")
