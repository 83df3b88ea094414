"""URL filter: rules of host and path first, then logistic regression on hashed character n-grams.

Everything here is DataFrame expressions: host and path by regular expressions, n-grams and the linear
score by higher-order functions over the url's characters, each read a fixed number of times, so a very long url costs in proportion to its length.
The fit is one expression too: the labelled table, small by contract (it is gathered into one row), becomes lists of features by
url and of urls by feature, and a fold over the steps makes full-batch AdaGrad of them. Only the weights of the features
that occur, `dimensions` at most, pass through the driver.

A null url, or one without `://`, has an empty host and path; so it is judged by the bias and the n-grams of nothing. Repeated
urls are judged alike, an empty table gives an empty one; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The rules, as (verdict, host and path prefix).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

# Words of the labelled table's hosts and paths.
BLOCK_WORDS = ["casino", "poker", "bets", "betting", "slots", "jackpot", "roulette", "lottery", "win", "cheap", "pills", "pharma", "viagra", "cialis", "drugs", "loans", "payday", "credit", "porn", "xxx", "adult", "escort", "cams", "ads", "adserver", "track", "tracker", "click", "popup", "banner", "free", "bonus", "crack", "warez", "keygen", "torrent", "malware", "spam"]
ALLOW_WORDS = ["news", "wiki", "library", "school", "university", "museum", "weather", "science", "history", "garden", "kitchen", "travel", "music", "health", "research", "journal", "archive", "forum", "photos", "market", "city", "council", "nature", "physics", "software", "reading"]
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "sh", "ing", "tion", "ble", "ly", "wh"]
# Labelled by hand: hosts and paths as they stand on the web, invented ones for what is to be blocked.
KNOWN_BLOCKED = """best-online-casino-bonus.com/play freespins-today.net/claim realmoney-poker.club/join sportsbetting-tips.top/odds dating-singles-tonight.xyz/chat adult-webcams.live/girls
hot-milf-videos.xxx/clip sexy-chat-room.net/enter escort-service-city.biz/list nude-photos-archive.info/set1 viagra-without-prescription.ru/buy generic-pills-shop.com/order
weightloss-secret.click/trial keto-gummies-official.store/offer penis-growth-oil.shop/now hairloss-cure.site/discount payday-loans-fast.info/apply bad-credit-lender.loan/get quick-cash-advance.biz/form
earn-money-at-home.online/start forex-signals-pro.top/vip crypto-giveaway-event.io/send double-your-coins.net/deposit nft-airdrop-claim.xyz/wallet make-1000-a-day.win/video
free-gift-card-generator.click/amazon you-have-won-prize.site/claim iphone-lucky-draw.top/spin survey-rewards-center.net/go cheap-designer-bags.cn/sale fake-rolex-store.shop/men
outlet-jackets-sale.top/mk discount-nike-factory.cn/shoes wholesale-sunglasses.store/rb term-paper-writers.net/price buy-college-essays.com/order diploma-without-exam.com/buy
crack-serial-download.net/full keygen-windows-activator.ru/get warez-forum-leech.cc/thread watch-movies-free-online.cc/hd stream-live-match.top/now torrent-magnet-search.to/top mod-apk-unlimited.net/game
mp3-download-free.club/song hack-facebook-account.info/tool instagram-followers-free.site/get seo-backlinks-cheap.biz/buy traffic-exchange-network.net/hit popunder-ads-server.com/show
click-tracker-redirect.net/r adserve.banner-rotator.com/view track.affiliate-offers.biz/c doubleclicks-media.net/ad push-notification-ads.top/sub malware-scan-alert.click/warning your-pc-is-infected.site/fix
update-flash-player-now.xyz/install verify-account-security.top/login secure-bank-signin.info/auth package-delivery-fee.click/pay slot-gacor-maxwin.asia/daftar judi-online-terpercaya.bet/login
bandar-togel.club/hasil roulette-strategy-win.com/system lottery-numbers-predict.xyz/buy horoscope-love-spell.site/caster psychic-reading-live.top/call russian-brides-online.net/girls
mature-women-dating.club/meet teen-cam-show.live/join gay-hookup-app.xyz/near swingers-party-tonight.info/go erotic-stories-hot.net/read""".split()
KNOWN_ALLOWED = """www.wikipedia.org/ de.wikipedia.org/wiki/Berlin fr.wikipedia.org/wiki/Histoire es.wikipedia.org/wiki/Madrid commons.wikimedia.org/wiki/File:Map www.theguardian.com/world/2021/jan/05/report www.reuters.com/article/markets
edition.cnn.com/2019/07/16/health/study www.washingtonpost.com/politics/2020/vote www.zeit.de/kultur/film www.faz.net/aktuell/wirtschaft www.lefigaro.fr/sciences www.elmundo.es/deportes www.corriere.it/cronache
news.ycombinator.com/item?id=1 www.reddit.com/r/askscience/comments/a1 medium.com/@someone/how-to-write gitlab.com/group/project/issues pypi.org/project/requests docs.oracle.com/javase/tutorial
kubernetes.io/docs/concepts www.w3.org/TR/css www.rfc-editor.org/rfc/rfc791 www.kernel.org/doc/html man7.org/linux/man-pages www.postgresql.org/docs/current spark.apache.org/docs/latest
www.sciencedirect.com/science/article/pii pubmed.ncbi.nlm.nih.gov/123 link.springer.com/chapter/10 www.jstor.org/stable/1 plato.stanford.edu/entries/kant ocw.mit.edu/courses/physics www.ox.ac.uk/admissions
www.uni-heidelberg.de/de/studium www.harvard.edu/about www.coursera.org/learn/statistics www.khanacademy.org/math/algebra www.gutenberg.org/ebooks/1342 archive.org/details/texts www.loc.gov/collections
www.britishmuseum.org/collection www.louvre.fr/en/explore www.nps.gov/yell/index.htm www.weather.gov/forecast www.usgs.gov/programs/earthquakes www.cdc.gov/flu/about www.who.int/news-room/fact-sheets www.nhs.uk/conditions/asthma
www.europarl.europa.eu/news/de www.bundestag.de/dokumente www.legislation.gov.uk/ukpga www.un.org/en/climate www.imf.org/en/Publications www.bankofengland.co.uk/monetary-policy www.ikea.com/de/de/cat/betten
www.lonelyplanet.com/italy/rome www.tripadvisor.com/Hotel_Review www.bahn.de/service/fahrplan www.nationalgeographic.com/animals/article www.seriouseats.com/pasta-recipe www.bbcgoodfood.com/recipes/soup www.marmiton.org/recettes/gateau
www.chefkoch.de/rezepte/brot www.gardenersworld.com/plants/roses www.runnersworld.com/training www.fifa.com/tournaments/mens www.uefa.com/euro2024 www.discogs.com/artist/1 www.allmusic.com/album/kind-of-blue
www.rottentomatoes.com/m/casablanca www.poetryfoundation.org/poems/44107 www.merriam-webster.com/dictionary/river dict.leo.org/englisch-deutsch www.duolingo.com/course/fr www.openstreetmap.org/way/4 oldtown-library.org/events riverside-school.edu/parents
village-football-club.co.uk/fixtures family-dentist-springfield.com/contact mountain-hiking-routes.ch/map local-history-society.org/archive jazz-festival-montreal.ca/program""".split()
MOST_LABELLED = 50_000  # rows of a labelled table, which a fit holds in one row

SUBDOMAINS = ["", "www.", "m.", "blog.", "shop.", "static."]
ENDINGS = ["", "/", ".html", "?page=2", "#top", "?utm_source=feed"]
LANGUAGES = ["en", "de", "fr", "es"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the urls labelled by hand, and by rule from the word lists; label 1: block. A fixed number of rows."""
    mates = [*BLOCK_WORDS, "x", "online", "farm", "best", "24", "hot"]
    blocked = [f"{a}-{mates[(i * 7 + k * 9 + 3) % len(mates)]}" for i, a in enumerate(BLOCK_WORDS) for k in range(3)]
    blocked += [f"{mates[(i * 5 + k * 11 + 2) % len(mates)]}-{a}" for i, a in enumerate(BLOCK_WORDS) for k in range(3)]
    blocked += [f"{a}{k}" for a in BLOCK_WORDS for k in ("", "1")]
    n = len(SYLLABLES)
    allowed = [SYLLABLES[i] + SYLLABLES[j] + ("" if (i + j) % 2 else SYLLABLES[(i * 11 + j * 5) % n]) for i in range(n) for j in range(n)]
    allowed += [f"{a}-{b}" for i, a in enumerate(ALLOW_WORDS) for b in (ALLOW_WORDS[(i * 5 + 2) % len(ALLOW_WORDS)], SYLLABLES[i % n] + SYLLABLES[(i * 3 + 1) % n])] * 2 + ALLOW_WORDS * 3
    rows = []
    for label, names in ((1, blocked), (0, allowed)):
        for i, name in enumerate(names):
            # domain, subdomain, language and ending turn at paces of their own, alike for both labels
            host = SUBDOMAINS[i % len(SUBDOMAINS)] + name + (".example.com", ".example.net", ".example.org")[i * 2 // 5 % 3]
            rows.append({"url": f"http{'s' if i % 2 else ''}://{host}/{LANGUAGES[i // 7 % 4]}/{i * 7919 % 10000}{ENDINGS[i // 11 % len(ENDINGS)]}", "label": label})
    rows += [{"url": f"http{'s' if i % 2 else ''}://{x}", "label": label} for label, known in ((1, KNOWN_BLOCKED), (0, KNOWN_ALLOWED)) for i, x in enumerate(known)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url:string,label:int>>")))


def host_of(url: Column) -> Column:
    """After the first :// up to the next /, ? or #; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams(host: Column, path: Column, dimensions: int, sizes=(3, 4, 5)) -> Column:
    """The distinct hashed character n-grams of host and path. Digits count as one character each, of one kind."""
    text = F.regexp_replace(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), "[0-9]", "0")

    def of(chars: Column, k: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(chars) - k))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(*[F.get(chars, i + j) for j in range(k)]), F.lit(dimensions)).cast("int"))

    return bound(F.split(text, ""), lambda chars: F.array_distinct(F.concat(*[of(chars, k) for k in sizes])))


def _margin(features: Column, weights: Column, bias: float) -> Column:
    scale = F.sqrt(F.size(features).cast("double"))
    return F.aggregate(features, F.lit(0.0), lambda a, g: a + F.element_at(weights, g + 1)) / scale + F.lit(bias)


def _literal(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def fitted(urls: Column, features: Column, steps: int, rate: float, decay: float) -> Column:
    """(weights, bias) after so many steps of full-batch AdaGrad.

    urls: array of (f: indices of features, scale, y, share of the loss); features: array of (u: indices of urls)."""
    zeros = F.transform(features, lambda x: F.lit(0.0))
    start = F.struct(zeros.alias("w"), zeros.alias("seen"), F.lit(0.0).alias("b"), F.lit(0.0).alias("b_seen"))
    sum_of = lambda column: F.aggregate(column, F.lit(0.0), lambda a, x: a + x)

    def step(s: Column, _) -> Column:
        margin = lambda u: F.aggregate(u["f"], F.lit(0.0), lambda a, f: a + F.get(s["w"], f)) * u["scale"] + s["b"]
        errors = F.transform(urls, lambda u: (1 / (1 + F.exp(-margin(u))) - u["y"]) * u["share"])

        def after(e: Column) -> Column:
            slope = lambda scaled: F.transform(features, lambda x, f: F.aggregate(x["u"], F.lit(0.0), lambda a, u: a + F.get(scaled, u)) + F.get(s["w"], f) * decay)
            return bound(bound(F.zip_with(e, urls, lambda x, u: x * u["scale"]), slope), lambda g: bound(sum_of(e), lambda b: moved(g, b)))

        def moved(g: Column, b: Column) -> Column:
            seen = F.zip_with(s["seen"], g, lambda v, x: v + x * x)
            b_seen = s["b_seen"] + b * b

            def there(v: Column) -> Column:
                w = F.transform(s["w"], lambda old, f: old - F.get(g, f) * rate / F.sqrt(F.get(v, f) + 1e-12))
                return F.struct(w.alias("w"), v.alias("seen"), (s["b"] - b * rate / F.sqrt(b_seen + 1e-12)).alias("b"), b_seen.alias("b_seen"))

            return bound(seen, there)

        return bound(errors, after)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def fit(table: DataFrame, dimensions: int = 1 << 15, steps: int = 40, rate: float = 0.1, decay: float = 2e-6) -> tuple[list[float], float]:
    """Weights and bias of a logistic regression on (url, label), at most `MOST_LABELLED` rows of it with a label."""
    n = table.filter("label in (0, 1)").limit(MOST_LABELLED + 1).count()
    if n > MOST_LABELLED:
        raise ValueError(f"a labelled table has more than {MOST_LABELLED} rows: take a sample")
    url = F.col("url").cast("string")
    rows = table.filter("label in (0, 1)").select(url.alias("url"), F.col("label").cast("double").alias("y"), grams(host_of(url), path_of(url), dimensions).alias("g"))
    rows = rows.withColumn("i", F.row_number().over(Window.orderBy("url", "y")) - 1)
    pairs = rows.select("i", "y", F.explode("g").alias("k"))
    names = pairs.select("k").distinct().withColumn("f", F.row_number().over(Window.orderBy("k")) - 1)
    pairs = pairs.join(names, "k")
    each = pairs.groupBy("i", "y").agg(F.sort_array(F.collect_list("f")).alias("f"))
    listed = pairs.groupBy("f", "k").agg(F.sort_array(F.collect_list("i")).alias("u"))
    # both kinds of lists in one row, by one aggregation: no join
    url_row = F.struct("i", "f", (1 / F.sqrt(F.size("f").cast("double"))).alias("scale"), "y")
    none = lambda df, c: F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
    feature_row = F.struct("f", "k", "u")
    both = each.select(url_row.alias("url"), none(listed, feature_row).alias("feature")).union(listed.select(none(each, url_row).alias("url"), feature_row.alias("feature")))
    one = both.agg(F.sort_array(F.collect_list("url")).alias("urls"), F.sort_array(F.collect_list("feature")).alias("features"), F.sum("url.y").alias("ones"), F.count("url").alias("n"))
    zeros = F.col("n") - F.col("ones")

    def weighed(u: Column) -> Column:  # both labels weigh the same
        share = F.when(F.col("ones") * zeros == 0, 1 / F.col("n")).otherwise(0.5 / F.when(u["y"] > 0, F.col("ones")).otherwise(zeros))
        return F.struct(u["f"].alias("f"), u["scale"].alias("scale"), u["y"].alias("y"), share.alias("share"))

    one = one.select(F.transform("urls", weighed).alias("urls"), "features")
    found = one.select(fitted(F.col("urls"), F.col("features"), steps, rate, decay).alias("m"), F.col("features.k").alias("k")).select("k", "m.w", "m.b").first()
    weights, bias = [0.0] * dimensions, found["b"] or 0.0
    for k, w in zip(found["k"] or [], found["w"] or []):
        weights[k] = w
    if not math.isfinite(bias) or not all(map(math.isfinite, weights)):
        raise ValueError("the fit diverged: lower the rate")
    return weights, bias


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, or null, and its verdict."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def judge(pages: DataFrame, table: DataFrame | None = None, rules=RULES, dimensions: int = 1 << 15) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `pages` (page_id, url); score: of the regression."""
    weights, bias = fit(table if table is not None else labelled_urls(pages.sparkSession), dimensions)
    parts = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = 1 / (1 + F.exp(-_margin(grams(F.col("host"), F.col("path"), dimensions), _literal(weights), bias)))
    return parts.withColumns({"rule": rule, "said": verdict, "score": score}).select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
