"""URL filtering by longest-rule lists and a logistic regression on hashed character n-grams.

Everything runs as DataFrame expressions; the model is an array literal of
fixed width, so scoring needs no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width of the hashed feature space, and the n-gram sizes.
WIDTH, SIZES = 2048, (3, 4)
#: Rules that are one expression; more are joined. Labelled URLs at most: the fit is over all pairs of them.
MOST_INLINE, MOST_LABELS = 500, 200

# The small labelled URL table (1: allow, 0: block).
LABELLED_URLS = """
1 https://docs.example.net/en/guide/start
1 https://www.museum.example.org/en/collection/12
1 http://library.example.net/fr/catalogue/roman
1 https://news.example.com/en/science/article.html
1 https://blog.example.com/en/travel/lisbon
1 https://wiki.example.net/de/geschichte/berlin
1 https://school.example.org/en/lessons/algebra
1 https://recipes.example.com/es/cocina/sopa
1 https://m.weather.example.net/en/forecast/today
1 https://health.example.org/en/advice/sleep
1 https://journal.example.net/en/archive/paper
1 https://forum.example.com/en/questions/4711
1 https://www.city.example.net/de/rathaus/termine
1 https://garden.example.com/en/roses/pruning
1 https://radio.example.org/fr/emissions/jazz
1 https://maps.example.net/en/trails/north
1 https://books.example.net/en/reviews/novel
1 https://theatre.example.com/fr/programme
1 https://code.example.net/en/reference/list
1 https://history.example.org/en/timeline
0 http://roulette.example.net/en/spins-bonus
0 http://www.poker-room.example.com/jackpot/now
0 http://pharmacy-offers.example.net/buy/no-prescription
0 http://xxx-videos.example.com/hot/clips
0 http://warez.example.net/crack/keygen-download
0 http://loans-fast.example.com/apply/instant-cash
0 http://redirect.example.net/banner/popup?id=1
0 http://prize-draw.example.com/claim/lottery
0 http://cams-live.example.net/girls/sexy
0 http://torrent.example.com/download/crack
0 http://replica-watches.example.net/shop/sale
0 http://seo-links.example.com/buy/backlinks
0 http://wager-sports.example.net/odds/today
0 http://serials.example.com/keygen/full
0 http://crypto-double.example.net/profit/instant
0 http://slimming-tablets.example.com/buy/today
0 http://mailer.example.net/bulk/redirect
0 http://escorts.example.com/girls/city
0 http://porn.example.net/xxx/videos
0 http://lottery.example.com/jackpot/claim
"""


def labelled_urls(spark: SparkSession) -> DataFrame:
    rows = [(line[2:], float(line[0])) for line in LABELLED_URLS.strip().splitlines()]
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end; A-Z in lower case."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _grams(part: str, n: int, chars: Column) -> Column:
    places = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(part), *(F.get(chars, i + k) for k in range(n))), F.lit(WIDTH)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Hashed n-grams of host and path as indices below WIDTH; repeats stay.

    The characters are bound as a lambda's variable, so that a text is split
    once and not once for each n-gram.
    """
    parts = []
    for part, text in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("\x02"), text, F.lit("\x03")), "")
        parts.append(F.flatten(F.transform(F.array(chars), lambda c: F.concat(*(_grams(part, n, c) for n in SIZES)))))
    return F.concat(*parts)


def score(w: list[float], f: Column) -> Column:
    """Probability of label 1: a logistic function of the mean weight of the n-grams."""
    weights = F.lit(w[:WIDTH])
    total = F.aggregate(f, F.lit(0.0), lambda s, i: s + F.get(weights, i))
    return F.lit(1.0) / (F.exp(-(total / F.greatest(F.size(f), F.lit(1)) + F.lit(w[WIDTH]))) + 1.0)


def train(labelled: DataFrame, rounds: int = 400, rate: float = 300.0, bias: float = 0.1) -> list[float]:
    """WIDTH weights and a bias (last) by gradient descent over a small table.

    ``labelled`` (url, label 0/1) may hold at most MOST_LABELS rows; rows with
    nulls are left out, and none gives a model that answers 0.5. A row's
    features are shares of its n-grams, so long URLs weigh as much as short
    ones. The descent runs in the dual: each step moves one coefficient per
    row, over the rows' inner products, inside one expression. Only the
    weights, bounded by the feature space, reach the driver.
    """
    n = labelled.count()
    if n > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labelled URLs")
    w = [0.0] * (WIDTH + 1)
    rows = labelled.where("url is not null and label is not null").select(
        F.row_number().over(Window.orderBy("url", "label")).alias("k"), F.col("label").cast("double").alias("y"), features(host_of(F.col("url")), path_of(F.col("url"))).alias("f")
    )
    cells = rows.select("k", "y", F.size("f").alias("n"), F.explode("f").alias("i")).groupBy("k", "y", "i").agg((F.count("*") / F.first("n")).alias("x"))
    cells = cells.unionByName(rows.select("k", "y", F.lit(WIDTH).alias("i"), F.lit(bias).alias("x"))).coalesce(1).persist()
    other = cells.select(F.col("k").alias("j"), "i", F.col("x").alias("z"))
    inner = cells.join(other, "i").groupBy("k", "y", "j").agg(F.sum(F.col("x") * F.col("z")).alias("d"))
    line = inner.groupBy("k", "y").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "d"))), lambda c: c["d"]).alias("d"))
    table = line.groupBy().agg(F.sort_array(F.collect_list(F.struct("k", "y", "d"))).alias("rows"), F.count("*").alias("n"))

    def step(a: Column, _: Column) -> Column:
        def moved(row: Column, i: Column) -> Column:
            z = F.aggregate(F.zip_with(row["d"], a, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
            return F.get(a, i) + rate / F.col("n") * (row["y"] - F.lit(1.0) / (F.exp(-z) + 1.0))

        return F.transform("rows", moved)

    dual = table.select(F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform("rows", lambda r: F.lit(0.0)), step)).alias("p", "a")).select((F.col("p") + 1).alias("k"), "a")
    for i, v in cells.join(dual, "k").groupBy("i").agg(F.sum(F.col("x") * F.col("a")).alias("v")).collect():
        w[i] = v * bias if i == WIDTH else v
    cells.unpersist()
    return w


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null.

    ``rules`` are (verdict, host, path). A rule fits its host and all
    subdomains, if the path starts with the rule's; of equally long ones the
    first in order of text wins.
    """
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        cell = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, cell) if found is None else found.when(fits, cell)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def join_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path and others) with ``_r``, the same as ``rule_for`` gives, for a list of any length.

    ``rules`` has verdict, host and path. Each different host and path asks for
    the rules of its host and of the domains above it, by a join.
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct().withColumn("_h", F.explode(above))
    known = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "verdict")
    rule = F.concat("_h", "_p")
    best = asked.join(known, "_h").where(F.col("path").startswith(F.col("_p"))).groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), "verdict")).alias("_b"))
    best = best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.struct("_b.rule", "_b.verdict").alias("_r"))
    return urls.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_allow of every URL.

    The longest fitting rule decides; without one the model does: allow if its
    probability is at least ``threshold``. A null URL, or one without ://, has
    an empty host and path and is judged by the model on those. Ids may be null
    or repeat; other columns are ignored. Up to MOST_INLINE rules need no
    shuffle; more are joined.
    """
    at = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    if len(rules) <= MOST_INLINE:
        at = at.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    else:
        at = join_rules(at, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"))
    at = at.withColumn("p_allow", score(weights, features(F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("p_allow") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return at.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "p_allow")
