"""URL filter: host and path rules, and a logistic regression on hashed character n-grams for the rest.

All of it is DataFrame expressions. The regression is trained inside one row by higher-order functions over
the small labelled table and comes back as at most DIMENSIONS weights; scoring a url is a sum of looked-up
weights, so judging needs neither a join nor a shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

DIMENSIONS = 4096  # buckets of the hashed n-grams
MAX_LABELLED = 1000  # labelled urls used for training (those of smallest hash, if there are more)
EPOCHS = 24
RATE = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (verdict, host and path); the longest that fits wins.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: Small labelled table (url, 1 = block), written for this library.
LABELLED = [
    ("http://www.casino-online.example/en/12", 1), ("https://casino-royal.example/de/7.html", 1), ("http://best-casino.example/fr/3/", 1),
    ("http://poker-win.example/en/9", 1), ("https://m.win-prizes.example/es/15", 1), ("http://you-win.example/en/88/", 1),
    ("http://cheap-meds.example/en/5", 1), ("https://www.cheap-loans.example/de/61", 1), ("http://pills-shop.example/fr/4.html", 1),
    ("http://diet-pills.example/en/70/", 1), ("https://free-spins.example/es/2", 1), ("http://www.free-money.example/en/33", 1),
    ("http://sports-bets.example/en/19", 1), ("https://blog.bets-now.example/de/8", 1), ("http://spam-mail.example/en/41", 1),
    ("https://link-farm.example/fr/6", 1), ("http://content-farm.example/en/52/", 1), ("http://spam-links.example/es/77.html", 1),
    ("https://ads-server.example/en/23", 1), ("http://ads.popup-click.example/en/1", 1), ("http://click-track.example/de/90", 1),
    ("https://user-track.example/en/64", 1), ("http://adult-cams.example/fr/11", 1), ("http://xxx-videos.example/en/29", 1),
    ("https://news.theher.example/en/12", 0), ("http://www.library.example/de/7.html", 0), ("https://blog.thonder.example/fr/3/", 0),
    ("http://museum.example/en/9", 0), ("https://m.weather.example/es/15", 0), ("http://university.example/en/88/", 0),
    ("https://www.recipes.example/en/5", 0), ("http://history.example/de/61", 0), ("https://docs.thening.example/fr/4.html", 0),
    ("http://blog.tionther.example/en/70/", 0), ("https://garden.example/es/2", 0), ("http://www.science.example/en/33", 0),
    ("https://theatre.example/en/19", 0), ("http://blog.travels.example/de/8", 0), ("https://www.thingth.example/en/41", 0),
    ("http://school.example/fr/6", 0), ("https://blog.stories.example/en/52/", 0), ("http://m.thertion.example/es/77.html", 0),
    ("https://hospital.example/en/23", 0), ("http://www.thentes.example/en/1", 0), ("https://radio.example/de/90", 0),
    ("http://blog.thornth.example/en/64", 0), ("https://thereon.example/fr/11", 0), ("http://m.tientha.example/en/29", 0),
    ("https://ththend.example.com/en/4", 0), ("http://thintha.example.net/en/310", 0), ("https://m.thblent.example.org/es/8", 0),
    ("http://www.therand.example.com/en/950", 0), ("https://blog.tionand.example.net/de/27", 0), ("http://thston.example.com/en/6/", 0),
    ("https://therthin.example.org/fr/46", 0), ("http://blog.ththing.example.com/en/71", 0), ("https://www.thouer.example.net/en/30", 0),
    ("http://tionshre.example.com/es/98", 0), ("https://m.theately.example.org/en/16", 0), ("http://ththedly.example.net/en/85", 0),
    ("http://www.cheap-casino.example.com/en/20", 1), ("https://m.free-pills.example.net/de/44", 1), ("http://spam-track.example.org/en/60", 1),
    ("http://adult-chat.example.net/en/13", 1), ("https://blog.adult-x-rated.example.net/en/75", 1), ("http://m.adult-dates.example.com/es/36", 1),
    ("https://adult-bets.example.com/en/3", 1), ("http://blog.win-casino.example.net/fr/50", 1), ("https://ads-farm.example.org/es/18", 1),
]


def parts(url) -> tuple:
    """Host (A-Z lower-cased) and path of a url column; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules):
    """Struct (rule, verdict) of the longest rule that fits, else null. Equal lengths: the alphabetically first."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        ok = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        fits.append(F.when(ok, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def buckets(host, path, dims: int = DIMENSIONS):
    """Hashed overlapping n-grams: four and five characters of the marked host, three of the path."""
    def grams(s, n, tag):
        return F.transform(F.regexp_extract_all(s, F.lit("(?s)(?=(.{%d}))" % n), 1), lambda g: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(dims)).cast("int"))

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(grams(marked, 4, "h4"), grams(marked, 5, "h5"), grams(path, 3, "p3"))


def train(labelled: DataFrame, dims: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE, max_rows: int = MAX_LABELLED) -> list[float]:
    """Weights of the buckets and, last, the bias, from columns url and label (1 = block).

    Rows without a label are left out; null urls count as empty. An empty table gives weights of 0. At most
    ``max_rows`` rows are used, those of smallest hash, so the one row that holds them stays bounded.
    """
    url, label = F.col("url").cast("string"), F.col("label").cast("double")
    host, path = parts(url)
    rows = (
        labelled.where(label.isNotNull()).select(F.xxhash64(url, label).alias("o"), label.alias("y"), buckets(host, path, dims).alias("b"))
        .orderBy("o", "y").limit(max_rows)
        .agg(F.sort_array(F.collect_list(F.struct("o", "y", "b"))).alias("rows"))
        .withColumn("vocab", F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["b"])))))
    )
    # each row as (y, values over the vocabulary of the labelled rows); a constant last value is the bias
    scale = lambda b: 1 / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double"))
    dense = rows.withColumn("x", F.transform("rows", lambda r: F.struct(r["y"].alias("y"), F.concat(
        F.transform("vocab", lambda v: F.size(F.filter(r["b"], lambda g: g == v)).cast("double") * scale(r["b"])), F.array(F.lit(1.0))).alias("v"))))

    dense = materialize(dense.select("vocab", "x"), "labelled")  # one row; else every pass would derive it again

    def step(w, row, epoch):
        margin = F.aggregate(F.zip_with(w, row["v"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        gain = (row["y"] - 1 / (1 + F.exp(-margin))) * F.lit(rate) / (1 + epoch.cast("double") / 4)
        # a one-element array binds the gain, so it is computed once a step
        return F.get(F.transform(F.array(gain), lambda g: F.zip_with(w, row["v"], lambda a, b: a + g * b)), F.lit(0))

    start = F.array_repeat(F.lit(0.0), F.size("vocab") + 1)
    passes = F.aggregate(F.sequence(F.lit(0), F.lit(epochs - 1)), start, lambda w, e: F.aggregate("x", w, lambda v, row: step(v, row, e)))
    found = dense.select("vocab", passes.alias("w")).first()
    weights = [0.0] * (dims + 1)
    for b, w in zip(found["vocab"], found["w"]):
        weights[b] = w
    weights[dims] = found["w"][-1]
    return weights


def score(host, path, weights: list[float]):
    """Probability of block, as a column."""
    dims = len(weights) - 1
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")
    b = buckets(host, path, dims)
    total = F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(table, i))
    margin = F.lit(weights[dims]) + total / F.sqrt(F.greatest(F.size(b), F.lit(1)).cast("double"))
    return 1 / (1 + F.exp(-margin))


def judge(df: DataFrame, weights: list[float], rules=RULES, id_col: str = "page_id", url_col: str = "url", cut: float = 0.5) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule, verdict (allow or block), score (probability of block).

    A fitting rule decides, else the score against ``cut``. Null urls and urls without ``://`` have an empty
    host and path and are judged by the bias alone. Repeated rows are judged each; other columns are ignored.
    """
    host, path = parts(F.col(f"`{url_col}`").cast("string"))
    split = df.select(F.col(f"`{id_col}`"), host.alias("host"), path.alias("path"))
    judged = split.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("score", score(F.col("host"), F.col("path"), weights))
    own = F.when(F.col("score") >= cut, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "score")
