"""URL filter: host and path rules first, character language models for the rest.

Rules are pairs of a host and a path prefix.  A rule fits its host and all subdomains if the url's path
starts with the rule's; the longest rule wins.  Urls that a rule decides train two variable-order Markov
models over the characters of host and path, one for accepted and one for rejected urls: contexts of 0 to
``order`` characters, each smoothed into the next shorter one by its number of different followers.  A
url is accepted if the difference of its log-likelihoods per character reaches a threshold, chosen on
labelled urls that the models haven't seen (every fifth, by its MD5).

Only DataFrame functions are used.  Grams are counted per label over all labelled urls, map-side first;
shorter contexts are sums of these counts; the scores of all grams are one table, to which the urls' grams
are joined.  Equal urls are scored once.  The threshold comes from a histogram of bounded size.

Defined cases: a null url, or one without ``://``, has an empty host and path (only rules for these could
fit); without labelled urls of both kinds every score is null and undecided urls are accepted; repeated
rows get equal verdicts; an empty table stays empty; columns that bear a result's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.session import stage

ORDER = 4
#: Kind, host, path.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEGIN, _END = "\u0002", "\u0003"
#: Steps of a score in the histogram that the threshold is taken from, and the largest score told apart.
_STEPS, _LARGEST = 500, 10


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest becomes the outermost
        _, h, p = rule
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def _grams(texts: DataFrame, order: int) -> DataFrame:
    """Every character of ``s``, and one for the end, with the ``order`` characters before it."""
    padded = F.concat(F.lit(_BEGIN * order), F.col("s"), F.lit(_END))
    return texts.withColumn("_p", padded).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("s") + 1))).withColumn("gram", F.substring(F.col("_p"), F.col("_i"), F.lit(order + 1))).drop("_p", "_i")


def gram_scores(labelled: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, score): log of the accepted model's probability over the rejected one's.

    ``labelled`` has (s, label), label allow or block; ``wanted`` (gram) the grams to score.
    """
    counted = _grams(labelled, order).groupBy("gram").agg(*[F.count(F.when(F.col("label") == k, 1)).alias(f"n_{k}") for k in ("allow", "block")])
    grams = wanted.select("gram").distinct().join(counted, "gram", "full").na.fill(0, ["n_allow", "n_block"])
    grams = stage(grams, "grams")
    by_order = grams.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(order)))).withColumn("tail", F.substring(F.col("gram"), F.lit(order + 1) - F.col("k"), F.col("k") + 1))
    tails = by_order.groupBy("k", "tail").agg(F.sum("n_allow").alias("n_allow"), F.sum("n_block").alias("n_block"))
    tails = tails.withColumn("context", F.substring(F.col("tail"), F.lit(1), F.col("k")))
    contexts = tails.groupBy("k", "context").agg(*[
        x for y in ("allow", "block") for x in (F.sum(f"n_{y}").alias(f"all_{y}"), F.count(F.when(F.col(f"n_{y}") > 0, 1)).alias(f"kinds_{y}"))
    ])
    # probability = own + rest * that of the next shorter context
    share = tails.join(contexts, ["k", "context"])
    share = share.select("k", "tail", *[
        x for y in ("allow", "block") for x in (
            F.when(F.col(f"all_{y}") == 0, 0.0).otherwise(F.col(f"n_{y}") / (F.col(f"all_{y}") + F.col(f"kinds_{y}"))).alias(f"own_{y}"),
            F.when(F.col(f"all_{y}") == 0, 1.0).otherwise(F.col(f"kinds_{y}") / (F.col(f"all_{y}") + F.col(f"kinds_{y}"))).alias(f"rest_{y}"),
        )
    ])
    alphabet = 1.0 / 256
    steps = by_order.select("gram", "k", "tail").join(share, ["k", "tail"]).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "own_allow", "rest_allow", "own_block", "rest_block"))).alias("steps"))
    chance = lambda y: F.aggregate("steps", F.lit(alphabet), lambda p, s: s[f"own_{y}"] + s[f"rest_{y}"] * p)
    return steps.select("gram", (F.log(chance("allow")) - F.log(chance("block"))).alias("score"))


def _threshold(scored: DataFrame) -> float:
    """The score with the best mean of both kinds' shares judged right; scored: (label, score)."""
    step = F.greatest(F.lit(-_LARGEST * _STEPS), F.least(F.lit(_LARGEST * _STEPS), F.round(F.col("score") * _STEPS))).cast("int")
    bins = scored.groupBy(step.alias("step")).agg(*[F.count(F.when(F.col("label") == y, 1)).alias(y) for y in ("allow", "block")]).orderBy("step").collect()
    allow, block = sum(r["allow"] for r in bins), sum(r["block"] for r in bins)
    if not allow or not block:
        return 0.0
    best, at, below_allow, below_block = -1.0, 0.0, 0, 0
    for before, r in zip([None, *bins], bins, strict=False):  # between two bins: all from r on are accepted
        right = (allow - below_allow) / allow + below_block / block
        if right > best:
            best, at = right, (r["step"] + (before["step"] if before else r["step"])) / 2 / _STEPS
        below_allow, below_block = below_allow + r["allow"], below_block + r["block"]
    return at


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """``pages`` (url) with host, path, rule, score and verdict.

    ``score`` is the log-likelihood difference per character; it is null where a rule decides.
    """
    host, path = parts(F.col("url"))
    pages = pages.drop("host", "path", "rule", "score", "verdict").withColumns({"host": host, "path": path}).withColumns({
        "rule": rule_of(F.col("host"), F.col("path"), rules, lambda r: r[1] + r[2]), "_kind": rule_of(F.col("host"), F.col("path"), rules, lambda r: r[0]),
    })
    texts = stage(pages.select(F.concat("host", "path").alias("s"), F.col("_kind").alias("label")).distinct(), "urls")
    held_out = F.conv(F.substring(F.md5("s"), 1, 6), 16, 10).cast("bigint") % 5 == 0
    asked = texts.where(F.col("label").isNull() | held_out)  # host and path decide the label, so each text is there once
    occurrences = _grams(asked.select("s"), order)
    trained = texts.where(F.col("label").isNotNull() & ~held_out)
    scores = gram_scores(trained.select("s", "label"), occurrences, order)
    per_url = stage(occurrences.join(scores, "gram").groupBy("s").agg(F.avg("score").alias("score")), "url-scores")
    kinds = {r["label"] for r in trained.select("label").distinct().collect()}
    usable = kinds >= {"allow", "block"}
    limit = _threshold(per_url.join(asked.where("label is not null").select("s", "label"), "s")) if usable else 0.0
    out = pages.withColumn("s", F.concat("host", "path")).join(per_url, "s", "left")
    score = F.when(F.col("_kind").isNull() & F.lit(usable), F.col("score"))
    return out.select(
        *[c for c in pages.columns if c != "_kind"], score.alias("score"),
        F.coalesce("_kind", F.when(score < limit, "block").otherwise("allow")).alias("verdict"),
    )
