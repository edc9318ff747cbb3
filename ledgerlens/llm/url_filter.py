"""URLs accepted or rejected by two character models, with rules that go first. DataFrame functions only.

A model is a variable-order Markov model of characters, from order 0 to `order`, smoothed by interpolation:
a context's escape weight is its number of distinct followers (Witten-Bell). URLs are scored by the mean
log-likelihood difference per character between the model of accepted and that of rejected URLs, and pass
when the mean reaches a threshold that is calibrated on held-out URLs.

Characters are folded to a fixed alphabet (lower-case letters, one digit, marks, one sign for the rest), so
the table of log differences has at most 40 ** (order + 1) rows whatever the input; up to 3 million such
rows it is broadcast. Counting combines before the shuffle, so frequent strings are no hot keys.

Defined results: a null URL or one without `://` has empty host and path and is scored as an empty text;
rows with the same id stay separate rows; without training URLs of both kinds every score is 0 and the
verdict of the method is `allow`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.session import stage

ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:+~^"  # ~ stands for all others, ^ for start and end
ORDER = 3
BROADCAST_ROWS = 3_000_000
STEPS = 400  # thresholds tried, from -2 to 2 nats per character


def host_and_path(url: Column) -> tuple[Column, Column]:
    there = F.instr(url, "://") > 0
    rest = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest))
    empty = F.lit("")
    return F.coalesce(F.when(there, host), empty), F.coalesce(F.when(there, path), empty)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. A rule is `host/path`."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r)):
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def folded(url: Column, order: int) -> Column:
    text = F.lower(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), r"[^a-z0/.\-_?=&#%:+]", "~")
    return F.concat(F.lit("^" * order), text, F.lit("^"))


def grams(url: Column, order: int) -> Column:
    """Each character of a URL with `order` characters before it."""
    text = folded(url, order)
    return F.transform(F.sequence(F.lit(1), F.length(text) - order), lambda i: F.substring(text, i, F.lit(order + 1)))


def log_ratios(labelled: DataFrame, needed: DataFrame, order: int) -> DataFrame:
    """(gram, ratio) for the grams of `needed`: log p(accepted) - log p(rejected) of the last character.

    `labelled` has url and accepted (boolean).
    """
    seen = labelled.select("accepted", F.explode(grams(F.col("url"), order)).alias("gram"))
    counts = seen.groupBy("gram").agg(
        F.count_if("accepted").cast("double").alias("yes"), F.count_if(~F.col("accepted")).cast("double").alias("no")
    )
    log = {side: F.lit(1.0 / len(ALPHABET)) for side in ("yes", "no")}
    out = needed
    for k in range(order + 1):
        gram = F.substring("gram", order + 1 - k, k + 1)
        tally = counts.groupBy(gram.alias(f"g{k}")).agg(F.sum("yes").alias(f"yes{k}"), F.sum("no").alias(f"no{k}"))
        context = tally.groupBy(F.substring(f"g{k}", 1, k).alias(f"c{k}")).agg(
            *(F.sum(f"{s}{k}").alias(f"n_{s}{k}") for s in log), *(F.count_if(F.col(f"{s}{k}") > 0).alias(f"t_{s}{k}") for s in log)
        )
        out = out.withColumns({f"g{k}": gram, f"c{k}": F.substring("gram", order + 1 - k, k)})
        out = out.join(tally, f"g{k}", "left").join(context, f"c{k}", "left")
        for side in log:
            count, total, kinds = (F.coalesce(F.col(f"{p}{side}{k}"), F.lit(0.0)) for p in ("", "n_", "t_"))
            log[side] = F.when(total > 0, (count + kinds * log[side]) / (total + kinds)).otherwise(log[side])
        out = out.withColumns({f"p_{s}{k}": p for s, p in log.items()})
        log = {s: F.col(f"p_{s}{k}") for s in log}
    return out.select("gram", (F.log(log["yes"]) - F.log(log["no"])).alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame, order: int) -> DataFrame:
    """`urls` (row, url, ...) with the mean ratio per character."""
    keys = urls.columns
    table = F.broadcast(ratios) if len(ALPHABET) ** (order + 1) <= BROADCAST_ROWS else ratios
    parts = urls.select(*keys, F.explode(grams(F.col("url"), order)).alias("gram")).join(table, "gram", "left")
    return parts.groupBy(*keys).agg(F.coalesce(F.avg("ratio"), F.lit(0.0)).alias("score"))


def calibrated(held_out: DataFrame) -> DataFrame:
    """One row: the threshold with the best balanced accuracy over held-out (score, accepted), 0 if there are none.

    Scores are counted in STEPS bins first, so the running sums see a fixed number of rows.
    """
    spark = held_out.sparkSession
    bin_of = F.least(F.greatest(F.floor((F.col("score") + 2) * STEPS / 4), F.lit(0)), F.lit(STEPS - 1))
    bins = held_out.groupBy(bin_of.cast("int").alias("bin")).agg(
        F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")
    )
    upto = spark.range(STEPS).select(F.col("id").cast("int").alias("edge"))
    tried = upto.join(F.broadcast(bins), F.col("bin") >= F.col("edge"), "left").groupBy("edge").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")
    )
    total = bins.agg(F.greatest(F.sum("yes"), F.lit(1)).alias("all_yes"), F.greatest(F.sum("no"), F.lit(1)).alias("all_no"))
    gain = F.coalesce(F.col("yes"), F.lit(0)) / F.col("all_yes") - F.coalesce(F.col("no"), F.lit(0)) / F.col("all_no")
    # Ties go to the threshold nearest to 0, then to the lower one.
    best = F.max_by("edge", F.struct(F.round(gain, 9), -F.abs(F.col("edge") - STEPS // 2), -F.col("edge")))
    return tried.join(F.broadcast(total)).agg((F.coalesce(best, F.lit(STEPS // 2)) * 4.0 / STEPS - 2).alias("threshold"))


def is_held_out(url: Column) -> Column:
    """A fifth of the URLs, by a hash."""
    return F.conv(F.substring(F.md5(url), 1, 4), 16, 10).cast("int") % 5 == 0


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labelled: DataFrame | None = None,
    order: int = ORDER,
    id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score, threshold.

    `labelled` has url and accepted; without it, the URLs that a rule decides are the examples. A fifth of
    the distinct examples is held out for the threshold.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    fit = longest_rule(F.col("host"), F.col("path"), rules)
    if labelled is None:
        labelled = rows.withColumn("fit", fit).where("fit is not null").select("url", (F.col("fit.verdict") == "allow").alias("accepted"))
    labelled = labelled.select(F.coalesce("url", F.lit("")).alias("url"), "accepted").distinct()
    held = is_held_out(F.col("url"))
    needed = (
        rows.select("url").unionByName(labelled.where(held).select("url"))
        .select(F.explode(grams(F.col("url"), order)).alias("gram")).distinct()
    )
    # Staged once: the threshold and the scores read it.
    ratios = stage(log_ratios(labelled.where(~held), needed, order))
    threshold = calibrated(scores(labelled.where(held), ratios, order))
    scored = scores(rows.select("row", "id", "url"), ratios, order).join(F.broadcast(threshold))
    host, path = host_and_path(F.col("url"))
    scored = scored.withColumns({"host": host, "path": path}).withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    by_score = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return scored.select(
        F.col("id").alias(id), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_score).alias("verdict"), "score", "threshold",
    )
