"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Fixed base rules reject a document outright.  Further rules compare one statistic with a cutoff.
The cutoffs are not set by hand: labelled documents are the holdout, and for every stratum (the
language), rule and cutoff of a fixed grid the number of good documents that would be rejected is
counted.  A cutoff is certified if an exact binomial tail shows that the rule's false rejection
rate is at most ``risk`` shared out among the rules, at level ``delta`` divided by the number of
all hypotheses (Bonferroni), so that with probability 1 - delta all certified cutoffs of all
strata hold at once and no stratum loses more than ``risk`` of its good documents.  As every
cutoff of the grid is covered, any certified one may be chosen: the one that rejects most bad
documents over good ones, the mildest of equals.  A rule without a certified cutoff stays
switched off in its stratum, as in strata with few labels.

Edge cases: a null text has no words and fails the base rules, as an empty one does; a null
language is a stratum of its own; labels that are null or of unknown documents are not used, and
a document labelled twice counts by the mean of its labels (good from one half up); repeated rows
get the same verdict; an empty table gives no rows; extra columns are not read by the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm import common

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Words of a window whose recurrence marks its words as repeated.
WINDOW = 5
SYMBOLS = "#*$%&|<>"

#: Share of good documents that all calibrated rules together may reject, and the chance that this fails.
RISK, DELTA = 0.02, 0.05
#: More values of the stratum column than this are an error, not a language.
MAX_STRATA = 10_000
#: Statistics of the calibrated rules with their cutoffs; a document is rejected above a cutoff.
GRID = {
    "symbol_share": [0.02, 0.05, 0.1, 0.2, 0.3],
    "dup_line_share": [0.2, 0.3, 0.5, 0.7, 0.9],
    "repeat_share": [0.04, 0.08, 0.12, 0.16, 0.19],
    "same_word_share": [0.1, 0.2, 0.3, 0.4, 0.5],
}


def words_of(text: Column) -> Column:
    """Runs of characters other than blanks."""
    return F.filter(F.split(text, common.BLANKS + "+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often a lambda refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _window_hashes(words: Column) -> Column:
    """One number for each window of consecutive words; empty for shorter texts."""
    return F.when(F.size(words) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more.

    The starts of repeated windows follow from neighbours in hash order.  In text order each start
    covers the words up to the next start, the window's length at most.
    """
    def starts(order: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(order, i)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(order, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        let(order, starts), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"])


def statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The columns ``keep`` and the statistics of every whole text."""
    def of_words(w: Column) -> Column:
        repeated = let(_window_hashes(w), lambda h: F.when(
            F.size(h) > F.size(F.array_distinct(h)), _repeated_words(h)).otherwise(F.lit(0)))
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"),
                        repeated.alias("n_repeat_words"),
                        (F.size(w) - F.size(F.array_distinct(w))).alias("n_known_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    def of_text(t: Column) -> Column:
        return F.struct(
            let(words_of(t), of_words).alias("w"),
            let(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), of_lines).alias("l"),
            F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).alias("n_symbols"))

    out = docs.select(*keep, let(common.whole_text(text), of_text).alias("__cl_s"))
    s = F.col("__cl_s")
    return out.select(*keep, *[c.cast("long").alias(n) for n, c in [
        ("n_words", s["w"]["n_words"]), ("word_chars", s["w"]["word_chars"]), ("n_symbols", s["n_symbols"]),
        ("n_dup_lines", s["l"]["n_dup_lines"]), ("n_repeat_words", s["w"]["n_repeat_words"]),
        ("n_lines", s["l"]["n_lines"]), ("n_known_words", s["w"]["n_known_words"])]])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """The statistics of the calibrated rules, each between 0 and 1 and 0 for an empty text."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return {"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "same_word_share": F.greatest(F.lit(0.0), share("n_known_words", "n_words") - 0.5)}


def _log_gamma(x: Column) -> Column:
    """Stirling's series after eight steps of the recurrence; x >= 1."""
    steps = F.lit(0.0)
    for k in range(8):
        steps = steps + F.log(x + k)
    y = x + 8
    return ((y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y)
            + 1 / (1260 * F.pow(y, F.lit(5))) - steps)


def most_rejections(n: Column, risk: float, level: float) -> Column:
    """The largest k with P(Binomial(n, risk) <= k) <= level, or -1: k rejections or fewer among n
    good documents certify a rate of at most ``risk``.  Terms further than forty standard
    deviations below the mean are under the resolution of a double and left out."""
    n = n.cast("double")
    mean, sd = n * risk, F.sqrt(n * risk * (1 - risk))
    first = F.greatest(F.lit(0.0), F.floor(mean - 40 * sd).cast("double")).cast("long")
    term = lambda j: F.exp(_log_gamma(n + 1) - _log_gamma(j + 1.0) - _log_gamma(n - j + 1.0)
                           + j * F.log(F.lit(risk)) + (n - j) * F.log(F.lit(1 - risk)))
    fold = F.aggregate(
        F.sequence(first, F.ceil(mean).cast("long")),
        F.struct(F.lit(0.0).alias("p"), (first - 1).alias("k")),
        lambda a, j: let(a["p"] + term(j.cast("double")), lambda p: F.struct(
            p.alias("p"), F.when(p <= level, j).otherwise(a["k"]).alias("k"))),
        lambda a: a["k"])
    return F.when(n > 0, fold).otherwise(F.lit(-1).cast("long"))


def cutoffs(stats: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
            risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Stratum, rule, chosen cutoff (null: none certified) and the counts behind it.

    ``stats`` has the key, the stratum and :func:`statistics`; ``labels`` the key and ``quality``.
    Labelled rows collapse into counts by rule and grid step before any shuffle of results.
    """
    marked = labels.where("quality is not null").groupBy(key).agg((F.avg("quality") >= 0.5).alias("__cl_good"))
    rows = stats.where(~base_failed()).join(marked, key).select(stratum, "__cl_good", F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"),
                 sum(((value > c).cast("int") for c in GRID[name]), F.lit(0)).alias("step"))
        for name, value in rule_values().items()])).alias("r"))
    counted = rows.groupBy(stratum, "r.rule", "r.step").agg(
        F.count_if("__cl_good").alias("good"), F.count_if(~F.col("__cl_good")).alias("bad"))
    spread = common.written(counted.groupBy(stratum, "rule").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
        F.collect_list(F.struct("step", "good", "bad")).alias("steps")), "counts")
    strata = spread.select(stratum).distinct().limit(MAX_STRATA + 1).count()
    if strata > MAX_STRATA:
        raise ValueError(f"{stratum} has more than {MAX_STRATA} values")
    level = delta / max(1, strata * sum(map(len, GRID.values())))
    grid = F.create_map(*[x for name, cuts in GRID.items() for x in (
        F.lit(name), F.array(*[F.struct(F.lit(i + 1).alias("above"), F.lit(c).alias("cutoff")) for i, c in enumerate(cuts)]))])
    over = lambda part: F.aggregate("steps", F.lit(0).cast("long"), lambda a, s: a + F.when(
        s["step"] >= F.col("g.above"), s[part]).otherwise(0))
    tried = spread.withColumn("g", F.explode(grid[F.col("rule")])).select(
        stratum, "rule", "n_good", "n_bad", "g.cutoff", over("good").alias("good"), over("bad").alias("bad"))
    allowed = spread.groupBy(stratum).agg(F.max("n_good").alias("__cl_n")).select(
        F.col(stratum).alias("__cl_stratum"), most_rejections(F.col("__cl_n"), risk / len(GRID), level).alias("allowed"))
    certified = F.col("good") <= F.col("allowed")
    gain = (F.col("bad") - F.col("good")) / (F.col("n_bad") + F.col("n_good"))
    best = F.max(F.when(certified & (gain > 0), F.struct(
        gain.alias("gain"), "cutoff", F.col("good").alias("good_rejected"), F.col("bad").alias("bad_rejected"))))
    return tried.join(allowed, F.col(stratum).eqNullSafe(F.col("__cl_stratum"))).groupBy(stratum, "rule").agg(
        F.first("n_good").alias("n_good"), F.first("n_bad").alias("n_bad"), F.first("allowed").alias("allowed"),
        best.alias("best")).select(stratum, "rule", "n_good", "n_bad", "allowed", "best.cutoff",
                                   "best.good_rejected", "best.bad_rejected")


def with_verdict(stats: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add ``base_failed`` and ``kept``.  ``chosen`` holds a few rows for each stratum."""
    by_stratum = chosen.where("cutoff is not null").groupBy(F.col(stratum).alias("__cl_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("__cl_cutoffs"))
    # At most MAX_STRATA rows, as counted for the cutoffs.
    out = stats.join(F.broadcast(by_stratum), F.col(stratum).eqNullSafe(F.col("__cl_stratum")), "left")
    over = F.lit(False)
    for name, value in rule_values().items():
        over = over | F.coalesce(value > F.col("__cl_cutoffs")[name], F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~over).drop("__cl_stratum", "__cl_cutoffs")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, all statistics, base_failed and kept of every document."""
    stats = common.written(statistics(docs, keep=["doc_id", "lang"]), "statistics")
    return with_verdict(stats, common.written(cutoffs(stats, labels), "cutoffs"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The kept documents with their own columns.  Cutoffs come from the labelled ones; the verdict
    is made while the texts are read, so that no text is shuffled."""
    known = labels.select("doc_id").where("doc_id is not null").distinct()
    marked = statistics(docs.select("doc_id", "lang", "text"), keep=["doc_id", "lang"]).join(known, "doc_id", "left_semi")
    chosen = common.written(cutoffs(common.written(marked, "statistics"), labels), "cutoffs")
    whole = docs.select(F.struct(*docs.columns).alias("__cl_row"), F.col("lang").alias("lang"), F.col("text").alias("text"))
    judged = with_verdict(statistics(whole, keep=["__cl_row", "lang"]), chosen)
    # Inside a lambda the condition stays whole; its parts, pushed down, would compute the statistics again.
    return judged.where(F.exists(F.array("kept"), lambda x: x)).select("__cl_row.*")
