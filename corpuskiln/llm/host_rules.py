"""Host-level quality rules, all in built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import without, written

#: Fixed values of the base rules.
SYMBOLS, BLANK_RUN, LEAST_WORDS, MOST_REPEATED = "[#*$%&|<>]", r"[\x20\x09-\x0D]+", 50, 50

#: What each rule says of one document, over the counts of `counted`.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
BASE = ("short", "repetitive")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often and within whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_windows(words: Column, size: int = 3) -> Column:
    """How many words stand in windows of `size` words that the text holds twice or more.

    Each window's hash, with its position in the low bits, is sorted. Windows whose hash bits
    equal a neighbour's are compared word by word, so the count is exact.
    """
    n = F.size(words)
    whole = F.lit(size).cast("long")
    at = lambda i, k: F.get(words, i + F.lit(k) if k else i)
    low = F.expr("shiftleft(1L, 1)") * F.pow(F.lit(2.0), F.length(F.bin(n.cast("long")))).cast("long") - 1

    def positions(mask: Column) -> Column:
        """Positions of windows whose hash bits are those of another one."""
        high = F.bitwise_not(mask).bitwiseAND(F.lit((1 << 63) - 1))  # without the sign, so that two of one hash have a small XOR
        packed = lambda h: F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[at(i, k) for k in range(size)]).bitwiseAND(h).bitwiseOR(i.cast("long")))
        twin = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i).bitwiseXOR(F.get(s, i + 1)) <= mask)
        both = lambda s: F.transform(twin(s), lambda i: F.array(F.get(s, i).bitwiseAND(mask), F.get(s, i + 1).bitwiseAND(mask)))
        return bound(high, lambda h: bound(F.sort_array(packed(h)), lambda s: F.array_distinct(F.flatten(both(s)))))

    def repeated(found: Column) -> Column:
        """The positions among these whose words stand at another one too."""
        windows = F.sort_array(F.transform(found.cast("array<int>"), lambda i: F.struct(*[at(i, k).alias(f"w{k}") for k in range(size)], i.alias("i"))))
        twin = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: bound(F.get(s, j), lambda x: bound(F.get(s, j + 1), lambda y: F.forall(F.array(*[x[f"w{k}"] == y[f"w{k}"] for k in range(size)]), lambda same: same))))
        both = lambda s: F.transform(twin(s), lambda j: F.array(F.get(s, j)["i"], F.get(s, j + 1)["i"]))
        return bound(windows, lambda s: F.sort_array(F.array_distinct(F.flatten(both(s)))))

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, F.lit(2), F.greatest(F.lit(1), F.size(starts))), lambda p, after: F.coalesce(F.least(whole, (after - p).cast("long")), whole))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    count = bound(low, lambda mask: bound(positions(mask), lambda found: F.when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(bound(repeated(found), covered))))
    return F.when(n < size, F.lit(0).cast("long")).otherwise(count)


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    Null and empty texts have no words: all counts are 0. n_lines counts lines with a word.
    """
    base = without(docs, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, BLANK_RUN), "")
    each = bound(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_windows(w).alias("n_repeat_words")),
    )
    sizes = bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    # A generator keeps the structs from being worked out again for each field.
    own = base.select(*[F.col(f"`{c}`") for c in base.columns if c != text_col], F.inline(F.array(F.struct(each.alias("_w"), sizes.alias("_l"), symbols.alias("n_symbols")))))
    return own.select(*[F.col(f"`{c}`") for c in base.columns if c != text_col], "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")


def shrunk_rates(hosts: DataFrame, rules: list[str], most_precision: float = 1e6) -> DataFrame:
    """hosts (host, n, and a count f_<rule> of failures for each rule) plus rate_<rule> and mean_<rule>.

    A host's failures are binomial with a rate from a beta distribution that all hosts share. Its mean is the failures over
    all documents, its precision comes from the spread of the hosts' rates (method of moments, weighted by n): what a binomial alone spreads is
    taken off. The rate is the posterior mean. With a single host, hosts of one document each or no
    more spread than chance, all rates are close to the mean.
    """
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("total"), F.sum(n * n).alias("squares"), F.count("*").cast("double").alias("hosts")]
    for r in rules:
        f = F.col(f"f_{r}").cast("double")
        sums += [F.sum(f).alias(f"f_{r}"), F.sum(f * f / n).alias(f"s_{r}")]
    spread = hosts.agg(*sums)  # one row
    free = F.col("total") - F.col("squares") / F.col("total") - (F.col("hosts") - 1)
    priors = []
    for r in rules:
        mean = F.col(f"f_{r}") / F.col("total")
        chance = mean * (1 - mean)
        excess = F.try_divide(F.col(f"s_{r}") - F.col(f"f_{r}") * mean, chance) - (F.col("hosts") - 1)
        rho = F.when(free > 1e-9, F.try_divide(excess, free))
        rho = F.least(F.lit(0.999), F.greatest(F.lit(1 / most_precision), F.coalesce(rho, F.lit(0.0))))
        priors.append(F.struct(mean.alias("mean"), (1 / rho - 1).alias("precision")).alias(r))
    prior = spread.select(F.struct(*priors).alias("prior"))
    out = hosts.withColumn("prior", prior.scalar())
    for r in rules:
        mean, precision = F.col(f"prior.{r}.mean"), F.col(f"prior.{r}.precision")
        out = out.withColumns({f"rate_{r}": (mean * precision + F.col(f"f_{r}")) / (precision + n), f"mean_{r}": mean})
    return out.drop("prior")


def host_verdicts(docs: DataFrame, host_col: str = "source", text_col: str = "text", least_rate: float = 0.5, odds_ratio: float = 4.0) -> DataFrame:
    """docs without the text, plus the counts of `counted`, base_failed, host_rate, host_rejected and kept.

    Failures of each of RULES are summed for each host and shrunk (`shrunk_rates`). A host is rejected if for some rule its rate is
    at least least_rate and its odds are over odds_ratio times the odds of the mean, so a corpus where
    everything fails alike loses no host. host_rate is the largest of its rates. kept: not base_failed (the first two rules) and the
    host not rejected.

    Every row of docs has a row, repeated ones too; null hosts are one host. Counts are written once, texts are
    never shuffled, a hot host is summed before the shuffle. Columns of the names given here are replaced.
    """
    rules = list(RULES)
    own = ["base_failed", "host_rate", "host_rejected", "kept"]
    measured = written(counted(without(docs, *own), text_col), "rule-counts")
    fails = {r: F.expr(said) for r, said in RULES.items()}
    summed = measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *[F.count_if(fails[r]).alias(f"f_{r}") for r in rules])
    hosts = shrunk_rates(written(summed, "host-counts"), rules)
    bad = F.lit(False)
    for r in rules:
        rate, mean = F.col(f"rate_{r}"), F.col(f"mean_{r}")
        bad = bad | ((rate >= least_rate) & (rate * (1 - mean) > odds_ratio * mean * F.greatest(F.lit(0.0), 1 - rate)))
    verdict = written(hosts.select(F.col("host").alias("_host"), F.greatest(*[F.col(f"rate_{r}") for r in rules]).alias("host_rate"), bad.alias("host_rejected")), "hosts")
    base = F.lit(False)
    for r in BASE:
        base = base | fails[r]
    joined = measured.withColumn("base_failed", base).join(verdict, F.col(host_col).eqNullSafe(F.col("_host"))).drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
