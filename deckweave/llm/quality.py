"""Quality rules: base statistics of texts and robust outliers among them.

Only DataFrame functions run on the main path. Statistics come from each text alone. Per language
and source, a minimum-covariance-determinant estimate of the transformed statistics is found by
concentration steps: the three quarters of the texts nearest to the last estimate give the next
one. A step is one aggregation by group and bucket of distance, so that neither a group nor its
distances ever meet in one task, and all texts count.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckweave.llm.decontaminate import fresh
from deckweave.session import cut_lineage

#: Words of the window in which repeated words are looked for.
REPEAT_WINDOW = 5
#: Base rules: fewest words, most repeated words in a hundred.
LEAST_WORDS = 10
MOST_REPEATED = 20
#: Texts that the estimate of a language counts for in that of a group, and that of all texts in that
#: of a language: a small group is near them, a large one near its own texts, without a step between.
PRIOR_TEXTS = 40.0
#: Share of a group that an estimate rests on, most concentration steps, and change that ends them.
SUBSET = 0.75
STEPS = 8
SETTLED = 1e-3
#: A text is rejected beyond this quantile of the chi-squared distribution.
CUTOFF = 0.9999
#: Standard deviations that estimates have at least, one for each statistic below: as many texts
#: have none of a kind, their spread can be 0, and a text with few would be far from all. Each is
#: well under the range of its statistic by the root of the cutoff (4.85), so that each can reject
#: alone: in a group without any, beyond about 14 % of lines or 9 % of words.
FLOORS = (0.1, 0.4, 0.7, 0.6)
#: Correlation that goes with the floors: a repeated line is repeated words as well, so that both
#: together are no more than either.
TOGETHER = {(3, 2): 0.6}
#: Words of the usual length, lines and words without repetition that are added to each text for its
#: statistics: one repeated line of a short text tells little.
PRIOR_WORDS, PRIOR_LENGTH, PRIOR_LINES, PRIOR_REPEATS = 20, 5, 10, 30
STATISTICS = ("word_length", "symbols", "dup_lines", "repeats")
_D = len(STATISTICS)
#: Buckets for each doubling of 1 + distance, and of a statistic's unit.
_FINE = 32

#: White space between words, symbols.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"


def _no_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` and a struct of the statistics of each text; a null text has no words.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word), ``n_dup_lines``
    (of those, equal to an earlier one), ``n_repeat_words`` (words in windows of five that occur
    twice or more).
    """
    t, w, g, d, lines = fresh(docs, "q_text", "q_words", "q_grams", "q_double", "q_lines")
    own = [F.col(f"`{c}`") for c in docs.columns]
    words, size = F.col(w), F.size(w)
    hashes = fresh(docs, "q_hashes")[0]
    gram = F.transform(
        F.sequence(F.lit(0), size - REPEAT_WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(REPEAT_WINDOW)]),
    )
    # Windows as texts only where two have the same hash: words hold no blank, so they stay apart.
    written = F.transform(
        F.sequence(F.lit(0), size - REPEAT_WINDOW),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, REPEAT_WINDOW), " ").alias("gram"), i.alias("at")),
    )
    staged = (
        docs.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
        .withColumn(w, F.array_remove(F.split(F.col(t), SPACE), ""))
        .withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda line: line.rlike(NOT_SPACE)))
        .withColumn(hashes, F.transform(words, lambda x: F.xxhash64(x)))
        .withColumn(g, F.when(size >= REPEAT_WINDOW, gram))
        .withColumn(d, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(written)))
    )
    doubles = F.col(d)
    repeated = F.filter(
        doubles,
        lambda x, i: F.coalesce(x["gram"] == F.get(doubles, i - 1)["gram"], F.lit(False))
        | F.coalesce(x["gram"] == F.get(doubles, i + 1)["gram"], F.lit(False)),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["at"])),
        start,
        lambda done, at: F.struct(
            (at + REPEAT_WINDOW).alias("end"), (done["n"] + at + REPEAT_WINDOW - F.greatest(done["end"], at)).alias("n")
        ),
        lambda done: done["n"],
    )
    stats = F.struct(
        size.cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
    )
    return staged.select(*own, stats.alias(name))


def base_failed(stats: str) -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def _vector(stats: str) -> list[Column]:
    """Transformed statistics: near symmetric, rounded so that their sums do not depend on order."""
    n, chars = F.col(f"{stats}.n_words"), F.col(f"{stats}.word_chars")
    raw = (
        F.log((chars + PRIOR_WORDS * PRIOR_LENGTH) / (n + PRIOR_WORDS)),
        F.log1p(100.0 * F.col(f"{stats}.n_symbols") / F.greatest(chars, F.lit(1))),
        F.log1p(100.0 * F.col(f"{stats}.n_dup_lines") / (F.col(f"{stats}.n_lines") + PRIOR_LINES)),
        F.log1p(100.0 * F.col(f"{stats}.n_repeat_words") / (n + PRIOR_REPEATS)),
    )
    return [F.rint(x * 1024) / 1024 for x in raw]


def _floor(i: int, j: int) -> float:
    """Least covariance of two statistics, the same in every estimate."""
    return FLOORS[i] * FLOORS[j] * (1.0 if i == j else TOGETHER.get((i, j), 0.0))


def _key(*columns: Column) -> Column:
    """A text that tells all values of the columns apart, null included."""
    marked = [F.coalesce(F.concat(F.lit("="), F.regexp_replace(c.cast("string"), "([\\\\/])", "\\\\$1")), F.lit("-")) for c in columns]
    return F.concat_ws("/", *marked)


def _quantiles(counted: DataFrame, by: list[str], q: float) -> DataFrame:
    """By group, the first bucket at which the share ``q`` of rows is reached."""
    upto = Window.partitionBy(*by).orderBy("bucket")
    whole = Window.partitionBy(*by)
    return (
        counted.select(*by, "bucket", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("all"))
        .where(F.col("upto") >= F.ceil(F.col("all") * q))
        .groupBy(*by)
        .agg(F.min("bucket").alias("bucket"))
    )


def chi_squared_quantile(p: float, dof: int) -> float:
    """Quantile for an even number of degrees of freedom, by halving an interval."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def _with_factor(estimates: DataFrame, *keep: str) -> DataFrame:
    """Means ``m0…`` and covariances ``c00…`` to means and the lower Cholesky factor ``l00…``; ``keep`` stays."""
    for i in range(_D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
            estimates = estimates.withColumn(f"l{i}{j}", value)
    names = [f"m{i}" for i in range(_D)] + [f"{kind}{i}{j}" for kind in "cl" for i in range(_D) for j in range(i + 1)]
    logdet = sum((2 * F.log(f"l{i}{i}") for i in range(_D)), F.lit(0.0))
    return estimates.select("group", *names, logdet.alias("logdet"), *keep)


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance by the factor, solved forwards."""
    y: list[Column] = []
    for i in range(_D):
        rest = x[i] - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def estimates(scored: DataFrame, stats: str, groups: DataFrame) -> DataFrame:
    """Per group: mean, factor and the factor that turns distances into chi-squared values.

    Each source and language, each language, and the whole have an estimate of their own; those of
    the groups are drawn towards the wider ones by ``PRIOR_TEXTS``. ``scored`` is read once a step, so it has to
    be a stored table. Deterministic: starts from medians and median deviations, sums of rounded
    values, whole buckets.
    """
    x = [F.col(f"x{i}") for i in range(_D)]
    # Written once with their groups: a step then joins the estimates alone.
    rows = cut_lineage(
        scored.where(~base_failed(stats))
        .select("lang_key", "source_key", *[v.alias(f"x{i}") for i, v in enumerate(_vector(stats))])
        .join(groups, ["lang_key", "source_key"])
        .select("group", "lang_group", "all_group", *x),
        "vectors",
    )
    own_rows = rows.select("group", *x)
    rows = rows.select(F.explode(F.array("group", "lang_group", "all_group")).alias("group"), *x)
    tall = rows.select("group", F.posexplode(F.array(*x)).alias("i", "x"))
    bucket = F.floor(F.col("x") * _FINE)
    medians = cut_lineage(
        _quantiles(tall.groupBy("group", "i", bucket.alias("bucket")).agg(F.count("*").alias("n")), ["group", "i"], 0.5)
        .select("group", "i", ((F.col("bucket") + 0.5) / _FINE).alias("m")),
        "medians",
    )
    off = F.floor(F.abs(F.col("x") - F.col("m")) * _FINE)
    # The median goes along in the keys, so that it needs no join with what is found by it.
    spreads = _quantiles(
        tall.join(medians, ["group", "i"]).groupBy("group", "i", "m", off.alias("bucket")).agg(F.count("*").alias("n")),
        ["group", "i", "m"], 0.5,
    ).select("group", "i", "m", (1.4826 * (F.col("bucket") + 0.5) / _FINE).alias("s"))
    floor = F.element_at(F.array(*map(F.lit, FLOORS)), F.col("i") + 1)
    wide = (
        spreads.groupBy("group")
        .agg(
            *[F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m{i}") for i in range(_D)],
            *[F.max(F.when(F.col("i") == i, F.pow("s", F.lit(2)) + floor * floor)).alias(f"c{i}{i}") for i in range(_D)],
        )
    )
    beside = {f"c{i}{j}": F.lit(_floor(i, j)) for i in range(_D) for j in range(i)}
    current = cut_lineage(_with_factor(wide.withColumns(beside)), "estimates")
    for _ in range(STEPS):
        following = cut_lineage(_with_factor(_concentrated(rows, current), "before"), "estimates")
        moved = following.coalesce(1).agg(F.max(F.abs(F.col("logdet") - F.col("before"))).alias("moved")).first().moved
        current = following.drop("before")
        if moved is None or moved < SETTLED:
            break
    shrunk = cut_lineage(_with_factor(_shrunk(current, groups)), "estimates")
    spread = _quantiles(_by_distance(own_rows, shrunk).agg(F.count("*").alias("n")), ["group"], 0.5)
    middle = chi_squared_quantile(0.5, _D)
    scale = F.greatest(F.pow(F.lit(2.0), (F.col("bucket") + 1) / _FINE) - 1, F.lit(1e-6)) / middle
    # Never narrower than the estimate itself, whose floors are meant as they are; and for few texts near
    # it, as their own distances tell little about their spread.
    own = F.col("n") / (F.col("n") + PRIOR_TEXTS)
    wider = 1 + own * (F.greatest(scale, F.lit(1.0)) - 1)
    return shrunk.join(spread, "group").join(groups.select("group", "n"), "group").select(*shrunk.columns, wider.alias("scale"))


def _shrunk(current: DataFrame, groups: DataFrame) -> DataFrame:
    """Means and covariances of the groups, drawn towards those of their language, and these to the whole's."""
    names = [f"m{i}" for i in range(_D)] + [f"c{i}{j}" for i in range(_D) for j in range(i + 1)]
    joined = groups.select("group", "lang_group", "all_group", "n", "n_lang")
    for kind, key in (("own", "group"), ("lang", "lang_group"), ("all", "all_group")):
        part = current.select(F.col("group").alias(key), *[F.col(name).alias(f"{kind}_{name}") for name in names])
        joined = joined.join(part, key)
    own = F.col("n") / (F.col("n") + PRIOR_TEXTS)
    lang = F.col("n_lang") / (F.col("n_lang") + PRIOR_TEXTS)
    return joined.select("group", *[
        (own * F.col(f"own_{c}") + (1 - own) * (lang * F.col(f"lang_{c}") + (1 - lang) * F.col(f"all_{c}"))).alias(c) for c in names
    ])


def _by_distance(rows: DataFrame, current: DataFrame):
    far = F.floor(F.log2(1 + _distance([F.col(f"x{i}") for i in range(_D)])) * _FINE)
    return rows.join(current, "group").withColumn("bucket", far).groupBy("group", "bucket")


def _concentrated(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Mean and covariance of the nearest share of each group, up to the bucket that reaches it.

    ``before`` is the determinant of the estimate that the distances come from.
    """
    x = [F.col(f"x{i}") for i in range(_D)]
    pairs = [(i, j) for i in range(_D) for j in range(i + 1)]
    summed = _by_distance(rows, current).agg(
        F.count("*").alias("n"),
        F.max("logdet").alias("before"),
        *[F.sum(x[i]).alias(f"s{i}") for i in range(_D)],
        *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in pairs],
    )
    upto, whole = Window.partitionBy("group").orderBy("bucket"), Window.partitionBy("group")
    near = (
        summed.withColumn("upto", F.sum("n").over(upto))
        .withColumn("all", F.sum("n").over(whole))
        .where(F.col("upto") - F.col("n") < F.ceil(F.col("all") * SUBSET))
        .groupBy("group")
        .agg(
            F.sum("n").alias("n"),
            F.max("before").alias("before"),
            *[F.sum(f"s{i}").alias(f"s{i}") for i in range(_D)],
            *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i, j in pairs],
        )
    )
    return near.select(
        "group",
        "before",
        *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(_D)],
        *[
            (
                F.col(f"p{i}{j}") / F.col("n")
                - F.col(f"s{i}") * F.col(f"s{j}") / (F.col("n") * F.col("n"))
                + _floor(i, j)
            ).alias(f"c{i}{j}")
            for i, j in pairs
        ],
    )


def _groups(scored: DataFrame, stats: str) -> DataFrame:
    """Per language and source the groups that its texts count in: its own, its language's, the whole.

    ``n`` and ``n_lang`` are the texts of the first two that the base rules leave; others have no row.
    """
    counted = scored.where(~base_failed(stats)).groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    by_lang = counted.join(counted.groupBy("lang_key").agg(F.sum("n").alias("n_lang")), "lang_key")
    return by_lang.select(
        "lang_key", "source_key", "n", "n_lang",
        F.concat_ws("/", F.lit("s"), "lang_key", "source_key").alias("group"),
        F.concat_ws("/", F.lit("l"), "lang_key").alias("lang_group"),
        F.lit("all").alias("all_group"),
    )


def judged(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    keep: list[str] | None = None, cutoff: float = CUTOFF,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) as a struct ``row``, ``stats`` and verdicts.

    Further columns: ``base_failed``, ``distance`` (scaled squared distance; null without an
    estimate) and ``kept``: false where the base rules fail or the distance is beyond ``cutoff``.
    One row for each row of ``docs``, repeated or not. A null text has no words and fails. Null
    languages and sources are groups of their own. The fewer texts a group has, the more its estimate
    is that of its language, and of all texts; a text alone in its table is near itself and kept. An
    empty table gives an empty table.
    """
    names = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{name}`") for name in names]).alias("row")
    plain = docs.select(row, F.col(f"`{text}`").alias("text"), _key(F.col(f"`{lang}`")).alias("lang_key"), _key(F.col(f"`{source}`")).alias("source_key"))
    scored = cut_lineage(with_statistics(plain).select("row", "lang_key", "source_key", "stats"), "scored")
    groups = cut_lineage(_groups(scored, "stats"), "groups")
    found = cut_lineage(
        groups.select("lang_key", "source_key", "group").join(estimates(scored, "stats", groups), "group"), "estimates"
    )
    most = chi_squared_quantile(cutoff, _D)
    distance = _distance(_vector("stats")) / F.col("scale")
    return (
        scored.join(found, ["lang_key", "source_key"], "left")
        .select("row", "stats", base_failed("stats").alias("base_failed"), distance.alias("distance"))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= most, F.lit(True)))
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were."""
    return judged(docs, text, lang, source, cutoff=cutoff).where("kept").select("row.*")


def verdicts(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id``, the base statistics, ``base_failed`` and ``kept``."""
    found = judged(docs.select(doc_id, "text", "lang", "source"), keep=[doc_id])
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select(F.col(f"row.{doc_id}").alias(doc_id), *[f"stats.{s}" for s in stats], "base_failed", "kept", "distance")
