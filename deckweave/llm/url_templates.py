"""URL filters: rules, and for the rest a tree of path templates with labelled purity.

Only DataFrame functions are used. Paths are typed row by row (numbers, long hexadecimal and other
varying segments), so the tree is built from counts of typed paths and not from rows.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.session import cut_lineage

#: Levels of the tree; deeper segments are one last segment.
DEPTH = 3
#: A segment can stay a branch of its own from so many rows.
BRANCH_ROWS = 3
#: Sibling branches stay apart where their labelled rates differ by so many standard errors.
APART = 2.0
#: Labels that the rate of the parent counts for, and block rate beyond which a template is rejected.
PRIOR_LABELS = 4.0
REJECT = 0.8
#: Templates up to which their verdicts are broadcast; beyond, the join is salted so many times.
BROADCAST_TEMPLATES = 200_000
SALTS = 16


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as a struct of text and verdict, or null; ties go to the first by text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=False):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def typed_segments(path: Column) -> Column:
    """``DEPTH`` segments of a path with varying parts as wildcards; the last holds all deeper ones."""

    def kind(segment: Column) -> Column:
        return (
            F.when(segment.rlike(r"^[0-9]+$"), F.lit("{n}"))
            .when(segment.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.lit("{hex}"))
            .when(segment.rlike(r"[0-9]"), F.regexp_replace(segment, r"[0-9]+", "{n}"))
            .otherwise(segment)
        )

    segments = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), kind)
    deep = F.array_join(F.slice(segments, DEPTH, F.greatest(F.size(segments) - DEPTH + 1, F.lit(0))), "/")
    return F.when(F.size(segments) > DEPTH, F.concat(F.slice(segments, 1, DEPTH - 1), F.array(deep))).otherwise(segments)


def _ratio(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PRIOR_LABELS * prior) / (labelled + PRIOR_LABELS)


def _summed(tree: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """``tree`` with sums over its rows with the same keys.

    Partial sums and a join, no window: the paths of one host may be most of the tree.
    """
    sums = tree.groupBy(*by).agg(*[F.sum(name).alias(f"{prefix}_{name}") for name in ("n", "labels", "blocked")])
    return tree.join(sums, by)


def template_tree(labelled: DataFrame) -> DataFrame:
    """Rows ``host, segments, template, rate`` from rows ``host, segments, n, labels, blocked``.

    ``segments`` are typed; ``template`` has a wildcard wherever a branch has fewer than
    ``BRANCH_ROWS`` rows or its labelled rate is not apart from that of its siblings, whatever its
    share of them. ``rate`` is the smoothed share of
    blocked labels of the template, towards its parent's, the host's and in the end that of all.
    """
    stored = cut_lineage(labelled, "paths")
    whole = stored.agg(F.sum("blocked").alias("b"), F.sum("labels").alias("l")).first()
    overall = float((whole.b or 0) + 0.5) / float((whole.l or 0) + 1.0)
    kept = ["host", "segments", "n", "labels", "blocked", "template"]
    tree = _summed(stored.withColumn("template", F.array().cast("array<string>")), ["host"], "p")
    tree = tree.select(*kept, _ratio(F.col("p_blocked"), F.col("p_labels"), F.lit(overall)).alias("rate"))
    for level in range(DEPTH):
        # A path that has ended before this level has a segment that no path can have.
        tree = tree.withColumn("segment", F.coalesce(F.get("segments", F.lit(level)), F.lit("/")))
        tree = _summed(_summed(tree, ["host", "template"], "p"), ["host", "template", "segment"], "b")
        pooled = (F.col("p_blocked") + 0.5) / (F.col("p_labels") + 1.0)
        error = F.sqrt(pooled * (1 - pooled) / F.greatest(F.col("b_labels"), F.lit(1)))
        own = F.col("b_blocked") / F.greatest(F.col("b_labels"), F.lit(1))
        apart = (F.col("b_labels") > 0) & (F.abs(own - pooled) > APART * error)
        often = F.col("b_n") >= BRANCH_ROWS
        part = F.when(F.col("segment") == "/", F.lit("")).when(often & apart, F.col("segment")).otherwise(F.lit("*"))
        tree = tree.select(*kept[:-1], F.concat("template", F.array(part)).alias("template"), F.col("rate").alias("above"))
        tree = _summed(tree, ["host", "template"], "t")
        tree = cut_lineage(
            tree.select(*kept, _ratio(F.col("t_blocked"), F.col("t_labels"), F.col("above")).alias("rate")), "templates"
        )
    return tree.select("host", "segments", "template", "rate")


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", page_id: str = "page_id",
    label: Column | None = None,
) -> DataFrame:
    """Rows ``page_id, host, path, rule, verdict, template, rate``, one for each row of ``pages``.

    A rule decides where one fits. The others follow their template: ``block`` where its smoothed
    rate of blocked labels is over ``REJECT``, else ``allow``. Labels are ``label`` (a boolean
    column of ``pages``, null without one) or, without it, what the rules decide. A null URL, or
    one without ``://``, has an empty host and path. Repeated rows and null ids stay. Other columns
    are not carried.
    """
    value = F.col(f"`{url}`").cast("string")
    parsed = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), host_of(value).alias("host"), path_of(value).alias("path"),
        (F.lit(None).cast("boolean") if label is None else label.cast("boolean")).alias("label"),
    )
    ruled = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "segments", typed_segments(F.col("path"))
    )
    if label is None:
        ruled = ruled.withColumn("label", F.col("found.verdict") == "block")
    counted = ruled.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("label").alias("labels"), F.count_if("label").alias("blocked")
    )
    templates = template_tree(counted)
    if templates.count() <= BROADCAST_TEMPLATES:
        joined = ruled.join(F.broadcast(templates), ["host", "segments"], "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = ruled.withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        joined = spread.join(salted, ["host", "segments", "salt"], "left")
    by_rate = F.when(F.col("rate") > REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_rate).alias("verdict"), F.array_join("template", "/").alias("template"), "rate",
    )
