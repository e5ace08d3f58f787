"""Secret scans: candidates by pattern, false positives removed by a random forest.

Only DataFrame functions and Spark's own forest run on the main path. The forest is trained on a
bounded sample of labelled findings.
"""

import json
import math
import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckweave.llm.decontaminate import fresh
from deckweave.session import cut_lineage

#: Characters of context before and after a candidate.
BEFORE, AFTER = 48, 24
#: Labelled findings of each label that the forest is trained on, chosen by hash; words of the
#: dictionary for each language.
TRAINING_FINDINGS = 2000
DICTIONARY_WORDS = 500
TREES, TREE_DEPTH = 30, 8
#: Candidates of a text whose sizes are added up together: offsets take time in proportion to their number.
BLOCK = 256
#: Probability from which a candidate counts as a secret.
SECRET = 0.5
MARK = "[SECRET]"

#: Neighbouring words that go with secrets, and with values that only look like one.
SECRET_WORDS = r"(?i)(token|secret|passw|api.?key|access.?key|auth|credential|private|bearer)"
HARMLESS_WORDS = (
    r"(?i)(sha\d*|md5|checksum|commit|digest|uuid|guid|isbn|phone|card|order|example|sample|integrity|base64|author(?!i)|header|version|etag)"
)
#: What stands before a value that is assigned to a name with a secret word (the short
#: look behind spares the long one at most places), or after the word of an authorization header.
_NAMED = (
    r"(?<=[=:>]\s{0,8}\\?[\"'`]?)(?<=(?i:token|secret|passw|passphrase|pwd|\bpw|api.?key|access.?key|auth|credential|private)"
    r"[A-Za-z0-9_.-]{0,32}[\"'`\\\]]{0,3}\s{0,8}(?::=|=>|==|[=:>])\s{0,8}\\?[\"'`]?)"
)
_HEADER = r"(?<=(?i:bearer|basic|token)\s{1,4})(?<=(?i:bearer|auth[a-z-]{0,16}[\"']?\s{0,4}[:=]\s{0,4}[\"']?(?:basic|token))\s{1,4})"
#: Fixed value: a value up to its closing quote, or else to white space or a mark that ends it.
_VALUE = (
    r"(?:(?<=\")[^\"\r\n]{7,}[^\"\r\n\\](?=\\?\")|(?<=')[^'\r\n]{7,}[^'\r\n\\](?=\\?')|(?<=`)[^`\r\n]{7,}[^`\r\n\\](?=\\?`)"
    r"|[^\s\"'`<>,;&]{7,}[^\s\"'`<>,;&.:!?)\]}\\])"
)
#: Fixed value: a run of 16 characters or more that values of secrets are written in, with a digit;
#: '=' is in it only as padding at its end, so that a name before it stands in the text before.
_RUN = (
    r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*+[0-9])[A-Za-z0-9+/_.@-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=.@-]))?"
)
#: Fixed value: the password of a user in an address.
_IN_ADDRESS = r"(?<=:)(?<=://[^\s/@:\"']{1,64}:)[^\s/@:\"']{6,}+(?=@)"
#: Fixed value: values behind a secret word from 8 characters on, bodies of private keys, other runs.
CANDIDATE = rf"{_IN_ADDRESS}|{_NAMED}{_VALUE}|{_HEADER}{_VALUE}|(?<=-----)(?<=-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----)[^-]{{16,}}+|{_RUN}"
ASSIGNED = r"[=:]\s*[\"'`]?$"

FEATURES = (
    "length", "digits", "upper", "distinct", "changes", "transitions", "coverage", "slashes", "dots", "at_sign",
    "in_path", "secret_word", "harmless_word", "assigned", "quoted", "same_kind", "known_key", "code", "in_address", "like_name",
)
#: Fixed value: what stands between words of any script.
NO_LETTERS = r"[^\p{L}]+"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def candidates(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """One row per candidate: the columns of ``docs`` and a struct, whose name is returned too.

    The struct has ``place`` (how many candidates stand before it), ``start`` (character offset),
    ``value``, ``before`` and ``after``. A null or empty text has no candidate.
    """
    found, values, gaps, sizes, sums = fresh(docs, "found", "values", "gaps", "sizes", "sums")
    value, own = F.col(f"`{text}`").cast("string"), [F.col(f"`{c}`") for c in docs.columns]
    gap, v, size = F.col(gaps), F.col(values), F.col(sizes)
    zero = F.lit(0).cast("bigint")
    summed = lambda parts: F.aggregate(parts, zero, lambda n, x: n + x)
    blocks = F.sequence(F.lit(0), (F.size(size) / BLOCK).cast("int"))
    of_block = F.transform(blocks, lambda b: summed(F.slice(size, b * BLOCK + 1, F.lit(BLOCK))))
    staged = (
        docs.withColumn(values, F.regexp_extract_all(value, F.lit(CANDIDATE), F.lit(0)))
        .withColumn(gaps, F.when(F.size(v) > 0, F.split(value, CANDIDATE)))
        # What a candidate and the gap before it take; then sums of blocks of them, and of blocks up to each.
        .withColumn(sizes, F.zip_with(F.slice(gap, F.lit(1), F.size(v)), v, lambda g, x: (F.length(g) + F.length(x)).cast("bigint")))
        .withColumn(sums, F.when(F.size(v) > 0, of_block))
    )
    whole = F.col(sums)
    staged = staged.withColumn(sums, F.transform(whole, lambda _, b: summed(F.slice(whole, F.lit(1), b))))
    # Values have 8 characters or more: so many before, with what lies between, reach over the context.
    near = BEFORE // 8

    def before(i: Column) -> Column:
        first = F.greatest(i - near, F.lit(0)) + 1
        pairs = F.zip_with(F.slice(gap, first, F.lit(near)), F.slice(v, first, F.lit(near)), lambda g, x: F.concat(g, x))
        earlier = F.array_join(F.slice(pairs, F.lit(1), F.least(i, F.lit(near))), "")
        return F.right(F.concat(earlier, F.get(gap, i)), F.lit(BEFORE))

    def start(i: Column) -> Column:
        block = (i / BLOCK).cast("int")
        within = summed(F.slice(size, block * BLOCK + 1, i - block * BLOCK))
        return F.get(F.col(sums), block) + within + F.length(F.get(gap, i))

    each = F.transform(
        v,
        lambda x, i: F.struct(
            i.alias("place"), start(i).alias("start"), x.alias("value"),
            before(i).alias("before"), F.left(F.get(gap, i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    # The outer form: for the other one Spark first tests, below all these steps, whether there are any.
    made = staged.select(*own, F.explode_outer(each).alias(found))
    return made.where(F.col(f"{found}.value").isNotNull()), found


class Language:
    """Frequent words of each language and letter transitions of the corpus, as literals of bounded size.

    Counted over all texts. Without a column ``lang`` the texts are one language.
    """

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang"):
        value = F.col(f"`{text}`").cast("string")
        named = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
        texts = docs.select(named.alias("lang"), F.lower(value).alias("text"))
        words = texts.select("lang", F.explode(F.split("text", NO_LETTERS)).alias("word")).where(F.length("word") >= 3)
        counted = cut_lineage(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
        # The limit by language is applied by each task before rows of a language meet.
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        top = counted.withColumn("rank", rank).where(F.col("rank") <= DICTIONARY_WORDS)
        self.words = sorted(row.word for row in top.select("word").distinct().collect())
        places = F.sequence(F.lit(1), F.length("word") - 1)
        pair = F.explode(F.transform(places, lambda i: F.substring("word", i, F.lit(2)))).alias("pair")
        size = len(_LETTERS)
        pairs = [[0.5] * size for _ in range(size)]
        known = F.col("pair").rlike("^[a-z]{2}$")
        for row in counted.select("n", pair).where(known).groupBy("pair").agg(F.sum("n").alias("n")).collect():
            pairs[_LETTERS.index(row.pair[0])][_LETTERS.index(row.pair[1])] += row.n
        self.transitions = [math.log(n / sum(line) * size) for line in pairs for n in line]

    def coverage(self, value: Column) -> Column:
        """Share of the characters that are in dictionary words."""
        known = F.from_json(F.lit(json.dumps(self.words)), "array<string>")
        parts = F.split(F.lower(value), NO_LETTERS)
        inside = F.filter(parts, lambda part: F.array_contains(known, part))
        return F.length(F.array_join(inside, "")) / F.length(value)

    def transition(self, value: Column) -> Column:
        """Mean logarithm of how much more often than by chance each character follows the last."""
        table = F.from_json(F.lit(json.dumps(self.transitions)), "array<double>")
        size = len(_LETTERS)
        low = F.regexp_replace(F.lower(value), "[^a-z0-9]", "")

        def at(i: Column) -> Column:
            return F.instr(F.lit(_LETTERS), F.substring(low, i, F.lit(1))) - 1

        places = F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1)))
        total = F.aggregate(
            places, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(table, (at(i) * size + at(i + 1)).cast("int")), F.lit(0.0))
        )
        return F.when(F.length(low) > 1, total / (F.length(low) - 1)).otherwise(0.0)


def _share(value: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kind}]", "")) / F.length(value)


def with_features(found: DataFrame, name: str, language: Language) -> DataFrame:
    """``found`` and a column ``features`` of doubles, in the order of ``FEATURES``."""
    value, before, after = (F.col(f"{name}.{x}") for x in ("value", "before", "after"))
    changes = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    columns = {
        "length": F.log(F.length(value)),
        "digits": _share(value, "0-9"),
        "upper": _share(value, "A-Z"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.sqrt(F.length(value)),
        "changes": F.regexp_count(value, F.lit(changes)) / F.length(value),
        "transitions": language.transition(value),
        "coverage": language.coverage(value),
        "slashes": F.length(value) - F.length(F.replace(value, F.lit("/"))),
        "dots": F.length(value) - F.length(F.replace(value, F.lit("."))),
        "at_sign": value.contains("@").cast("int"),
        "in_path": (before.rlike(r"(://|[/\\])[^\s]*$") | value.contains("/")).cast("int"),
        "secret_word": before.rlike(SECRET_WORDS).cast("int"),
        "harmless_word": before.rlike(HARMLESS_WORDS).cast("int"),
        "assigned": before.rlike(ASSIGNED).cast("int"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("int"),
        "known_key": (value.rlike(KNOWN_KEYS) | before.rlike(KEY_BLOCK)).cast("int"),
        "code": value.rlike(r"[(){}\[\]]|^https?:|(?i)^your|example|change.?me").cast("int"),
        "same_kind": value.rlike(r"^([0-9]+|[A-Za-z]+)$").cast("int"),
        "in_address": (before.rlike(r"://[^\s/@:]+:$") & after.startswith("@")).cast("int"),
        "like_name": value.rlike(r"^(?:[A-Z]?[a-z]*[0-9]{0,4}[-_. ])*+[A-Z]?[a-z]{2,}[0-9]{0,4}$").cast("int"),
    }
    return found.withColumn("features", F.array(*[columns[f].cast("double") for f in FEATURES]))


#: Fixed value: forms that only keys have: prefixes of well-known issuers, signed tokens.
KNOWN_KEYS = (
    r"^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{20,}"
    r"|xox[abpr]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})$"
)
#: Fixed value: what stands before the body of a private key.
KEY_BLOCK = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----$"


def weak_labels(found: DataFrame, name: str) -> Column:
    """A label for findings that are plain cases, null for the others.

    1: a key by its own form or a body of a private key, whatever stands around it; letters and
    digits of 16 characters or more, assigned to a word that goes with secrets, in quotes or not.
    0: numbers, addresses, paths, words that go with harmless values. Other findings, those that are
    not assigned too, have no label.
    """
    value, before = F.col(f"{name}.value"), F.col(f"{name}.before")
    mixed = value.rlike("^[A-Za-z0-9+/=_-]{16,}$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    last_words = F.right(before, F.lit(24))
    known = value.rlike(KNOWN_KEYS) | before.rlike(KEY_BLOCK)
    secret = mixed & last_words.rlike(SECRET_WORDS) & before.rlike(ASSIGNED)
    harmless = value.rlike("^[0-9]+$") | value.contains("@") | value.rlike("^[A-Za-z./_-]+[0-9]?$") | last_words.rlike(HARMLESS_WORDS)
    return F.when(known, 1.0).when(harmless & ~secret, 0.0).when(secret & ~last_words.rlike(HARMLESS_WORDS), 1.0)


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
#: Forms in which secrets and harmless values stand; names that go with each.
_SECRET_FORMS = (
    '{n} = "{v}"', "{n}: {v}", "export {N}={v}", "{N}={v}", "{n} = '{v}'", '{{"{n}": "{v}"}}', "https://a.io/cb?{n}={v}&x=1",
    "Authorization: Bearer {v}", "X-Api-Key: {v}", "--{n}={v}", "<{n}>{v}</{n}>", "{n} := `{v}`", "mysql://{w}:{v}@{w}.com/{w}",
)
_SECRET_NAMES = ("token", "api_key", "secret", "password", "db_password", "access_key", "client_secret", "auth_token")
_HARMLESS_FORMS = (
    "commit {h}", "sha256: {h}", 'checksum = "{h}"', 'id = "{u}"', "uuid: {u}", "see /usr/share/{w}/{w}{d}/{w}-{w}.txt", "{w}.{w}{d}@{w}.example.com",
    "https://www.{w}.com/{w}/{w}-{w}-{d}{d}", "order {d}{d}{d}{d}", '{n} = "{w}_{w}_{w}"', "{n}: {w}{w}", "author: {w}{w}", "{n} = get_{w}({w}_{w})",
    '{n} = "your-{n}-here"', "{N}=${{{N}_{w}}}", "version-{d}-{w}-{w}-{d}", "the {n}: {w}{w} {w}", '{n}_url = "https://{w}.com/{w}/{w}{d}"',
    '{n}_file = "/etc/{w}/{w}/{w}{d}.json"', 'integrity="sha384-{b}"', 'src="data:image/png;base64,{b}{b}{b}"', '{N}_HEADER = "X-{w}-Key{d}-{w}"',
    'author = "{w}{w}{d}"', "{n}_name: {w}-{w}{d}-{w}", "by {w}{w}{d}", "{w} {b} {w}", "{w} ({b})", '{N}_{w} = "{w}-{w}{d}-{w}"', "https://{w}.com:8080/{w}@{w}/{w}{d}{d}", "{w}_{w}_{w}_{d}={w}", 'etag = "{h}"', "digest={h}",
)


def composed(spark) -> DataFrame:
    """Rows ``text, secret``: texts in the forms above, of which ``secret`` is one or null; always the same.

    A third of the secrets are keys by their own form or bodies of private keys, without an
    assignment, quotes or a word that goes with secrets before them.
    """
    rng = random.Random(17)
    mixed = _LOWER + _LOWER.upper() + _DIGITS
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    word = lambda: "".join(rng.choice("bdfklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    rows = []
    for i in range(1200):
        name = rng.choice(_SECRET_NAMES)
        value = (
            draw("0123456789abcdef", rng.choice((32, 40, 64))), draw("0123456789ABCDEF", 40), draw(mixed, rng.randint(20, 48)),
            draw(mixed + "+/", 40), word().title() + draw(_DIGITS, 3) + rng.choice("!&#%$*") + draw(mixed, 5), draw(mixed + "!#%$*", 12),
        )[i % 6]
        form = rng.choice(_SECRET_FORMS)
        if "@" in form:
            value = "".join(c for c in value if c not in "/@:+")
        text = form.format(n=name, N=name.upper(), v=value, w=word())
        if i % 3 == 0:
            value = (
                "AKIA" + draw(_LOWER.upper() + _DIGITS, 16), "ghp_" + draw(mixed, 36), "sk_live_" + draw(mixed, 24), "glpat-" + draw(mixed, 20),
                "xoxb-" + draw(_DIGITS, 12) + "-" + draw(mixed, 24), "eyJ" + draw(mixed, 30) + ".eyJ" + draw(mixed, 40) + "." + draw(mixed, 43),
                "\n" + "\n".join(draw(mixed + "+/", 64) for _ in range(6)) + "\n",
            )[i // 3 % 7]
            block = value[0] == "\n"
            text = f"-----BEGIN RSA PRIVATE KEY-----{value}-----END RSA PRIVATE KEY-----" if block else f"{word()} {value} {word()}"
        rows.append({"text": f"{word()} {word()}\n{text}\n{word()}", "secret": value})
        fields = {x: word() for x in "w"} | {"d": draw(_DIGITS, 4), "h": draw("0123456789abcdef", 40), "b": draw(mixed + "+/", 44), "n": name, "N": name.upper()}
        fields["u"] = "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
        rows.append({"text": f"{word()} {word()}\n{_HARMLESS_FORMS[i % len(_HARMLESS_FORMS)].format(**fields)}\n{word()}"})
    made = F.from_json(F.lit(json.dumps(rows)), "array<struct<text:string,secret:string>>")
    return spark.range(1).select(F.inline(made))


def composed_findings(spark, language: Language) -> DataFrame:
    """Rows ``features, label`` of the candidates in composed texts."""
    found, name = candidates(composed(spark))
    label = F.coalesce(F.col(f"{name}.value") == F.col("secret"), F.lit(False)).cast("double")
    return with_features(found, name, language).select("features", label.alias("label"))


def train(labelled: DataFrame, further: DataFrame | None = None) -> RandomForestClassificationModel | None:
    """A forest from rows ``features`` (array) and ``label`` (0 or 1); null labels are left out.

    Of each label at most about ``TRAINING_FINDINGS`` rows count, by hash, and all of ``further``.
    None where a label has no row: there is nothing to tell apart.
    """
    known = labelled.where("label is not null")
    sizes = {row.label: row["count"] for row in known.groupBy("label").count().collect()}
    if len(sizes) < 2 and further is None:
        return None
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, TRAINING_FINDINGS / n)).otherwise(share)
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(5), "features"), 11) / float(1 << 53)
    rows = known.where(spot < share).select("label", "features")
    rows = rows if further is None else rows.unionByName(further.select("label", "features"))
    sample = rows.select("label", *[F.get("features", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(sample).select("label", "vector")
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, featureSubsetStrategy="sqrt", seed=11
    )
    return forest.fit(ready)


def scored(
    docs: DataFrame, text: str = "text", labelled: Column | None = None, keep: list[str] | None = None, language: Language | None = None,
) -> tuple[DataFrame, str]:
    """Candidates with ``score``: the forest's probability that each is a secret.

    ``labelled`` is a label column over the candidates' struct ``found``; the default takes the
    plain cases of ``docs`` itself and composed ones in many forms. Without two labels the plain
    label is the score (0 if none).
    ``keep`` names the columns to go on with (all by default), ``language`` the words and
    transitions of a larger table that ``docs`` are taken from.
    """
    language = Language(docs, text) if language is None else language
    names = docs.columns if keep is None else keep
    rows = F.struct(*[F.col(f"`{c}`") for c in names])
    found, name = candidates(docs.select(rows.alias("row"), F.col(f"`{text}`").alias("text")))
    found = with_features(found, name, language).withColumn("label", weak_labels(found, name) if labelled is None else labelled)
    found = cut_lineage(found.select("row", F.col(name).alias("found"), "features", "label"), "findings")
    forest = train(found, composed_findings(docs.sparkSession, language) if labelled is None else None)
    if forest is None:
        return found.withColumn("score", F.coalesce("label", F.lit(0.0))), "found"
    vector = found.select("*", *[F.get("features", F.lit(i)).alias(f"feature_{f}") for i, f in enumerate(FEATURES)])
    ready = VectorAssembler(inputCols=[f"feature_{f}" for f in FEATURES], outputCol="vector").transform(vector)
    judged = forest.transform(ready)
    return judged.select("row", "found", "features", "label", vector_to_array("probability")[1].alias("score")), "found"


def findings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, start, n_chars, value_sha256, score, is_secret``, one for each candidate.

    Values themselves are not in the result. A null or empty text has no candidate, repeated rows
    have theirs each, other columns are not carried.
    """
    found, name = scored(docs, text, keep=[doc_id])
    return found.select(
        F.col(f"row.`{doc_id}`").alias(doc_id), F.col(f"{name}.start").alias("start"),
        F.length(f"{name}.value").cast("bigint").alias("n_chars"), F.sha2(f"{name}.value", 256).alias("value_sha256"),
        F.round("score", 6).alias("score"), (F.col("score") >= SECRET).alias("is_secret"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, other columns as they were.

    Rows without a secret, null and empty texts stay as they are. Every row stays.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    value = F.col(f"`{text}`").cast("string")
    row_id, spans = fresh(docs, "row_id", "spans")
    with_any = docs.where(value.rlike(CANDIDATE)).withColumn(row_id, F.monotonically_increasing_id())
    stored = cut_lineage(with_any, "suspects")
    found, name = scored(stored, text, keep=[row_id], language=Language(docs, text))
    secrets = (
        found.where(F.col("score") >= SECRET)
        .groupBy(F.col(f"row.`{row_id}`").alias(row_id))
        .agg(F.sort_array(F.collect_set(F.struct(F.col(f"{name}.start").alias("start"), F.length(f"{name}.value").alias("n")))).alias(spans))
    )
    whole = F.col(f"`{text}`")
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("made"), F.lit(0).cast("bigint").alias("at")),
        lambda done, s: F.struct(
            F.concat(done["made"], F.substring(whole, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")), F.lit(mark)).alias("made"),
            (s["start"] + s["n"]).alias("at"),
        ),
        lambda done: F.concat(done["made"], F.substring(whole, (done["at"] + 1).cast("int"), F.length(whole))),
    )
    cleaned = stored.join(secrets, row_id, "left").select(
        *[(F.when(F.col(spans).isNotNull(), step).otherwise(whole).alias(c) if c == text else F.col(f"`{c}`")) for c in docs.columns]
    )
    return docs.where(~F.coalesce(value.rlike(CANDIDATE), F.lit(False))).select(*own).unionByName(cleaned)
