"""Language of texts and of spans inside them: scripts, scores of words, and a Viterbi path."""

import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deckweave.llm.arrow import map_rows, typed

#: Documents of each language that the scores are learnt from, chosen by the hash of their ids.
SAMPLE_DOCUMENTS = 1500
#: Distinct words of each language in the sample that are kept, the most frequent first, and longest word that counts.
SAMPLE_WORDS = 150_000
LONGEST_WORD = 40
#: Score that a change of language costs, and what one word's score is bounded by.
SWITCH = 6.0
WORD_BOUND = 6.0
UNDETERMINED = "und"

#: First code points of script ranges, in ascending order.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"),
    (0x0B80, "Tamil"), (0x0C00, "other"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD800, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x30000, "other"),
)
_STARTS = [start for start, _ in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")


def script(word: str) -> str:
    """The script of the first letter."""
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def _grams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]


class Model:
    """Scores of words by language; picklable, its size bounded by the sample of each language."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        """``counts``: how often each (language, word) occurs in the sample."""
        self.languages = sorted({lang for lang, _ in counts})
        place = {lang: i for i, lang in enumerate(self.languages)}
        k = len(self.languages)
        grams, words = defaultdict(lambda: np.zeros(k)), defaultdict(lambda: np.zeros(k))
        scripts = defaultdict(lambda: np.zeros(k))
        for (lang, word), n in counts.items():
            at = place[lang]
            words[word][at] += n
            scripts[script(word)][at] += n
            for gram in _grams(word):
                grams[gram][at] += min(n, 20)
        self._grams, self._gram_scores = self._log(grams, 2, k)
        self._words, self._word_scores = self._log(words, 4, k)
        total = np.maximum(sum(scripts.values(), np.zeros(k)), 1)
        # The first row is for scripts that were never learnt: they exclude no language.
        able = [np.ones(k, bool)]
        self._scripts: dict[str, int] = {}
        for name, found in scripts.items():
            if (found / total >= 0.01).any():
                self._scripts[name] = len(able)
                able.append(found / total >= 0.01)
        self._able = np.array(able).reshape(len(able), k)

    @staticmethod
    def _log(found: dict, least: int, k: int) -> tuple[dict[str, int], np.ndarray]:
        """Rows of log probabilities less their mean over languages; row 0 is for unknown keys."""
        rows, values = {}, [np.zeros(k, np.float32)]
        total = np.maximum(sum(found.values(), np.zeros(k)), 1)
        for key, n in found.items():
            if n.sum() >= least:
                p = np.log((n + 0.5) / (total + 0.5 * len(found)))
                rows[key] = len(values)
                values.append((p - p.mean()).astype(np.float32))
        return rows, np.array(values)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores, one for each language, for each lower-cased word."""
        if not words or not self.languages:
            return np.zeros((len(words), len(self.languages)), np.float32)
        row, codes, sizes = self._grams.get, [], []
        for word in words:
            grams = _grams(word)
            codes += [row(gram, 0) for gram in grams]
            sizes.append(len(grams))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        value = np.add.reduceat(self._gram_scores[codes], begin, axis=0) / 3  # grams overlap
        value += self._word_scores[[self._words.get(word, 0) for word in words]]
        value = np.clip(value - value.max(axis=1, keepdims=True), -WORD_BOUND, 0)
        able = self._able[[self._scripts.get(script(word), 0) for word in words]]
        return np.where(able, value, -WORD_BOUND).astype(np.float32)

    def score(self, word: str) -> np.ndarray:
        return self.scores([word])[0]


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id"
) -> Model:
    """A model from documents with a language; those without one are left out.

    Of each language about ``SAMPLE_DOCUMENTS`` documents count, by the hash of their ids.
    """
    named = docs.select(
        typed(docs, text, "string").alias("text"), typed(docs, lang, "string").alias("lang"),
        F.xxhash64(F.lit(7), F.col(f"`{doc_id}`")).alias("hash"),
    ).where(F.col("lang").isNotNull())
    sizes = {row.lang: row["count"] for row in named.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model({})
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, min(1.0, SAMPLE_DOCUMENTS / n)).otherwise(share)
    spot = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    chosen = named.where(spot < share)
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where(
        F.length("word").between(1, LONGEST_WORD)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    counted = words.groupBy("lang", "word").count().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_WORDS)
    return Model({(row.lang, row.word): row["count"] for row in counted.collect()})


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The best path of languages for each matrix of word scores, all texts step by step together."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = [len(scores[i]) for i in order]
    if not sizes or not sizes[0]:
        return [np.zeros(0, np.int16) for _ in scores]
    flat = np.concatenate([scores[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    rows = np.arange(len(sizes))
    # How many texts, the longest first, have a word at each step.
    live = np.searchsorted(-np.array(sizes), -np.arange(sizes[0]), side="left").tolist()
    best = flat[begin[: live[0]]].astype(np.float64)
    backs, stays = [], []
    for t in range(1, sizes[0]):
        n = live[t]
        old = best[:n]
        top = old.argmax(axis=1)
        value = old[rows[:n], top, None] - switch
        stay = old >= value
        backs.append(top)
        stays.append(stay)
        best[:n] = np.where(stay, old, value) + flat[begin[:n] + t]
    # Backwards, the longest texts first; the others join where they end.
    now = best.argmax(axis=1)
    paths = np.zeros(len(flat), np.int16)
    for t in range(sizes[0] - 1, -1, -1):
        n = live[t]
        paths[begin[:n] + t] = now[:n]
        if t:
            now[:n] = np.where(stays[t - 1][rows[:n], now[:n]], now[:n], backs[t - 1])
    found: list = [np.zeros(0, np.int16)] * len(scores)
    for rank, i in enumerate(order):
        found[i] = paths[begin[rank] : begin[rank] + sizes[rank]]
    return found


#: Texts that go through the steps of the path together.
STEP_TEXTS = 1024
#: Words whose scores a worker keeps; results do not depend on it.
KEPT_WORDS = 400_000


class Tagger:
    """Words and their languages, with scores kept per word."""

    def __init__(self, model: Model):
        self.model = model
        self._rows: dict[str, int] = {}
        self._table = np.zeros((0, len(model.languages)), np.float32)

    def _learn(self, words: list[list[str]]) -> None:
        """Rows for all words that have none, in one step."""
        if len(self._rows) > KEPT_WORDS:
            self._rows.clear()
        known = self._rows
        new = [word for word in set().union(*words) if word not in known]
        used = len(known)
        if used + len(new) > len(self._table):
            larger = np.zeros((2 * (used + len(new)), self._table.shape[1]), np.float32)
            larger[:used] = self._table[:used]
            self._table = larger
        self._table[used : used + len(new)] = self.model.scores(new)
        known.update(zip(new, range(used, used + len(new))))

    def tag(self, texts: list[str]) -> list[tuple[list, np.ndarray]]:
        """For each text its words and the place of each one's language."""
        words = [_WORD.findall(text.lower()) for text in texts]
        self._learn(words)
        places = [np.fromiter(map(self._rows.__getitem__, found), np.int64, len(found)) for found in words]
        return list(zip(words, viterbi([self._table[at] for at in places])))


@lru_cache(maxsize=1)
def _tagger(key: int, broadcast) -> Tagger:
    return Tagger(broadcast.value)


def _letters(words: list[str]) -> bool:
    return any(c.isalpha() for word in words for c in word)


def predict(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, lang_pred, score``, one for each row of ``docs`` in any order.

    The language with most letters on the best path (ties: the first by name) and its share of
    them. ``und`` with score 0 for a null text, one without letters, or a model without languages.
    Null or repeated ids keep their rows; other columns are not read or carried.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = shared.id if hasattr(shared, "id") else id(shared)

    def rows(part):
        use = _tagger(key, shared)
        names, made = use.model.languages, []
        for (doc, _), (words, path) in zip(part, use.tag([value or "" for _, value in part])):
            if not names or not _letters(words):
                made.append((doc, UNDETERMINED, 0.0))
                continue
            letters = np.bincount(path, weights=[len(word) for word in words], minlength=len(names))
            top = int(letters.argmax())
            made.append((doc, names[top], float(letters[top] / letters.sum())))
        return made

    fields = [pa.field(doc_id, pa.int64()), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]
    return map_rows(
        docs.select(typed(docs, doc_id, "bigint"), typed(docs, text, "string")),
        rows, fields, f"`{doc_id}` bigint, lang_pred string, score double", STEP_TEXTS,
    )


def language_spans(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, start, end, lang``: runs of words of one language, as character offsets.

    A text without letters has no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(part):
        use, made = Tagger(shared.value), []
        for doc, value in part:
            value = value or ""
            # Lower case can change the length of a text; offsets are those of the text as it is.
            places = [m.span() for m in _WORD.finditer(value)]
            if not use.model.languages or not places:
                continue
            table = use.model.scores([value[a:b].lower() for a, b in places])
            path = viterbi([table])[0]
            cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            for a, b in zip(cuts, cuts[1:]):
                made.append((doc, places[a][0], places[b - 1][1], use.model.languages[path[a]]))
        return made

    fields = [pa.field(doc_id, pa.int64()), pa.field("start", pa.int64()), pa.field("end", pa.int64()), pa.field("lang", pa.string())]
    return map_rows(
        docs.select(typed(docs, doc_id, "bigint"), typed(docs, text, "string")),
        rows, fields, f"`{doc_id}` bigint, start bigint, end bigint, lang string",
    )


def held_out(doc_id: str = "doc_id"):
    """True for documents that must not be learnt from: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predictions(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, held_out, lang_pred, score`` by a model of the documents not held out."""
    model = learn(docs.where(~held_out(doc_id) & F.col(f"`{doc_id}`").isNotNull()), doc_id=doc_id)
    return predict(docs, model, doc_id=doc_id).select(doc_id, held_out(doc_id).alias("held_out"), "lang_pred", "score")
