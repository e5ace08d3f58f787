"""Words of a corpus, grouped with the frequent spelling that each is a variant of.

Two words are near if one inserted, deleted or replaced letter makes one the other. Their letter
counts are then at a squared distance of at most two, and their lengths differ by at most one. So
words meet in blocks of adjacent lengths, a product of the blocks' letter counts (a Gram matrix)
gives all squared distances at once, and only pairs at most two apart have their letters compared.

Blocks of lengths are refined without losing a pair. Letters fall into eight groups, and a word has
a count in each. Taking one letter away lowers one count by one: of two near words of one length both
come to the same counts by the letter that differs, and of two lengths the longer one comes to those of the
shorter. A word therefore stands in the bucket of its own counts, as a short word, and in one bucket for
each group that it has letters of, as a long one. Long words meet each other and the short ones.
"""

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckweave.llm.arrow import ROWS, typed
from deckweave.session import cut_lineage

#: Fixed value: the letters that words are made of, after A-Z became a-z.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form has at least so many times the count of its variants.
FORM_RATIO = 2
GROUPS = 8
#: Words that a task counts before it gives its counts.
HELD_WORDS = 1 << 18
#: Larger buckets are split into parts of so many words, and every two parts meet in a task of their own.
PART_WORDS = 4096
#: Small buckets stand in one product up to so many words.
BLOCK_WORDS = 512
#: Elements of a matrix that is held at a time.
ELEMENTS = 1 << 22
#: A table of large buckets is broadcast up to so many rows of two numbers.
BROADCAST_BUCKETS = 1 << 18

# Sums of group counts times these, modulo a prime, name a bucket. Buckets that share a name cost
# some products, as pairs are compared by their letters and groups anyway.
_PRIME = (1 << 31) - 1
_FACTORS = np.array([pow(48271, 1000 + k, _PRIME) for k in range(GROUPS)], np.int64)
_LETTER_BINS = 32
_LONG_WORD = 256


def word_counts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_every: int | None = None
) -> DataFrame:
    """Rows ``word, n`` of the words of at least ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times.

    A word is a maximal run of ``LETTERS`` after A-Z became a-z, in whole texts; null has none. With
    ``drop_every``, runs whose checksum with their document's id it divides lose the letter at the
    checksum modulo their length, as planted misspellings do; a null id counts as an empty text there.
    Counts add up in each task first, so words that are in every document don't crowd a task.
    """
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def found(key, value: str) -> Iterator[tuple[str, int]]:
        # Bytes change A-Z only.
        counted = Counter(runs.findall(value.encode().lower().decode()))
        if drop_every is None:
            yield from counted.items()
            return
        begun = crc32(f"{'' if key is None else key}:".encode())
        for run, n in counted.items():
            code = crc32(run.encode(), begun)
            if code % drop_every == 0:
                at = code % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LEAST_LENGTH:
                    continue
            yield run, n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            arrays = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            made = pa.RecordBatch.from_arrays(arrays, names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, n in found(key, value or ""):
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield given()
        if held:
            yield given()

    named = docs.select(typed(docs, doc_id, "bigint").alias("doc_id"), typed(docs, text, "string").alias("text"))
    partial = named.mapInArrow(count, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters of the words in a row, each one's word, and the words' lengths."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.repeat(np.arange(len(words)), lengths), lengths


def _sums(rows: np.ndarray, bins: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(rows * shape[1] + bins, minlength=shape[0] * shape[1]).reshape(shape)


def _with_buckets(words: DataFrame) -> DataFrame:
    """Words with the name of their own bucket and the groups that they have letters of, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, rows, _ = _letters(batch.column(0).to_pylist())
            counts = _sums(rows, codes % GROUPS, (batch.num_rows, GROUPS))
            own = (counts % _PRIME * _FACTORS % _PRIME).sum(axis=1) % _PRIME
            bits = (counts > 0) @ (1 << np.arange(GROUPS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int64()), pa.array(bits, pa.int32())],
                names=["word", "n", "own", "bits"],
            )

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, own bigint, bits int")


def _places() -> Column:
    """The buckets of a word with its role there: 0 as a short word, else one more than the group it lost."""
    lost = [
        F.when(
            F.col("bits").bitwiseAND(1 << k) != 0,
            F.struct(F.pmod(F.col("own") - int(_FACTORS[k]), F.lit(_PRIME)).alias("bucket"), F.lit(k + 1).alias("role")),
        )
        for k in range(GROUPS)
    ]
    return F.array_compact(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("role")), *lost))


def _placed(stored: DataFrame, part_words: int) -> DataFrame:
    """A row for each word, bucket and pair of parts of the bucket in which the word stands.

    Words with the same counts are one row when buckets are counted, so counting is small. Of a
    large bucket each word has a part by its hash and stands in the pairs of that part and each other.
    """
    kinds = stored.groupBy("own", "bits").agg(F.count(F.lit(1)).alias("words"))
    sizes = kinds.select("words", F.inline(_places())).groupBy("bucket").agg(F.sum("words").alias("words"))
    parts = F.ceil(F.col("words") / part_words).alias("parts")
    large = cut_lineage(sizes.where(F.col("words") > part_words).select("bucket", parts), "buckets")
    rows = stored.select("word", "n", F.inline(_places()))
    known = F.broadcast(large) if large.count() <= BROADCAST_BUCKETS else large
    joined = rows.join(known, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), "parts")
    dealt = joined.select("*", own.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    return dealt.select(
        "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        F.col("part").cast("int").alias("part"), "role", "word", "n",
    )


def _distances(counts: np.ndarray, first: int, last: int) -> np.ndarray:
    """Squared distances between the letter counts of some rows and of all, by a Gram product."""
    squares = np.einsum("ij,ij->i", counts, counts)
    return squares[first:last, None] + squares[None, :] - 2 * (counts[first:last] @ counts.T)


def one_edit(one: str, two: str) -> int:
    """The code of a letter that one insertion, deletion or replacement concerns; -1 if one doesn't do.

    Where a letter is replaced it is that of ``one``, else the letter that the longer word has more.
    """
    if len(one) > len(two):
        return one_edit(two, one)
    at = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), len(one))
    if len(one) == len(two):
        return ord(one[at]) if at < len(one) and one[at + 1 :] == two[at + 1 :] else -1
    return ord(two[at]) if len(two) == len(one) + 1 and one[at:] == two[at + 1 :] else -1


class _Block:
    """Words of whole buckets, or of two parts of one, that meet in one product."""

    def __init__(self, columns: list[np.ndarray | list]):
        self.bucket, self.low, self.high, self.part, self.role, self.words, self.n = columns
        self.codes, self.rows, self.lengths = _letters(self.words)
        self.longest = int(self.lengths.max())
        counts = _sums(self.rows, self.codes % _LETTER_BINS, (len(self.words), _LETTER_BINS))
        # Single precision holds squares exactly up to 2 ** 24.
        self.counts = counts.astype(np.float32 if self.longest < 2048 else np.float64)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of pairs at most two apart that stand in one bucket, one of them long at least.

        The first of a pair is no longer than the second. Two parts of a bucket meet each other here,
        and a part's own words in the task of that part alone.
        """
        step = max(1, ELEMENTS // len(self.words))
        for first in range(0, len(self.words), step):
            near = _distances(self.counts, first, min(len(self.words), first + step)) <= 2
            one, two = np.nonzero(near)
            one += first
            same = (self.bucket[one] == self.bucket[two]) & (self.low[one] == self.low[two]) & (self.high[one] == self.high[two])
            meets = (self.low[one] == self.high[one]) | (self.part[one] != self.part[two])
            longer = self.lengths[two] - self.lengths[one]
            roles = np.where(longer == 0, (self.role[one] > 0) & (one < two), (longer == 1) & (self.role[one] == 0))
            keep = np.flatnonzero(same & meets & roles & (self.role[two] > 0))
            for low in range(0, len(keep), max(1, ELEMENTS // self.longest)):
                chosen = keep[low : low + max(1, ELEMENTS // self.longest)]
                yield one[chosen], two[chosen]

    def _verified(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart, by letters of the groups for which their words stand here."""
        if self.longest > _LONG_WORD:
            return np.array([self._edit_here(x, y) for x, y in zip(one.tolist(), two.tolist())], bool)
        table = np.zeros((len(self.words), self.longest + 1), np.uint8)
        starts = np.cumsum(self.lengths) - self.lengths
        table[self.rows, np.arange(len(self.codes)) - starts[self.rows]] = self.codes
        short, long = table[one], table[two]
        at = (short != long).argmax(axis=1)
        each = np.arange(len(one))
        place = np.arange(self.longest)
        equal = self.lengths[one] == self.lengths[two]
        rest = np.minimum(place + (place >= at[:, None]), self.longest)
        inserted = (np.take_along_axis(long, rest, axis=1) == short[:, : self.longest]).all(axis=1)
        edited = np.where(equal, (short != long).sum(axis=1) == 1, inserted)
        group = lambda letters: letters % GROUPS + 1
        first = np.where(equal, group(short[each, at]), 0) == self.role[one]
        return edited & first & (group(long[each, at]) == self.role[two])

    def _edit_here(self, one: int, two: int) -> bool:
        x, y = self.words[one], self.words[two]
        code, back = one_edit(x, y), one_edit(y, x)
        first = code % GROUPS + 1 if len(x) == len(y) else 0
        return code >= 0 and first == self.role[one] and back % GROUPS + 1 == self.role[two]

    def near(self) -> pa.RecordBatch | None:
        """For words with near words here: how many, and the most frequent one, the smallest of equals."""
        pairs = [(one[ok], two[ok]) for one, two in self.candidates() for ok in [self._verified(one, two)]]
        if not sum(len(one) for one, _ in pairs):
            return None
        one, two = (np.concatenate(side) for side in zip(*pairs))
        word, other = np.concatenate([one, two]), np.concatenate([two, one])
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[other], -self.n[other], word))
        word, other = word[order], other[order]
        firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        held = np.diff(np.r_[firsts, len(word)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.words[i] for i in word[firsts]], pa.string()),
                pa.array(held, pa.int64()),
                pa.array(self.n[other[firsts]], pa.int64()),
                pa.array([self.words[i] for i in other[firsts]], pa.string()),
            ],
            names=["word", "n_near", "other_n", "other"],
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    """Rows in order of their buckets and parts, as blocks of whole groups.

    A group has at most about two parts' words; small groups stand together.
    """
    held: list[pa.RecordBatch] = []

    def block(rows: pa.RecordBatch) -> _Block:
        numbers = [rows.column(i).to_numpy() for i in (0, 1, 2, 3, 4)]
        return _Block([*numbers, rows.column(5).to_pylist(), rows.column(6).to_numpy()])

    for batch in batches:
        held.append(batch)
        if sum(rows.num_rows for rows in held) < BLOCK_WORDS:
            continue
        rows = pa.concat_batches(held)
        keys = np.stack([rows.column(i).to_numpy() for i in (0, 1, 2)])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        start = 0
        while start < rows.num_rows:
            # The last end within a block's words, else the first one after them.
            within = ends[(ends > start) & (ends <= start + BLOCK_WORDS)]
            after = ends[ends > start + BLOCK_WORDS]
            if not len(after):
                break
            end = int(within[-1]) if len(within) else int(after[0])
            yield block(rows.slice(start, end - start))
            start = end
        held = [rows.slice(start)]
    if held and sum(rows.num_rows for rows in held):
        yield block(pa.concat_batches(held))


def near_words(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Rows ``word, n, n_near, other, other_n`` for rows ``word, n`` of distinct words of ``LETTERS``.

    ``other`` is the near word of the greatest count, the smallest in code-point order of equals, and
    null where ``n_near`` is 0. No pair is lost, and none leaves its task: a task gives a row a word.
    """
    stored = cut_lineage(_with_buckets(words), "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = block.near()
            if found is not None:
                yield found

    keys = ("bucket", "low", "high")
    met = _placed(stored, part_words).repartition(*keys).sortWithinPartitions(*keys)
    near = met.mapInArrow(run, "word string, n_near bigint, other_n bigint, other string")
    best = F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("word")).alias("best")
    given = near.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", best)
    none = F.lit(None).cast(given.schema["best"].dataType).alias("best")
    every = stored.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), none)
    summed = every.unionByName(given).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best")
    )
    return summed.select("word", "n", "n_near", F.col("best.word").alias("other"), (-F.col("best.order")).alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows ``word, root`` for rows ``word, form`` without null: the end of each chain of forms.

    Pointers double: after k rounds a word points 2 ** k forms on, or to its root. Counts grow with
    each form, so chains end, and few rounds do.
    """
    held = cut_lineage(forms.select("word", F.col("form").alias("to"), F.lit(False).alias("ended")), "forms")
    while held.where(~F.col("ended")).limit(1).count():
        further = held.select(F.col("word").alias("at"), F.col("to").alias("next"), F.col("ended").alias("next_ended"))
        moved = held.where(~F.col("ended")).join(further, F.col("to") == F.col("at"), "left")
        stepped = moved.select("word", F.coalesce("next", "to").alias("to"), F.coalesce("next_ended", F.lit(True)).alias("ended"))
        held = cut_lineage(held.where("ended").unionByName(stepped), "forms")
    return held.select("word", F.col("to").alias("root"))


def groups(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """Rows ``word, form, root, n, n_near, form_n`` for rows ``word, n`` of distinct words.

    A word's form is its near word of the greatest count (ties: the smallest in code-point order), if
    that is at least ``FORM_RATIO`` times the word's, else null. Its root is what following forms ends
    at, the word itself where it has none. An empty table gives an empty one.
    """
    near = near_words(words, part_words)
    is_form = F.col("other_n") >= FORM_RATIO * F.col("n")
    formed = near.select(
        "word", "n", "n_near",
        F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n"),
    )
    formed = cut_lineage(formed, "near")
    ends = roots(formed.where(F.col("form").isNotNull()).select("word", "form"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_groups(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", drop_every: int | None = None
) -> DataFrame:
    """``groups`` of the words of ``docs`` (see ``word_counts``): one row per word.

    Words of texts repeated in several rows count in each. Very long texts are read within their
    row, very long words are compared one pair at a time. Other columns are not carried.
    """
    return groups(cut_lineage(word_counts(docs, text, doc_id, drop_every), "counts"))
