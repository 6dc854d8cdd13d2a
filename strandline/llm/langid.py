"""Language identification by word-first backoff.

A word the model knows scores by its log frequency in each language.  An unseen
word falls back to its character n-grams, longest first: a stretch of letters
that no table of n letters knows is looked up with n - 1, and so on.

A frequency is log((n + s) / d), of which log(s / d) is the same for all items of a table and the rest
is there only for languages that have the item.  A text's scores are therefore few sums
of tables' own terms and a sparse sum over the languages of its words, done for many texts at once.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import text_slices

UNKNOWN = "und"

#: Labelled documents that the fit takes at most (about).  Their words and n-grams are the model,
#: all of them, in as many languages as they have.
MAX_TRAIN_DOCS = 20_000
LONGEST_GRAM = 4

#: Bytes of texts whose words are scored at a time: each word costs some hundred bytes meanwhile.
SLICE = 1 << 19

#: Letters of a word up to which unseen words are taken apart side by side; longer ones one by one.
LONG_WORD = 40

#: Languages up to which their shares are sent to all executors (a few megabytes); beyond it rows are exchanged.
BROADCAST_LANGS = 50_000

#: Added to every count.
SMOOTHING = 0.5


_ALPHANUMERIC = re.compile(r"[^\W\d_]+")


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache
def _numbers(first: int, last: int) -> re.Pattern:
    """Characters such as \u00b2 or \u2167 that ``\\w`` takes and that are neither digits nor letters."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(first, last + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]")


def letter_runs(text: str) -> list[str]:
    """Runs of letters (Unicode category L)."""
    if not text.isascii():
        # Sets of characters of two bytes are looked up in a table; others are searched through, where there are any.
        text = _numbers(0, 0xFFFF).sub(" ", text)
        if _ASTRAL.search(text):
            text = _numbers(0x10000, sys.maxunicode).sub(" ", text)
    return _ALPHANUMERIC.findall(text)


@dataclass(frozen=True)
class Model:
    """Items are numbered through: words, then n-grams of 1, 2, ... letters.  Item i has the languages
    ``lang[ptr[i] : ptr[i + 1]]``, with what they score over a language that does not have it."""

    langs: tuple[str, ...]
    items: tuple[pa.StringArray, ...]  # words, n-grams of 1, 2, ... letters
    ptr: np.ndarray
    lang: np.ndarray
    score: np.ndarray
    unseen: np.ndarray  # table by language; the last row is for letters that no table knows

    @cached_property
    def first(self) -> np.ndarray:
        """Number of each table's first item."""
        return np.cumsum([0, *(len(x) for x in self.items)])

    @cached_property
    def grams(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each length: hashes in order, and the letters and number of the item behind each."""
        out = []
        for size, items in enumerate(self.items[1:], 1):
            letters = _letters(items.to_pylist(), size)
            key = _hash(letters)
            order = np.argsort(key, kind="stable")
            out.append((key[order], letters[order], self.first[size] + order))
        return out

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
        """Hashes of words in order with the words' numbers; long words by themselves."""
        keys, at, long = [], [], {}
        for first in range(0, len(self.items[0]), 1 << 16):
            some = self.items[0].slice(first, 1 << 16)
            short = pc.less_equal(pc.utf8_length(some), LONG_WORD)
            at.append(first + np.flatnonzero(short.to_numpy(zero_copy_only=False)))
            keys.append(_hash(_letters(some.filter(short).to_pylist(), LONG_WORD)))
            rest = np.flatnonzero(~short.to_numpy(zero_copy_only=False))
            long |= dict(zip(some.take(pa.array(rest)).to_pylist(), (first + rest).tolist(), strict=True))
        if not keys:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), long
        key, number = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        return key[order], number[order], long

    def known(self, asked: pa.StringArray) -> np.ndarray:
        """Numbers of words, -1 for unseen ones; what a hash finds is compared letter by letter."""
        key, number, long = self.words
        out = np.full(len(asked), -1, dtype=np.int64)
        short = pc.less_equal(pc.utf8_length(asked), LONG_WORD).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(short)
        if len(at) and len(key):
            some = asked.take(pa.array(at))
            mine = _hash(_letters(some.to_pylist(), LONG_WORD))
            found = number[np.minimum(np.searchsorted(key, mine), len(key) - 1)]
            same = pc.equal(self.items[0].take(pa.array(found)), some).to_numpy(zero_copy_only=False)
            out[at[same]] = found[same]
        for i in np.flatnonzero(~short):
            out[i] = long.get(asked[int(i)].as_py(), -1)
        return out

    @cached_property
    def by_gram(self) -> list[dict[str, int]]:
        return [dict(zip(items.to_pylist(), range(self.first[size], self.first[size + 1]), strict=True)) for size, items in enumerate(self.items[1:], 1)]

    def counts(self, item: str, table: int = 0) -> dict[str, int]:
        """How often a word, or an n-gram of ``table`` letters, was met in each language that has it."""
        at = self.items[table].index(item).as_py()
        span = slice(0, 0) if at < 0 else slice(self.ptr[self.first[table] + at], self.ptr[self.first[table] + at + 1])
        return {self.langs[x]: round((math.exp(y) - 1) * SMOOTHING) for x, y in zip(self.lang[span], self.score[span], strict=True)}

    def __getstate__(self):
        return {k: self.__dict__[k] for k in self.__dataclass_fields__}


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points, a row a word, 0 behind its end."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def _hash(letters: np.ndarray) -> np.ndarray:
    out = np.zeros(len(letters), dtype=np.uint64)
    for column in letters.T:
        out = out * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1)
    return out


def _flat(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the given rows, and how many each has."""
    sizes = ptr[rows + 1] - ptr[rows]
    return np.repeat(ptr[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum())), sizes


Parts = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _side_by_side(model: Model, words: np.ndarray, texts: list[str]) -> Parts:
    """(word, table, item or -1) of every n-gram of unseen words, the longest known one at each place, the next
    one starting at the last letter of one of several letters."""
    marked = _letters([f" {w} " for w in texts], LONG_WORD + 2)
    length, at, parts = (marked > 0).sum(axis=1), np.zeros(len(texts), dtype=np.int64), []
    active, longest = np.arange(len(texts)), len(model.grams)
    while len(active):
        left, found = active, []
        for size in range(longest, 0, -1):
            fits = left[at[left] + size <= length[left]]
            key, letters, item = model.grams[size - 1]
            if not len(fits) or not len(key):
                continue
            asked = marked[fits[:, None], at[fits][:, None] + np.arange(size)]
            place = np.minimum(np.searchsorted(key, _hash(asked)), len(key) - 1)
            same = (letters[place] == asked).all(axis=1)
            hit = fits[same]
            parts.append((words[hit], np.full(len(hit), size), item[place[same]]))
            found.append((hit, max(1, size - 1)))
            left = np.setdiff1d(left, hit, assume_unique=True)
        parts.append((words[left], np.full(len(left), longest + 1), np.full(len(left), -1)))
        for hit, step in found:
            at[hit] += step
        at[left] += 1
        active = active[at[active] < length[active]]
    return parts


def _one_by_one(model: Model, words: np.ndarray, texts: list[str]) -> Parts:
    """The same for words of any length."""
    longest, parts = len(model.by_gram), []
    for word, text in zip(words, texts, strict=True):
        marked, i, tables, items = f" {text} ", 0, [], []
        while i < len(marked):
            for size in range(min(longest, len(marked) - i), 0, -1):
                if (item := model.by_gram[size - 1].get(marked[i : i + size])) is not None:
                    break
            else:
                size, item = longest + 1, -1
            tables.append(size)
            items.append(item)
            i += 1 if item < 0 else max(1, size - 1)
        parts.append((np.full(len(items), word), np.array(tables), np.array(items)))
    return parts


def _weighed(model: Model, unique: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: how much of each table's own term it has, and its sparse row (ptr, language, score)."""
    n, longest = len(unique), len(model.items) - 1
    known = model.known(unique)
    there, new = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
    parts: Parts = [(there, np.zeros(len(there), dtype=np.int64), known[there])]
    if len(new):
        asked = unique.take(pa.array(new))
        long = pc.greater(pc.utf8_length(asked), LONG_WORD).to_numpy(zero_copy_only=False)
        for some, split in ((~long, _side_by_side), (long, _one_by_one)):
            if some.any():
                parts += split(model, new[some], asked.filter(pa.array(some)).to_pylist())
    word, table, item = (np.concatenate(x) for x in zip(*parts, strict=True))
    share = 1.0 / np.maximum(1, np.bincount(word, minlength=n))[word]
    terms = np.bincount(word * (longest + 2) + table, weights=share, minlength=n * (longest + 2)).reshape(n, -1)
    order = np.argsort(word, kind="stable")
    order = order[item[order] >= 0]
    at, sizes = _flat(model.ptr, item[order])
    ptr = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(word[order], sizes), minlength=n))]).astype(np.int64)
    return terms, ptr, model.lang[at], model.score[at] * np.repeat(share[order], sizes)


def _totals(model: Model, words: list[list[str]]) -> np.ndarray:
    """Log scores, texts by languages, summed over words."""
    n, langs = len(words), len(model.langs)
    of = np.repeat(np.arange(n), [len(w) for w in words])
    if not len(of):
        return np.zeros((n, langs))
    encoded = pa.array([w for text in words for w in text], pa.string()).dictionary_encode()
    which = encoded.indices.to_numpy()
    terms, ptr, lang, score = _weighed(model, encoded.dictionary)
    own = np.stack([np.bincount(of, weights=terms[which, k], minlength=n) for k in range(terms.shape[1])], axis=1) @ model.unseen
    at, sizes = _flat(ptr, which)
    return own + np.bincount(np.repeat(of, sizes) * langs + lang[at], weights=score[at], minlength=n * langs).reshape(n, langs)


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's rows that makes ``most`` in all: as even a number of each as
    there are, so that a small language is taken whole."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, left / (len(sizes) - i))
        out[lang] = taken / n
        left -= taken
    return out


def threshold(share: float) -> int:
    """The bound that a share of all 64-bit hashes does not exceed, above the least hash for any share."""
    return -(1 << 63) + max(1, int(share * 2**64))


def fit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    max_train_docs: int = MAX_TRAIN_DOCS,
    longest_gram: int = LONGEST_GRAM,
) -> Model:
    """Learn from the labelled rows of ``docs``, whole texts, in any number of languages.

    Of more than ``max_train_docs`` labelled rows, about that many are taken by
    a hash of the id, evenly of all languages: of a language with fewer rows than
    its part, all.  Every word and n-gram of these rows is kept; nothing else bounds the model, which the
    driver holds and sends to every worker.  Rows without label, text or letters teach nothing.
    """
    lang = F.col(lang_col).cast("string")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang.alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    parts = [(x, threshold(s)) for x, s in shares(sizes, max_train_docs).items() if s < 1]
    if parts:
        bounds = docs.sparkSession.createDataFrame(parts, "lang string, bound long")
        if len(parts) <= BROADCAST_LANGS:
            bounds = F.broadcast(bounds)
        rows = rows.join(bounds, "lang", "left").where(F.coalesce(F.xxhash64("id") <= F.col("bound"), F.lit(True)))
    # Letters run on as in the prediction's pattern; counts are combined before they move.
    tokens = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = rows.select("lang", tokens.alias("item")).where("item <> ''").groupBy("lang", "item").agg(F.count("*").alias("n"))
    marked = F.concat(F.lit(" "), F.col("item"), F.lit(" "))
    # A word itself, and every n-gram that starts at one of its letters.
    placed = words.withColumn("marked", marked).select("lang", "item", "marked", "n", F.explode(F.expr("sequence(1, length(marked))")).alias("at"))
    pieces = [F.struct(F.lit(0).alias("size"), F.when(F.col("at") == 1, F.col("item")).alias("item"))]
    pieces += [F.struct(F.lit(k).alias("size"), F.when(F.col("at") + k - 1 <= F.length("marked"), F.expr(f"substring(marked, at, {k})")).alias("item")) for k in range(1, longest_gram + 1)]
    items = placed.select("lang", "n", F.explode(F.array(*pieces)).alias("p")).select("lang", "n", "p.*").where("item is not null")
    counted = items.groupBy("size", "item", "lang").agg(F.sum("n").alias("n"))
    # One row an item; its languages are in order.
    known = counted.groupBy("size", "item").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("in")).toArrow().sort_by([("size", "ascending"), ("item", "ascending")])
    of = known.column("size").to_numpy()
    entries = known.column("in").combine_chunks()
    flat = pc.list_flatten(entries)
    named = flat.field("lang").dictionary_encode()
    langs = tuple(sorted(named.dictionary.to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    place = np.array([number[x] for x in named.dictionary.to_pylist()], dtype=np.int64)
    lang_of = place[named.indices.to_numpy()] if langs else np.empty(0, dtype=np.int64)
    n = flat.field("n").to_numpy().astype(np.float64)
    lengths = pc.list_value_length(entries).to_numpy().astype(np.int64)
    table_of, tables = np.repeat(of, lengths).astype(np.int64), longest_gram + 1
    totals = np.bincount(table_of * len(langs) + lang_of, weights=n, minlength=tables * len(langs)).reshape(tables, len(langs))
    unseen = np.log(SMOOTHING / (totals + SMOOTHING * np.maximum(1, np.bincount(of, minlength=tables))[:, None]))
    unseen = np.concatenate([unseen, unseen[1:].min(axis=0, keepdims=True)])
    item = known.column("item").combine_chunks()
    bounds = np.searchsorted(of, np.arange(tables + 1))
    by_table = tuple(pa.concat_arrays([item.slice(a, b - a)]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    model = Model(langs, by_table, np.concatenate([[0], np.cumsum(lengths)]), lang_of, np.log((n + SMOOTHING) / SMOOTHING), unseen)
    # What was collected is larger than the model, and Arrow keeps freed memory for itself.
    del known, entries, flat, named, item, of, table_of
    pa.default_memory_pool().release_unused()
    return model


def _predictor(shared, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for whole in batches:
            for first, end, _, _ in text_slices(whole.column(column), SLICE):
                batch = whole.slice(first, end - first)
                words = [letter_runs((text.as_py() or "").lower()) for text in batch.column(column)]
                n = np.array([len(w) for w in words])
                told, best, scores = (n > 0) & (len(model.langs) > 0), np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
                if told.any():
                    # The posterior, tempered so that long texts are not all 1.0.
                    total = _totals(model, words) / np.sqrt(np.maximum(1, n))[:, None]
                    best = total.argmax(axis=1)
                    p = np.exp(total - total.max(axis=1, keepdims=True))
                    scores = np.where(told, p[np.arange(len(p)), best] / p.sum(axis=1), 0.0)
                predicted = [model.langs[b] if t else UNKNOWN for b, t in zip(best, told, strict=True)]
                names = [x for x in batch.schema.names if x != column]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (0 to 1).

    A text that is null or has no letter (Unicode category L) gets ``und`` and 0.
    Equal scores go to the language first in the alphabet.  The model learned
    from nothing says ``und`` of everything.  Texts are read whole.
    The model goes to every worker; the rows it learned from bound its size.
    """
    spark: SparkSession = docs.sparkSession
    column = "_" * (1 + max((len(c) for c in keep), default=0))  # no other column's name
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias(column))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != column)
    return rows.mapInArrow(_predictor(spark.sparkContext.broadcast(model), column), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
