"""Reading level of articles from the grades at which their words are acquired.

A word's grade comes from how often it occurs in the labelled texts of each level. A document is described by quantiles
of the grades of its known words, once by kind of word and once by use, and a small model that is calibrated on labelled
documents turns the quantiles into a level. Which texts are in the readers' language is learned from the letter trigrams
of the labelled texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, shared, written
from . import latex

LEVELS = 5
#: A text is in the labelled texts' language if its letter trigrams are on average at most 2 to this power less probable,
#: by the trigrams of the labelled texts, than those of the median labelled text ...
MOST_FOREIGN = 1.6
#: ... and an article if it has this many words; notices of withdrawal are shorter.
LEAST_PROSE = 12
#: Kinds of characters in trigrams: the letters a to z, digits, all other letters, and the blank around a word.
LETTERS = "abcdefghijklmnopqrstuvwxyz0~ "
#: A worker keeps the trigram scores of this many words.
SCORED_WORDS = 500_000
#: Labels of at most this many documents are broadcast to the texts; those of more meet the texts' words instead.
BROADCAST_LABELS = 2_000_000
#: Bits of the fixed-size filter by which labelled documents are then found before their words are counted.
FILTER_BITS = 1 << 27
#: A word is known if at least this many labelled documents have it.
LEAST_DOCUMENTS = 3
#: The calibration is fitted on at most this many labelled documents (those of smallest hash of their id).
CALIBRATION_DOCUMENTS = 20_000
#: A lexicon of more words than this is joined instead of broadcast.
LEXICON_WORDS = 2_000_000
QUANTILES = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])
#: Labelled documents are split into this many parts; a document's features never use grades from its own part.
PARTS = 5


def word_trigrams(word: str) -> list[int]:
    """The letter trigrams of a word with a blank on either side, as numbers."""
    plain = [26 if c.isdigit() else ord(c) - 97 if "a" <= c <= "z" else 27 for c in word]
    at = [28, *plain, 28]
    return [(a * 29 + b) * 29 + c for a, b, c in zip(at, at[1:], at[2:])]


class Language:
    """Letter trigrams of the labelled texts, and the least score of a text in their language. Without labelled texts every
    text is in it."""

    def __init__(self, counts: dict[int, int]) -> None:
        size = len(LETTERS) ** 3
        seen = np.zeros(size)
        for code, n in counts.items():
            seen[code] = n
        self.log = np.log2((seen + 0.5) / (seen.sum() + 0.5 * size))
        self.least = -np.inf if not counts else None
        self.scored: dict[str, tuple[float, int]] = {}

    def score(self, counts: Counter) -> float:
        """Mean log probability of the trigrams of a text's words."""
        total, n, scored = 0.0, 0, self.scored
        for w, use in counts.items():
            got = scored.get(w)
            if got is None:
                if len(scored) >= SCORED_WORDS:
                    scored.clear()
                codes = word_trigrams(w)
                got = scored[w] = (float(self.log[codes].sum()), len(codes))
            total += got[0] * use
            n += got[1] * use
        return total / n if n else -np.inf

    def has(self, counts: Counter) -> bool:
        return self.score(counts) >= self.least


def article_words(text: str) -> Counter | None:
    """The words of an article's prose with their counts; None for a text that is too short to be one."""
    found = latex.prose_words(text)
    return Counter(found) if len(found) >= LEAST_PROSE else None


def features(grades: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """Quantiles and mean of the grades of the known words, by kind and by use; the order of the words does not count."""
    order = np.lexsort((uses, grades))  # words of one grade by use: the share at which a quantile falls depends on it
    g, u = grades[order], uses[order].astype(float)
    share = np.cumsum(u) / u.sum()
    return np.r_[np.quantile(g, QUANTILES), np.interp(QUANTILES, share, g), g.mean(), (g * u).sum() / u.sum()]


@dataclass
class Model:
    """A softmax over standardised features; `usual` stands in for documents without known words."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    usual: int

    def level(self, x: np.ndarray) -> int:
        z = np.r_[1.0, (x - self.mean) / self.spread]
        return int(np.argmax(z @ self.weights)) + 1


def calibrated(x: np.ndarray, level: np.ndarray, usual: int, steps: int = 600, penalty: float = 1.0) -> Model:
    """Fit the model by gradient descent with momentum; deterministic, as it starts from zero."""
    if not len(x):
        return Model(np.zeros(0), np.ones(0), np.zeros((1, LEVELS)), usual)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    target = np.eye(LEVELS)[level - 1]
    w, v = np.zeros((z.shape[1], LEVELS)), 0.0
    for _ in range(steps):
        a = z @ w
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.8 * v - 0.2 * (z.T @ (p - target) + penalty * w) / len(z)
        w = w + v
    return Model(mean, spread, w, usual)


def consensus(labels: DataFrame) -> DataFrame:
    """(doc_id, level): the median of the raters' latest valid opinions; halves go up. Nulls and values off the scale do not count."""
    valid = labels.where(f"doc_id is not null and reading_level between 1 and {LEVELS}")
    own = valid.groupBy("doc_id", "rater").agg(F.max_by("reading_level", F.struct("labelled_at", "reading_level")).alias("one"))
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.floor(F.percentile("one", F.lit(0.5)) + 0.5).cast("int").alias("level"))


def _word_counts(documents: DataFrame, keep: list[str], language: Language | None = None, chosen=None) -> DataFrame:
    """(keep..., words, uses) of the documents that are articles, in the language if one is given. `chosen` gets a batch's
    doc_id and tells which of its texts are read at all."""
    fields = {f.name: f.dataType.simpleString() for f in documents.select(*keep).schema}
    sent = None if language is None else shared(documents.sparkSession, language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent().has if sent else None
        for b in batches:
            if chosen is not None:
                b = b.filter(pa.array(chosen(b.column("doc_id").to_numpy())))
            counts = [article_words(t.as_py()) for t in b.column("text")]
            if test:
                counts = [c if c and test(c) else None for c in counts]
            at = pa.array([i for i, c in enumerate(counts) if c], pa.int64())
            own = [c for c in counts if c]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keep), pa.array([list(c) for c in own], pa.list_(pa.string())), pa.array([list(c.values()) for c in own], pa.list_(pa.int32()))], names=[*keep, "words", "uses"])

    schema = ", ".join(f"{k} {t}" for k, t in fields.items())
    return documents.where("text is not null").select(*keep, "text").mapInArrow(run, f"{schema}, words array<string>, uses array<int>")


def _labelled(texts: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, level, words, uses) of the labelled articles. No text moves: labels go to the texts, or, where they are too
    many, a bitmap of fixed size does, and the words it lets through meet the labels."""
    named = written(named)
    if counted(named) <= BROADCAST_LABELS:
        return _word_counts(texts.join(F.broadcast(named), "doc_id"), ["doc_id", "level"])
    place = F.pmod(F.col("doc_id"), F.lit(FILTER_BITS))
    blocks = named.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = bytearray(FILTER_BITS // 8 + 4096)
    for r in blocks.toLocalIterator():  # FILTER_BITS bits in blocks of 4096 bytes, whatever the number of labels
        at = max(0, r.block - 1) * 4096 if r.block else FILTER_BITS // 8
        bits[at : at + len(r.bits)] = r.bits
    sent = shared(texts.sparkSession, bytes(bits))

    def chosen(ids: np.ndarray) -> np.ndarray:
        p = ids % FILTER_BITS
        # Places count from 1 in blocks of 32768; place 0 has the block of its own behind the others.
        at = np.where(p == 0, FILTER_BITS, p - 1)
        own = np.frombuffer(sent(), np.uint8)
        return (own[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    return _word_counts(texts, ["doc_id"], chosen=chosen).join(named, "doc_id")


def learned_language(articles: DataFrame) -> Language:
    """The language of the labelled articles (doc_id, words, uses), which most of them must be written in: their trigrams
    and their median score. At most one count per trigram, and the median, come to the driver."""
    spark = articles.sparkSession

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for ws, us in zip(b.column("words").to_pylist(), b.column("uses").to_pylist()):
                for w, u in zip(ws, us):
                    for code in word_trigrams(w):
                        seen[code] += u
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["code", "n"])

    counts = {r.code: r.n for r in articles.select("words", "uses").mapInArrow(codes, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()}
    language = Language(counts)
    if not counts:
        return language
    sent = shared(spark, language)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own.score(Counter(dict(zip(w, u)))) for w, u in zip(b.column("words").to_pylist(), b.column("uses").to_pylist())], pa.float64())], names=["score"])

    language.least = articles.select("words", "uses").mapInArrow(scores, "score double").agg(F.percentile_approx("score", 0.5, 10_000)).first()[0] - MOST_FOREIGN
    return language


def _in_language(articles: DataFrame, language: Language) -> DataFrame:
    sent = shared(articles.sparkSession, language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = sent().has
        for b in batches:
            yield b.filter(pa.array([has(Counter(dict(zip(w, u)))) for w, u in zip(b.column("words").to_pylist(), b.column("uses").to_pylist())], pa.bool_()))

    return articles.mapInArrow(run, articles.schema)


def word_grades(graded: DataFrame) -> DataFrame:
    """(word, grade, g0 .. g4): acquisition grades from (doc_id, level, part, words).

    The grade is the mean level of a reader who meets the word: level by level the share of documents that have it,
    normalised over levels. g<part> leaves out the documents of one part.
    """
    totals = {(r.part, r.level): r.n for r in graded.groupBy("part", "level").agg(F.count("*").alias("n")).collect()}  # at most PARTS x LEVELS rows
    cells = [(p, lv) for p in range(PARTS) for lv in range(1, LEVELS + 1)]
    counts = graded.select("part", "level", F.explode("words").alias("word")).groupBy("word").agg(*(F.count_if((F.col("part") == p) & (F.col("level") == lv)).alias(f"n{p}_{lv}") for p, lv in cells))

    def grade(left_out: int | None):
        parts = [p for p in range(PARTS) if p != left_out]
        seen = sum((F.col(f"n{p}_{lv}") for p in parts for lv in range(1, LEVELS + 1)), F.lit(0))
        rates = []
        for lv in range(1, LEVELS + 1):
            n = sum(totals.get((p, lv), 0) for p in parts)
            if n:
                rates.append((lv, sum((F.col(f"n{p}_{lv}") for p in parts), F.lit(0)) / F.lit(float(n))))
        if not rates:
            return F.lit(None).cast("double")
        mean = sum((r * lv for lv, r in rates), F.lit(0.0)) / sum((r for _, r in rates), F.lit(0.0))
        return F.when(seen >= LEAST_DOCUMENTS, mean)

    return counts.select("word", grade(None).alias("grade"), *(grade(p).alias(f"g{p}") for p in range(PARTS)))


def _sample_features(graded: DataFrame, lexicon: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and levels of a bounded sample of labelled documents, with grades from the other parts."""
    chosen = graded.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_DOCUMENTS)  # ids alone meet in one task
    sample = graded.join(F.broadcast(chosen), "doc_id", "left_semi")
    used = sample.select("doc_id", "level", "part", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("uses").alias("use"))))
    own = F.element_at(F.array(*(F.col(f"g{p}") for p in range(PARTS))), F.col("part") + 1)
    rows = used.join(lexicon, "word").select("doc_id", "level", own.alias("g"), "use").where("g is not null").groupBy("doc_id").agg(F.first("level").alias("level"), F.sort_array(F.collect_list(F.struct("g", "use"))).alias("e"))
    got = rows.orderBy("doc_id").mapInArrow(_described, "level int, x array<double>").collect()  # at most CALIBRATION_DOCUMENTS rows
    return np.array([r.x for r in got]), np.array([r.level for r in got], int)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(np.array([x["g"] for x in e]), np.array([x["use"] for x in e])).tolist() for e in b.column("e").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("level"), pa.array(rows, pa.list_(pa.float64()))], names=["level", "x"])


def reading_levels(documents: DataFrame, labels: DataFrame, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, reading_level): one row per document that is an article in English prose.

    Null, blank and withdrawn texts and other languages have no row; the language is told from the prose, not from a
    column, and learned from the labelled texts, most of which must be in it. A document without known words gets the most frequent level of the labelled ones, or the middle of the scale
    where nothing is labelled. Word grades use all labelled documents.
    """
    named = consensus(labels)
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    articles = written(_labelled(texts, named).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")))
    language = learned_language(articles)
    graded = written(_in_language(articles, language))
    lexicon = written(word_grades(graded).where("grade is not null"))
    x, level = _sample_features(graded, lexicon)
    frequent = graded.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(1).collect()
    model = calibrated(x, level, frequent[0].level if frequent else (LEVELS + 1) // 2)
    if lexicon.count() <= lexicon_words:
        return _scored(texts, lexicon, model, language)
    return _scored_by_join(texts, lexicon, model, language)


def _scored(texts: DataFrame, lexicon: DataFrame, model: Model, language: Language) -> DataFrame:
    words = {r.word: r.grade for r in lexicon.select("word", "grade").toLocalIterator()}  # its size was checked
    sent = shared(texts.sparkSession, (words, model, language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model, language = sent()
        get = words.get
        for b in batches:
            ids, levels = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                counts = article_words(text.as_py())
                if counts and language.has(counts):
                    known = [(g, u) for w, u in counts.items() if (g := get(w)) is not None]
                    ids.append(doc)
                    levels.append(model.level(features(*np.array(known).T)) if known and len(model.mean) else model.usual)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(levels, pa.int32())], names=["doc_id", "reading_level"])

    return texts.mapInArrow(run, "doc_id bigint, reading_level int")


def _scored_by_join(texts: DataFrame, lexicon: DataFrame, model: Model, language: Language) -> DataFrame:
    """The same levels with a lexicon of any size: words are joined, and a document's grades come together again."""
    sent = shared(texts.sparkSession, model)
    counts = written(_word_counts(texts, ["doc_id"], language))
    used = counts.select("doc_id", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("uses").alias("use"))))
    known = used.join(lexicon.select("word", F.col("grade").alias("g")), "word").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("g", "use"))).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for b in batches:
            levels = [model.level(features(np.array([x["g"] for x in e]), np.array([x["use"] for x in e]))) if e and len(model.mean) else model.usual for e in b.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(levels, pa.int32())], names=["doc_id", "reading_level"])

    return counts.select("doc_id").join(known, "doc_id", "left").mapInArrow(run, "doc_id bigint, reading_level int")


def level_profile(levels: DataFrame) -> DataFrame:
    """(reading_level, documents) over a corpus."""
    return levels.groupBy("reading_level").agg(F.count("*").alias("documents"))
