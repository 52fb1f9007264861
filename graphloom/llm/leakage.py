"""Evaluation texts inside training texts, found with a generalised suffix automaton over the words of all items.

The words of a document stream through the automaton, which holds the longest suffix of what was read that occurs in any
item. Wherever that suffix has `least` words or more, the items that contain its last `least` words are matched; runs of
such places are spans. Spans beyond a length or a coverage limit are removed from the text. The stream is skipped where no
item has the next two words in this order, which cannot lose a match.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, shared, small, written
from . import latex

#: Words in a row that make a leak.
LEAST_WORDS = 12
#: Spans of more words than this are removed ...
MOST_WORDS = 20
#: ... and all spans of an item of which they cover more than this share of its words.
MOST_COVERAGE = 0.3
#: Characters of items that go into one automaton; more items make several, which read the documents' words, parsed once.
#: Measured on article text: it takes up to 30 bytes a character while it is built and where it is held.
AUTOMATON_CHARS = 10_000_000


class Automaton:
    """Suffix automaton of several word sequences; knows for each state which items contain its words.

    Held in flat arrays: most states have one way on (`word`, `to`); only those with more have a dict, in `more`.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int = LEAST_WORDS) -> None:
        self.least = least
        self.ids: dict[str, int] = {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        texts = [(i, array("i", [self.ids.setdefault(w, len(self.ids)) for w in ws])) for i, ws in items]
        for _, ws in texts:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self._own(texts)
        sizes: dict[int, int] = {}
        for i, ws in texts:
            sizes[i] = max(sizes.get(i, 0), len(ws))
        self.item_words = sizes
        pairs = [np.array(ws[:-1], np.int64) * len(self.ids) + np.array(ws[1:], np.int64) for _, ws in texts if len(ws) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)

    def after(self, state: int, w: int) -> int:
        """The state that a word leads to, or -1."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def _lead(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (w, -1):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, link: int, length: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        there = self.after(last, w)
        if there >= 0 and self.length[there] == self.length[last] + 1:
            return there
        new = self._state(0, self.length[last] + 1) if there < 0 else -1
        p = last
        while p >= 0 and self.after(p, w) < 0:
            self._lead(p, w, new)
            p = self.link[p]
        if p < 0:
            return new
        q = self.after(p, w)
        if self.length[q] != self.length[p] + 1:
            c = self._state(self.link[q], self.length[p] + 1)
            self.word[c], self.to[c] = self.word[q], self.to[q]
            if q in self.more:
                self.more[c] = dict(self.more[q])
            while p >= 0 and self.after(p, w) == q:
                self._lead(p, w, c)
                p = self.link[p]
            self.link[q] = c
            q = c
        if new < 0:
            return q
        self.link[new] = q
        return new

    def _own(self, texts: list[tuple[int, array]]) -> None:
        """anchor[s]: the shortest state on s's suffix path with at least `least` words; its owners: the items with them."""
        length = np.frombuffer(self.length, np.int32)
        self.anchor = array("i", bytes(4 * len(self.link)))
        for s in np.argsort(length, kind="stable").tolist():
            up = self.link[s]
            self.anchor[s] = -1 if self.length[s] < self.least else s if self.length[up] < self.least else self.anchor[up]
        anchors, owners = array("i"), array("q")
        for item, ws in texts:
            at = 0
            for w in ws:
                at = self.after(at, w)
                if self.anchor[at] >= 0:
                    anchors.append(self.anchor[at])
                    owners.append(item)
        pairs = np.unique(np.c_[np.array(anchors, np.int64), np.array(owners, np.int64)], axis=0) if len(anchors) else np.empty((0, 2), np.int64)
        self.owner = array("q", pairs[:, 1].tobytes())
        self.owner_from = array("i", np.searchsorted(pairs[:, 0], np.arange(len(self.link) + 1)).astype(np.int32).tobytes())

    def bytes_held(self) -> int:
        arrays = (self.word, self.to, self.link, self.length, self.anchor, self.owner, self.owner_from)
        return sum(a.itemsize * len(a) for a in arrays) + self.pairs.nbytes + sum(240 + 100 * len(m) for m in self.more.values()) + 150 * len(self.ids)

    def matches(self, words: list[str]) -> dict[int, list]:
        """item: [first words of its spans, last words, windows of `least` words, longest match] in this document."""
        if len(words) < self.least or not len(self.pairs):
            return {}
        get = self.ids.get
        seq = np.array([get(w, -1) for w in words], np.int64)
        code = np.where((seq[:-1] >= 0) & (seq[1:] >= 0), seq[:-1] * len(self.ids) + seq[1:], -1)
        near = np.searchsorted(self.pairs, code)
        near[near == len(self.pairs)] = 0
        known = self.pairs[near] == code
        edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
        found: dict[int, list] = {}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # pairs a .. b-1, that is words a .. b
            if b - a + 1 >= self.least:
                self._stream(seq[a : b + 1].tolist(), a, found)
        return found

    def _stream(self, seq: list[int], start: int, found: dict[int, list]) -> None:
        after, link, length, least = self.after, self.link, self.length, self.least
        state = matched = 0
        for at, w in enumerate(seq, start):
            to = after(state, w)
            while state and to < 0:
                state = link[state]
                matched = length[state]
                to = after(state, w)
            if to >= 0:
                state, matched = to, matched + 1
            else:
                matched = 0
            if matched >= least:
                # The state may stand for longer words than were matched; its anchor is reached by going up.
                s = state
                while length[link[s]] >= matched:
                    s = link[s]
                a = self.anchor[s]
                for item in self.owner[self.owner_from[a] : self.owner_from[a + 1]]:
                    got = found.get(item)
                    if got is None:
                        found[item] = [[at - least + 1], [at], 1, matched]
                        continue
                    if at - least <= got[1][-1]:  # the window overlaps or touches the span before
                        got[1][-1] = at
                    else:
                        got[0].append(at - least + 1)
                        got[1].append(at)
                    got[2], got[3] = got[2] + 1, max(got[3], matched)


_SCHEMA = "doc_id bigint, text_key bigint, item_id bigint, firsts array<int>, lasts array<int>, windows int, longest int, doc_words int, item_words int"
_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "text_key", "item_id")), *((n, pa.list_(pa.int32())) for n in ("firsts", "lasts")), *((n, pa.int32()) for n in ("windows", "longest", "doc_words", "item_words"))])


def matched(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, item_id, firsts, lasts, windows, longest, doc_words, item_words): items of which `least` words in a
    row occur in a text, with their spans.

    Word places count from 0 in the document's words (latex.words). Spans are the words of windows that touch or overlap;
    `windows` is the number of places at which `least` words of the item end; `longest` the longest match through such a
    place. Null, empty and shorter texts and items match nothing. Each item_id counts for itself; of rows with one item_id
    each text counts, and item_words is the longest's. Repeated documents give a row each; text_key tells texts of one id
    apart. The items are a held-out set: it is measured, and beyond AUTOMATON_CHARS split over several automata.
    """
    spark = documents.sparkSession
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // AUTOMATON_CHARS))
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    split = passes > 1
    if split:  # parsed once for all automata

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([" ".join(latex.words(t.as_py())) for t in b.column("text")], pa.string())], names=["doc_id", "text_key", "text"])

        texts = written(texts.mapInArrow(parse, "doc_id bigint, text_key bigint, text string"))
    out = None
    for n in range(passes):
        block = own.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect()  # at most about AUTOMATON_CHARS
        automaton = shared(spark, Automaton([(r.item_id, latex.words(r.text)) for r in block], least))

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, words=str.split if split else latex.words) -> Iterator[pa.RecordBatch]:
            a = automaton()
            for b in batches:
                rows = [[] for _ in _ARROW]
                for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("text")):
                    ws = words(text.as_py())
                    for item, place in a.matches(ws).items():
                        for to, v in zip(rows, (doc, key, item, *place, len(ws), a.item_words[item])):
                            to.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _ARROW)], schema=_ARROW)

        one = texts.mapInArrow(run, _SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def _span_words():
    return F.aggregate(F.zip_with("firsts", "lasts", lambda a, b: b - a + 1), F.lit(0), lambda acc, n: acc + n)


def leaks(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, spans, span_words, longest, windows, item_coverage, doc_coverage) of matched items: how many spans
    and words, and which share of the item's and of the document's words they are (of the item's at most 1)."""
    n = _span_words()
    return found.select("doc_id", "item_id", F.size("firsts").alias("spans"), n.alias("span_words"), "longest", "windows", F.least(F.lit(1.0), n / F.col("item_words")).alias("item_coverage"), (n / F.col("doc_words")).alias("doc_coverage"))


def spans(found: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): a row per span."""
    return found.select("doc_id", "item_id", F.inline(F.arrays_zip(F.col("firsts").alias("first_word"), F.col("lasts").alias("last_word"))))


def to_remove(found: DataFrame, most_words: int = MOST_WORDS, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """(doc_id, text_key, firsts, lasts): the spans beyond a limit: of more than `most_words` words, or of an item of which the
    document's spans cover more than the share `most_coverage`."""
    whole = _span_words() / F.col("item_words") > most_coverage
    long = F.filter(F.arrays_zip(F.col("firsts").alias("a"), F.col("lasts").alias("b")), lambda x: x["b"] - x["a"] + 1 > most_words)
    kept = F.when(whole, F.arrays_zip(F.col("firsts").alias("a"), F.col("lasts").alias("b"))).otherwise(long)
    return found.withColumn("s", kept).where(F.size("s") > 0).select("doc_id", "text_key", F.transform("s", lambda x: x["a"]).alias("firsts"), F.transform("s", lambda x: x["b"]).alias("lasts"))


def cleaned(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, most_words: int = MOST_WORDS, most_coverage: float = MOST_COVERAGE) -> DataFrame:
    """(doc_id, removed_words, doc_words, text): the documents that lose words, with the text that is left.

    The words of spans beyond a limit (see `to_remove`) are taken out of the text as delivered; commands, punctuation and
    keys between them stay, so that markup stays balanced. A macro whose expansion has words of such a span is taken out
    where it is used. Documents without a row stay as they are. Repeated documents give a row each.
    """
    found = written(to_remove(matched(documents, items, least), most_words, most_coverage))
    # Spans of one text for different items; as many as the automata found there.
    per_text = found.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set(F.arrays_zip(F.col("firsts").alias("a"), F.col("lasts").alias("b")))).alias("s"))
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    # Only texts with something to remove go on; they are found by their keys, which are broadcast while few.
    affected = texts.join(small(per_text, rows=counted(found), bytes_=counted(found, "bytes")), ["doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [latex.without_words(t.as_py(), [(x["a"], x["b"]) for x in s]) for t, s in zip(b.column("text"), b.column("s").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int32()), (2, pa.int32()), (0, pa.string())))], names=["doc_id", "removed_words", "doc_words", "text"])

    return affected.select("doc_id", "text", "s").mapInArrow(run, "doc_id bigint, removed_words int, doc_words int, text string")


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, documents, longest): in how many documents each leaked item occurs."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest"))
