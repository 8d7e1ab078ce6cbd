"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut into two segments, the first of l // 2 letters. One edit spares one of
them. So a word is indexed under each of its segments, and a word of length l or l + 1 is probed
with its own substrings: its first letters against first segments, and its last letters, which
in a longer word stand one place further right, against second segments. What meets is
verified to be one edit apart, and each pair counts once.

What the two words do not share yet is a window, half of the word. Where a segment has too many
words, the same cut is made again in their windows, which is the same rule one level down: one
edit spares one of the window's two segments. A window of one letter is never cut, and then only
so many words as there are letters can meet. No group is compared beyond that, and none is capped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import scratch, skew_join, slices, staged

#: Letters in Latin-1: A-Z as a-z, C0-FF as they are; all else separates.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Every so many hashes a letter is lost.
LOSS = 97
#: Different words that a task counts before it passes them on.
HELD = 200_000
#: Words under a segment beyond which it is cut again.
CROWDED = 512


def misspelt(word: bytes, at: int) -> bytes:
    at %= len(word)
    return word[:at] + word[at + 1 :]


def spelt(doc_id: int | None, text: str, lossy: bool) -> Counter:
    """Lower-cased runs of letters (Latin-1 bytes) of a text, each with its count.

    Characters beyond Latin-1 separate. If ``lossy``, a run loses a letter where its hash with the
    document's id says so, in all its places in the document alike.
    """
    found = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
    if lossy and found:
        words = list(found)
        utf8 = [w if w.isascii() else w.decode("latin-1").encode() for w in words]
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        hashes = np.fromiter(map(zlib.crc32, utf8, repeat(start)), np.uint32, len(words))
        hit = [(words[i], int(hashes[i])) for i in np.flatnonzero(hashes % LOSS == 0).tolist()]
        lost = [(word, misspelt(word, h), found[word]) for word, h in hit]
        for word, _, _ in lost:
            del found[word]
        for _, other, n in lost:
            found[other] += n
    return found


def word_counts(docs: DataFrame, shortest: int, lossy: bool = False) -> DataFrame:
    """word, n: all occurrences in the whole texts of ``docs`` (doc_id, text)."""

    def run(batches):
        total: Counter = Counter()

        def rows():
            words = [w for w in total if len(w) >= shortest]
            out = pa.record_batch([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, 1):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        total.update(spelt(doc_id, text, lossy))
                if len(total) > HELD:
                    yield rows()
        yield rows()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def cut(entries: DataFrame) -> DataFrame:
    """Each entry twice: without the window's first segment, and without its second.

    The window [a, b) of a word is what others under its key need not share. Segments are those
    of the indexed word, whose length is ``l``; a longer word's window is one longer.
    """
    window = F.col("l") - F.col("a") - (F.length("word") - F.col("b"))
    first = F.floor(window / 2).cast("int")
    both = F.array(F.struct((F.col("a") + first).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") - (window - first)).cast("int").alias("b")))
    out = entries.select("word", "l", "indexed", F.explode(both).alias("w"))
    shared = F.xxhash64("l", "w.a", F.substring("word", F.lit(1), F.col("w.a")), F.expr("substring(word, w.b + 1)"))
    return out.select("word", "l", "indexed", F.col("w.a").alias("a"), F.col("w.b").alias("b"), shared.alias("key"))


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(u, v): the pairs of different words (column ``word``) that are one edit apart, each once.

    Keys are 64-bit hashes of a length and the letters shared; what two keys mixed up would
    add is refused by the comparison of the words themselves.
    """
    own = words.select("word", F.length("word").alias("b"))
    lengths = F.array(F.struct(F.col("b").alias("l"), F.lit(True).alias("indexed")), F.struct(F.col("b").alias("l"), F.lit(False).alias("indexed")), F.struct((F.col("b") - 1).alias("l"), F.lit(False).alias("indexed")))
    entries = own.select("word", F.lit(0).alias("a"), "b", F.explode(lengths).alias("e")).select("word", "a", "b", "e.l", "e.indexed")
    found = None
    while True:
        entries = staged(cut(entries), "segments")
        narrow = F.col("l") - F.col("a") - (F.length("word") - F.col("b")) <= 1
        index = F.count(F.when(F.col("indexed"), 1))
        crowded = entries.groupBy("key").agg(F.count("*").alias("many"), index.alias("index"), F.min(narrow).alias("narrow"))
        crowded = staged(crowded.where(f"many > {CROWDED} AND index > 0 AND NOT narrow").select("key"), "crowded")
        some = not crowded.isEmpty()
        if some:  # a key of a third of all words is spread
            marked = skew_join(entries, crowded.withColumn("again", F.lit(True)), "key", "left")
            entries = staged(marked, "segments")
        here = entries.where("again IS NULL") if some else entries
        left = here.where("indexed").select("key", F.col("word").alias("u"))
        right = here.where("NOT indexed").select("key", F.col("word").alias("v"), (F.length("word") > F.col("l")).alias("longer"))
        near = left.join(right, (left["key"] == right["key"]) & (F.col("longer") | (F.col("u") < F.col("v"))) & (F.levenshtein("u", "v", 1) == 1)).select("u", "v")
        near = staged(near, "near-words")
        found = near if found is None else found.unionAll(near)
        if not some:
            return found.distinct()
        entries = entries.where("again")


def forms(words: DataFrame, pairs: DataFrame, times: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: a word's form is its near word of largest count (of equals
    the first in code-point order) if that is at least ``times`` the word's own count."""
    both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counted = both.join(words.select(F.col("word").alias("v"), F.col("n").alias("v_n")), "v")
    best = counted.groupBy(F.col("u").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("v_n")).alias("less"), F.col("v").alias("form"))).alias("best"))
    out = words.select("word", "n").join(best, "word", "left")
    taken = -F.col("best.less") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """Adds ``root``: the last of word, its form, that one's form and so on.

    Counts at least double from word to form, so chains end, after as many rounds as the largest
    count has binary digits at most. A form has no more words of its own than one edit can make.
    """
    pending = formed.where("form IS NOT NULL").select("word", "form")
    done = staged(formed.where("form IS NULL").select("word", F.col("word").alias("root")), "word-roots")
    out, last = done, done
    while True:
        reached = pending.join(last.select(F.col("word").alias("form"), "root"), "form").select("word", "root")
        last = staged(reached, "word-roots")
        if last.isEmpty():
            return formed.join(out, "word")
        out = out.unionAll(last)


def spelling_variants(docs: DataFrame, shortest: int = 5, rarest: int = 3, times: int = 2, lossy: bool = False) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of all whole texts of ``docs``.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased, of at
    least ``shortest`` letters and with ``rarest`` occurrences in all. Null and empty texts have none; a
    repeated row counts again; a null id hashes as the empty string. ``lossy`` takes a letter
    out of every 97th different run of a document, as a test of the grouping. An empty table
    gives an empty result; other columns are not read.
    """
    with scratch():
        words = staged(word_counts(docs, shortest, lossy).where(F.col("n") >= rarest), "words")
        formed = staged(forms(words, one_edit_pairs(words), times), "word-forms")
        out = staged(with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n"), "spelling-variants", keep=True)
    return out


def document_variants(docs: DataFrame) -> DataFrame:
    """The contract's rows: five letters, three occurrences, forms of twice the count."""
    return spelling_variants(docs, lossy=True)
