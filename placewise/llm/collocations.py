"""Collocations from truncated suffix trees, built a group of prefixes at a time.

The tree of all word sequences of up to ``DEPTH`` words is partitioned vertically: word prefixes that occur no more often
than a task's budget are put together into groups of about that many occurrences; a prefix above the budget is extended
by a further word until its extensions fit. Every occurrence (suffix) of a group's prefixes, cut at ``DEPTH`` words, is
sent to its group, equal ones of a stretch of text already counted; the commonest words, a fixed number at most, go as
places in an array that all tasks have, so what a suffix takes doesn't depend on how many groups there are. A group is sorted once and is then a subtree: its
leaves are runs of equal suffixes, and a node's count is the sum over the leaves below it.

Words are 64-bit hashes of language and bytes from the counts on; two words of one corpus of 10^8 different words share
a hash with probability 3e-4. The strings come back by a join at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placewise.llm.blocks import BITS, bit_filter, may_hold
from placewise.llm.segments import runs
from placewise.llm.text import LOWER_BYTE, mix, prefix_sums, span_hash, text_blocks
from placewise.session import written

#: Words of the longest phrase; four 16-bit places in a stretch's own dictionary make one 64-bit suffix.
DEPTH = 4
#: Words of a stretch, whose dictionary then has 16-bit places with the words that follow it and the empty place.
STRETCH = (1 << 16) - DEPTH
#: Occurrences that a group holds, up to one more prefix of as many.
BUDGET = 1 << 20
#: Words that are sent as places in a shared array, at most, and stretches that are sent together: with the words of these
#: that aren't in the array there are less than 2^24 places.
HEAD, SENT = 1 << 20, 16
#: Tasks that build subtrees, at most; beyond, a task builds one after another.
TASKS = 1 << 15
#: Bytes of text that are counted together.
COUNTED = 1 << 22
UNKNOWN = "und"
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BLANK[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of a block of texts: where they stand, their hashes, and whether the next one follows in the same piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    followed: np.ndarray
    lang: np.ndarray


def _language(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def split(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Words:
    apart = _BREAK[data]
    inside = ~(apart | _BLANK[data])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    names = pc.dictionary_encode(part.column("lang"))
    salt = mix(np.array([_language(n) for n in names.dictionary.to_pylist()], np.uint64))
    owner = np.searchsorted(offsets, starts, "right") - 1
    lang = names.indices.to_numpy()[owner]
    hashes = mix(span_hash(prefix_sums(LOWER_BYTE[data]), starts, ends) ^ salt[lang])
    hashes[hashes == 0] = 1
    piece = np.append(0, np.cumsum(apart))[starts]
    followed = np.zeros(len(starts), bool)
    followed[:-1] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
    return Words(data, starts, ends, hashes, followed, lang)


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, h, n`` of all words of ``lang, text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, data, offsets in text_blocks(rows, "text", COUNTED):
                w = split(part, data, offsets)
                hashes, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                raw = _LOWER[data].tobytes()
                words = [raw[a:b] for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist())]
                names = pc.dictionary_encode(part.column("lang")).dictionary.take(pa.array(w.lang[first]))
                yield pa.RecordBatch.from_pydict({"lang": names, "word": pa.array(words, pa.binary()).cast(pa.string()), "h": hashes.view(np.int64), "n": n})

    return docs.mapInArrow(count, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


@dataclass
class Groups:
    """The vertical partition: for each prefix length the prefixes to extend and where groups begin, by prefix hash."""

    heavy: list[np.ndarray] = field(default_factory=list)
    begins: list[np.ndarray] = field(default_factory=list)

    def of(self, words: list[np.ndarray]) -> np.ndarray:
        """The group of each suffix, given as its words' hashes."""
        out, below, todo = np.zeros(len(words[0]), np.int64), 0, np.ones(len(words[0]), bool)
        for k, (heavy, begins) in enumerate(zip(self.heavy, self.begins)):
            prefix = grown(words, k + 1)
            longer = np.isin(prefix, heavy)
            here = todo & ~longer
            out[here] = below + np.maximum(np.searchsorted(begins, prefix[here], "right") - 1, 0)
            todo &= longer
            below += max(len(begins), 1)
        return out

    @property
    def count(self) -> int:
        return sum(max(len(b), 1) for b in self.begins)

    def depth(self, group: int) -> int:
        """The length of the prefixes that a group holds whole; shorter ones are spread over groups."""
        return int(np.searchsorted(np.cumsum([max(len(b), 1) for b in self.begins]), group, "right")) + 1

    def open(self, words: list[np.ndarray]) -> np.ndarray:
        """Which suffixes begin with a prefix that is above the budget at every length so far."""
        todo = np.ones(len(words[0]), bool)
        for k, heavy in enumerate(self.heavy):
            todo &= np.isin(grown(words, k + 1), heavy)
        return todo


def grown(words: list[np.ndarray], k: int) -> np.ndarray:
    """A hash of the first ``k`` words."""
    total = words[0].view(np.uint64)
    for w in words[1:k]:
        total = mix(total * _ODD + w.view(np.uint64))
    return total.view(np.int64)


def _stretches(w: Words, frequent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each stretch its dictionary of hashes, its different suffixes of two words or more, and how often each occurs.

    A suffix ends with its piece, or before a word that is surely not frequent: no frequent phrase goes on there.
    """
    hashes = np.where(may_hold(frequent, w.hashes), w.hashes, np.uint64(0))
    for a in range(0, len(hashes), STRETCH):
        b = min(a + STRETCH, len(hashes))
        here = np.zeros(b - a + DEPTH, np.uint64)
        seen = hashes[a : b + DEPTH - 1]
        here[1 : len(seen) + 1] = seen
        dictionary, place = np.unique(here, return_inverse=True)  # the empty place is there, and first
        place = np.append(place[1:], np.zeros(DEPTH, np.int64)).astype(np.uint64)
        on = np.append(w.followed[a : a + len(seen)], np.zeros(DEPTH, bool))
        suffix, goes = place[: b - a] << np.uint64(48), place[: b - a] > 0
        for k in range(1, DEPTH):
            goes = goes & on[k - 1 : k - 1 + b - a] & (place[k : k + b - a] > 0)
            suffix = suffix | np.where(goes, place[k : k + b - a] << np.uint64(48 - 16 * k), np.uint64(0))
        suffix = suffix[(suffix >> np.uint64(32)) & np.uint64(0xFFFF) > 0]
        if len(suffix):
            yield dictionary, *np.unique(suffix, return_counts=True)


def _unpacked(dictionary: np.ndarray, suffix: np.ndarray) -> list[np.ndarray]:
    return [dictionary[((suffix >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(DEPTH)]


def _begins(prefixes: DataFrame, budget: int) -> np.ndarray:
    """Where groups begin when prefixes (``h, n``) are laid in the order of their hash and cut at each ``budget``.

    Totals run inside 4096 ranges of the hash; the driver adds up the ranges, and holds one number per group.
    """
    spark = prefixes.sparkSession
    light = prefixes.select("h", F.least("n", F.lit(budget)).alias("n"), F.shiftright("h", 52).alias("range"))
    totals = sorted(light.groupBy("range").agg(F.sum("n")).collect())
    before = spark.createDataFrame([(r, t) for (r, _), t in zip(totals, np.cumsum([0, *(n for _, n in totals)]).tolist())], "range long, before long")
    running = F.sum("n").over(Window.partitionBy("range").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    dealt = light.withColumn("to", running).join(F.broadcast(before), "range")
    group = F.floor((F.col("before") + F.col("to") - F.col("n")) / budget)
    return np.sort(np.array([r[0] for r in dealt.groupBy(group.alias("group")).agg(F.min("h").alias("h")).select("h").collect()], np.int64))


def partition(docs: DataFrame, words: DataFrame, frequent, budget: int) -> tuple[Groups, DataFrame]:
    """The groups, and ``w, f`` of the phrases that were extended, whose occurrences no group holds whole.

    Further passes over the texts count extensions, and only where a prefix is above the budget.
    """
    spark, groups, prefixes = docs.sparkSession, Groups(), words.select("h", "n", F.array("h").alias("w"))
    extended = prefixes.select("w", F.col("n").alias("f")).where(F.lit(False))
    for depth in range(1, DEPTH + 1):
        heavy = [] if depth == DEPTH else [r[0] for r in prefixes.where(F.col("n") > budget).select("h").collect()]
        begins = _begins(prefixes.where(F.col("n") <= budget) if depth < DEPTH else prefixes, budget)
        groups.heavy.append(np.sort(np.array(heavy, np.int64)))
        groups.begins.append(begins)
        if not heavy:
            break
        if depth > 1:  # a sequence that ended earlier is filled up with empty places and is no phrase
            extended = extended.unionByName(prefixes.where((F.col("n") > budget) & ~F.array_contains("w", 0)).select("w", F.col("n").alias("f")))
        known = spark.sparkContext.broadcast(groups)

        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for part, data, offsets in text_blocks(rows, "text", COUNTED):
                    for dictionary, suffix, n in _stretches(split(part, data, offsets), frequent.value):
                        unpacked = _unpacked(dictionary, suffix)
                        open_ = known.value.open(unpacked)
                        longer = grown([u[open_] for u in unpacked], depth + 1)
                        h, first, which = np.unique(longer, return_index=True, return_inverse=True)
                        w = _word_lists([u[open_][first] for u in unpacked[: depth + 1]])
                        yield pa.RecordBatch.from_pydict({"h": h, "n": np.bincount(which, n[open_], len(h)).astype(np.int64), "w": w})

        counted = docs.mapInArrow(extend, "h long, n long, w array<long>").groupBy("h").agg(F.sum("n").alias("n"), F.min("w").alias("w"))
        prefixes = written(counted, "prefixes")
    return groups, extended


def _word_lists(words: list[np.ndarray]) -> pa.ListArray:
    flat = np.stack([w.view(np.int64) for w in words], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(words), pa.int32()), pa.array(flat.ravel()))


def common_words(words: DataFrame) -> np.ndarray:
    """Hashes of the commonest words, ``HEAD`` at most, ascending after the empty place.

    Counts are taken in narrow classes, and a class goes in whole or not at all.
    """
    step = F.floor(F.log2("n") * 16)
    sizes = sorted(map(tuple, words.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True)
    fit = int(np.searchsorted(np.cumsum([n for _, n in sizes]), HEAD, "right"))
    found = words.where(step >= sizes[fit - 1][0]).select("h").toArrow().column("h").to_numpy() if fit else np.zeros(0, np.int64)
    return np.unique(np.append(found.view(np.uint64), np.uint64(0)))


def records(stretches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], groups: Groups, head: np.ndarray) -> pa.RecordBatch:
    """A row for each group: its suffixes as the places of their words, three bytes each, byte by byte, and their counts.

    Places beyond ``head`` are those in the row's own dictionary.
    """
    group, place, count, tail, n_tail = [], [], [], [], 0
    for dictionary, suffix, n in stretches:
        group.append(groups.of(_unpacked(dictionary, suffix)))
        code = np.searchsorted(head, dictionary)
        other = head[np.minimum(code, len(head) - 1)] != dictionary
        code[other] = len(head) + n_tail + np.arange(other.sum())
        tail.append(dictionary[other])
        n_tail += len(tail[-1])
        place.append(np.stack(_unpacked(code, suffix)))
        count.append(n.astype(np.int32))
    group, place, count, tail = np.concatenate(group), np.concatenate(place, axis=1), np.concatenate(count), np.concatenate(tail)
    order = np.argsort(group, kind="stable")
    group, place, count = group[order], place[:, order], count[order]
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    edges = np.append(begins, len(group))
    row = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1
    k, at = np.nonzero(place >= len(head))
    own, which = np.unique(row[at] * max(n_tail, 1) + place[k, at] - len(head), return_inverse=True)
    first = np.searchsorted(own, np.arange(len(begins) + 1) * max(n_tail, 1))
    place[k, at] = len(head) + which - first[row[at]]
    hashes = tail[own % max(n_tail, 1)] if len(own) else tail[:0]
    planes = np.ascontiguousarray(place, "<u4").view(np.uint8).reshape(DEPTH, -1, 4)[:, :, :3].transpose(0, 2, 1).reshape(3 * DEPTH, -1)
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    d = [hashes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return pa.RecordBatch.from_pydict({"group": group[begins], "d": d, "s": [planes[:, a:b].tobytes() for a, b in spans], "c": [count[a:b].tobytes() for a, b in spans]})


def _subtree(group: pa.Table, least: int, shortest: int, head: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of a group's tree that are of two words and ``shortest`` or more and occur ``least`` times."""
    dictionaries = [np.frombuffer(b, np.uint64) for b in group.column("d").to_pylist()]
    tail = np.unique(np.concatenate(dictionaries))
    every = np.concatenate([head, tail])
    high, low = [], []
    for own, packed in zip(dictionaries, group.column("s").to_pylist()):
        low_, middle, top = np.frombuffer(packed, np.uint8).reshape(DEPTH, 3, -1).astype(np.uint64).transpose(1, 0, 2)
        at = low_ | middle << np.uint64(8) | top << np.uint64(16)
        if len(own):
            other = at >= len(head)
            at[other] = np.uint64(len(head)) + np.searchsorted(tail, own).astype(np.uint64)[(at[other] - np.uint64(len(head))).astype(np.int64)]
        high.append(at[0] << np.uint64(32) | at[1])
        low.append(at[2] << np.uint64(32) | at[3])
    high, low = np.concatenate(high), np.concatenate(low)
    count = np.concatenate([np.frombuffer(b, np.int32) for b in group.column("c").to_pylist()]).astype(np.int64)
    order = np.lexsort((low, high))
    high, low, count = high[order], low[order], count[order]
    half = np.uint64(32)
    at = [high >> half, high & np.uint64(0xFFFFFFFF), low >> half, low & np.uint64(0xFFFFFFFF)]
    new = np.append(True, high[1:] != high[:-1])
    for depth in range(2, DEPTH + 1):
        if depth > 2:
            new = new | np.append(True, at[depth - 1][1:] != at[depth - 1][:-1])
        if depth < shortest:
            continue
        begins = np.flatnonzero(new)
        n = np.add.reduceat(count, begins)
        kept = begins[(n >= least) & (every[at[depth - 1][begins].astype(np.int64)] > 0)]
        if len(kept):
            w = _word_lists([every[at[k][kept].astype(np.int64)] for k in range(depth)])
            yield pa.RecordBatch.from_pydict({"w": w, "f": n[np.searchsorted(begins, kept)]})


def phrases(docs: DataFrame, words: DataFrame, least: int, budget: int) -> DataFrame:
    """``w, f``: every phrase of 2 to ``DEPTH`` words (hashes) that occurs ``least`` times, and its count.

    ``docs`` holds ``lang, text``; ``words`` the words that occur ``least`` times.
    """
    many = words.count()
    frequent = bit_filter(words.select("h"), "h", min(BITS, 1 << max(20, (32 * many).bit_length())))
    groups, extended = partition(docs, words, frequent, budget)
    known = docs.sparkSession.sparkContext.broadcast(groups)

    head = docs.sparkSession.sparkContext.broadcast(common_words(words))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, data, offsets in text_blocks(rows, "text", COUNTED):
                held = []
                for stretch in _stretches(split(part, data, offsets), frequent.value):
                    held.append(stretch)
                    if len(held) == SENT:
                        yield records(held, known.value, head.value)
                        held = []
                if held:
                    yield records(held, known.value, head.value)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["group"]):
            yield from _subtree(group, least, known.value.depth(group.column("group")[0].as_py()), head.value)

    sent = docs.mapInArrow(send, "group long, d binary, s binary, c binary")
    # a task for each group as far as Spark likes so many tasks, so that what a task reads follows from the budget
    tasks = min(groups.count, TASKS)
    nodes = sent.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group").mapInArrow(grow, "w array<long>, f long")
    return nodes.unionByName(extended.where(F.col("f") >= least))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80, most: int = 2000, scale: int = 2_000_000, budget: int = BUDGET) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``most`` strongest collocations.

    Texts are lower-cased in A-Z, split into pieces at ``.,;:!?``, line feed to carriage return, and pieces into words at
    blanks and tabs; a null text is empty, a null language ``und``. A candidate is a phrase of 2 to 4 words that occurs
    ``a >= least`` times inside pieces, overlaps included. A cut of it has the score ``floor(scale * a / (l + r))`` with
    the counts of its two parts; the cut of the lowest score counts, ties to the earliest. A candidate goes where a
    longer candidate that holds its words in a row has ``share`` per cent of its count. ``n`` counts all words of the
    language. The order is by score, count (both descending) and phrase in byte order. An empty table gives an empty
    one; repeated rows count as often as they stand there.

    Parts of a candidate occur at least as often as it does, so all counts that are needed are those of phrases that
    occur ``least`` times; nothing else leaves the trees.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    every = written(count_words(docs), "words")
    size = F.broadcast(every.groupBy("lang").agg(F.sum("n").alias("n")))
    words = every.where(F.col("n") >= least).select("lang", "word", "h", "n")
    found = written(phrases(docs, words, least, budget), "phrases")
    counts = found.unionByName(words.select(F.array("h").alias("w"), F.col("n").alias("f")))

    at = F.col("k")
    cuts = found.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("w", F.lit(1), at), "right": F.slice("w", at + 1, F.size("w") - at)})
    cuts = cuts.join(counts.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("w").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * CAST({scale} AS DECIMAL(18,0))) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    weakest = cuts.groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("w", "a", "cut.*")

    spans = [(i, m) for m in range(2, DEPTH) for i in range(1, DEPTH - m + 2)]
    inner = F.array(*[F.when(F.size("w") > m, F.slice("w", i, m)) for i, m in spans])
    inner = found.where(F.size("w") > 2).select("f", F.explode(F.filter(inner, lambda p: p.isNotNull() & (F.size(p) >= 2))).alias("w"), F.size("w").alias("of"))
    above = inner.where(F.size("w") < F.col("of")).groupBy("w").agg(F.max("f").alias("longer"))
    hidden = F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * share, F.lit(False))
    kept = weakest.join(above, "w", "left").where(~hidden)

    # all that may be among the first, ties included, before words are looked up
    kept = kept.withColumn("h", F.col("w")[0]).join(words.select("h", "lang"), "h").drop("h")
    order = [F.col("score").desc(), F.col("a").desc()]
    kept = written(kept.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most), "candidates")
    spelt = kept.select("w", F.posexplode("w").alias("pos", "h")).join(words.select("h", "word"), "h")
    spelt = spelt.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda p: p["word"]), " ").alias("phrase"))
    out = kept.drop("rank").join(spelt, "w").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= most)
    return out.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
