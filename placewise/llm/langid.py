"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the products of their probabilities; a forward pass over its bytes gives it. A text's
probability is the product over its words, and the posterior over the languages, all equally likely before, decides.

The probabilities are learnt by expectation maximisation on the counted words of the labelled texts: expected piece
counts come from the same forward pass and a backward one. Every byte is a piece too, so that no text is impossible.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placewise.llm.text import BLANK, BLOCK_BYTES, BYTE, mix, prefix_sums, span_hash, text_blocks
from placewise.llm.units import loaded
from placewise.session import written

#: Rounds of expectation maximisation, and what is added to each expected count.
ROUNDS, ADDED = 3, 0.05
#: Longer words are learnt from after the others, by length, so that short ones don't wait for their stages.
LONG = 256
#: Bytes of words that one forward pass takes, and bytes of a longer word that it takes at once.
PASS = 1 << 17
#: Bytes of scores of known words that a worker keeps.
KEPT = 1 << 25
UNKNOWN = "und"
_FILTER = 1 << 20


class Pieces:
    """The pieces of a SentencePiece model file as hashes of their bytes; the blank stands for the word mark."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind = pb.ModelProto.SentencePiece
        by_length: dict[int, dict[bytes, int]] = {1: {}}
        for i, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                by_length[1].setdefault(bytes([int(p.piece[1:-1], 16)]), i)
        for i, p in enumerate(proto.pieces):
            if p.type == kind.NORMAL:
                raw = p.piece.replace("▁", " ").encode()
                by_length.setdefault(len(raw), {})[raw] = i
        self.size, self.width = len(proto.pieces), max(by_length)
        self.tables = []
        for length, pieces in sorted(by_length.items()):
            data = np.frombuffer(b"".join(pieces), np.uint8)
            starts = np.arange(len(pieces)) * length
            hashes = span_hash(prefix_sums(BYTE[data]), starts, starts + length)
            order = np.argsort(hashes)
            maybe = np.zeros(_FILTER, bool)
            maybe[(hashes % _FILTER).astype(np.int64)] = True
            self.tables.append((length, hashes[order], np.fromiter(pieces.values(), np.int32)[order], maybe))

    def matches(self, data: np.ndarray, room: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and id of every piece in ``data``; ``room`` says how many bytes a piece may take from each start.

        Only pieces that end after ``first`` are given.
        """
        sums = prefix_sums(BYTE[data])
        found = []
        for length, hashes, ids, maybe in self.tables:
            at = np.flatnonzero(room >= length)
            at = at[np.searchsorted(at, first - length, "right") :]
            here = span_hash(sums, at, at + length)
            likely = maybe[(here % _FILTER).astype(np.int64)]
            at, here = at[likely], here[likely]
            where = np.minimum(np.searchsorted(hashes, here), len(hashes) - 1)
            same = hashes[where] == here
            found.append((at[same], np.full(int(same.sum()), length), ids[where[same]]))
        return tuple(np.concatenate(c) for c in zip(*found))


class Lattice:
    """All segmentations of some words: pieces in the order of their last byte, stage by stage."""

    def __init__(self, pieces: Pieces, data: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(lengths)), lengths)
        start, length, self.ids = pieces.matches(data, ends[word] - np.arange(len(data)))
        word = word[start]
        # a state before each byte of a word and one after its last
        self.first, self.last = ends - lengths + np.arange(len(lengths)), ends + np.arange(len(lengths))
        self.start, self.end = start + word, start + word + length
        stage = self.end - self.first[word]
        order = np.lexsort((length, self.end, stage))
        self.start, self.end, self.ids, self.word = self.start[order], self.end[order], self.ids[order], word[order]
        self.stages = np.searchsorted(stage[order], np.arange(1, lengths.max() + 2))
        self.states = len(data) + len(lengths)

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Logarithm of the summed probabilities of all ways from a word's start to each state, for each column of ``logs``."""
        alpha = np.zeros((self.states, logs.shape[1]))
        for a, b in zip(self.stages[:-1], self.stages[1:]):
            end = self.end[a:b]
            begins = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            alpha[end[begins]] = np.logaddexp.reduceat(alpha[self.start[a:b]] + logs[self.ids[a:b]], begins, axis=0)
        return alpha

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected count of each piece under one language where each word occurs ``times``."""
        alpha = self.forward(logs[:, None])[:, 0]
        beta = np.full(self.states, -np.inf)
        beta[self.last] = 0.0
        weight = logs[self.ids]
        order = np.lexsort((self.start, self.start - self.first[self.word]))[::-1]
        step = (self.start - self.first[self.word])[order]
        edges = np.append(np.flatnonzero(np.append(True, step[1:] != step[:-1])), len(step))
        for a, b in zip(edges[:-1], edges[1:]):
            here = order[a:b]
            start = self.start[here]
            begins = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
            beta[start[begins]] = np.logaddexp.reduceat(beta[self.end[here]] + weight[here], begins)
        share = np.exp(alpha[self.start] + weight + beta[self.end] - alpha[self.last][self.word])
        return np.bincount(self.ids, share * times[self.word], len(logs))


def _lowered(rows: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of their texts in lower case, as case says nothing about the language."""
    at = 0
    low = pa.RecordBatch.from_arrays([pc.utf8_lower(rows.column(rows.schema.get_field_index(text)))], ["text"])
    for part, data, offsets in text_blocks(low, "text", most):
        yield rows.slice(at, part.num_rows), data, offsets
        at += part.num_rows


def _groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring words of ``PASS`` bytes together, one at least."""
    total, a = np.append(0, np.cumsum(lengths)), 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PASS, "right")) - 1)
        yield a, b
        a = b


def _long_word(pieces: Pieces, data: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The forward pass over one word that is longer than ``PASS``, a stretch at a time."""
    width = pieces.width
    tail = np.full((width + 1, logs.shape[1]), -np.inf)  # states up to the stretch's start
    tail[-1] = 0.0
    for a in range(0, len(data), PASS):
        b, back = min(a + PASS, len(data)), max(a - width, 0)
        start, length, ids = pieces.matches(data[back:b], b - back - np.arange(b - back), a - back)
        end = start + length + back - a
        order = np.lexsort((length, end))
        end, begin, ids = end[order], (start + back - a)[order], ids[order]
        alpha = np.concatenate([tail, np.zeros((b - a, logs.shape[1]))])
        edges = np.append(np.flatnonzero(np.append(True, end[1:] != end[:-1])), len(end))
        for x, y in zip(edges[:-1], edges[1:]):
            alpha[width + end[x]] = np.logaddexp.reduce(alpha[width + begin[x:y]] + logs[ids[x:y]], axis=0)
        tail = alpha[-width - 1 :]
    return tail[-1]


def _long_expected(pieces: Pieces, data: np.ndarray, logs: np.ndarray, times: float) -> np.ndarray:
    """Expected count of each piece in one word that is longer than ``PASS``: both passes a stretch at a time.

    What stays is a number for each byte and pass; the pieces of a stretch are found again on the way back.
    """
    width, size = pieces.width, len(data)

    def stretch(a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and id of the pieces that end in the stretch after ``a``."""
        b, back = min(a + PASS, size), max(a - width, 0)
        start, length, ids = pieces.matches(data[back:b], b - back - np.arange(b - back), a - back)
        return start + back, start + back + length, ids

    def edges(sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_))
        return zip(at[:-1].tolist(), at[1:].tolist())

    alpha, beta, out = np.zeros(size + 1), np.full(size + 1, -np.inf), np.zeros(len(logs))
    for a in range(0, size, PASS):
        begin, end, ids = stretch(a)
        order = np.lexsort((begin, end))
        begin, end, weight = begin[order], end[order], logs[ids[order]]
        for x, y in edges(end):
            alpha[end[x]] = np.logaddexp.reduce(alpha[begin[x:y]] + weight[x:y])
    beta[size] = 0.0
    for a in reversed(range(0, size, PASS)):
        begin, end, ids = stretch(a)
        order = np.lexsort((begin, end))[::-1]  # a state's own sum is whole when the first piece that ends there comes
        begin, end, weight = begin[order], end[order], logs[ids[order]]
        for x, y in edges(end):
            beta[begin[x:y]] = np.logaddexp(beta[begin[x:y]], weight[x:y] + beta[end[x]])
        out += np.bincount(ids[order], np.exp(alpha[begin] + weight + beta[end] - alpha[size]), len(logs))
    return out * times


def expected_counts(pieces: Pieces, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Expected count of each piece under one language in words of any length that occur ``times``, each after its mark."""
    order = np.argsort(np.maximum(ends - starts, LONG), kind="stable")
    starts, ends, times = starts[order], ends[order], times[order]
    total = np.zeros(len(logs))
    for a, b in _groups(ends - starts + 1):
        marked, lengths = _marked(data, starts[a:b], ends[a:b])
        if lengths[0] > PASS:
            total += _long_expected(pieces, marked, logs, times[a])
        else:
            total += Lattice(pieces, marked, lengths).expected(logs, times[a:b])
    return total


def word_scores(pieces: Pieces, data: np.ndarray, lengths: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log probabilities of words laid end to end, a column per language."""
    out = np.zeros((len(lengths), logs.shape[1]))
    at = np.append(0, np.cumsum(lengths))
    for a, b in _groups(lengths):
        if lengths[a] > PASS:
            out[a] = _long_word(pieces, data[at[a] : at[b]], logs)
        else:
            lattice = Lattice(pieces, data[at[a] : at[b]], lengths[a:b])
            out[a:b] = lattice.forward(logs)[lattice.last]
    return out


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no white space, inside documents."""
    inside = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words laid end to end, each after its mark."""
    lengths = ends - starts + 1
    at = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(at, lengths) + np.repeat(starts, lengths) - 1
    out = data[np.maximum(place, 0)]
    out[at] = 32
    return out, lengths


@dataclass(frozen=True)
class Model:
    path: str
    languages: list[str]
    #: Log probability of each piece, a column per language.
    logs: np.ndarray

    @cached_property
    def pieces(self) -> Pieces:
        return loaded(("language pieces", self.path), lambda: Pieces(self.path))


class Scorer:
    """Scores of texts, with the word scores that a worker keeps while they fit in ``KEPT`` bytes."""

    def __init__(self, model: Model):
        self.model = model
        self.known, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)))
        self.most = KEPT // (8 * len(model.languages))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log probability of each document, a row each."""
        starts, ends = _spans(data, offsets)
        hashes, first, which = np.unique(span_hash(prefix_sums(BYTE[data]), starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        values = np.zeros((len(hashes), self.values.shape[1]))
        values[~new] = self.values[at[~new]]
        if new.any():
            values[new] = word_scores(self.model.pieces, *_marked(data, starts[first[new]], ends[first[new]]), self.model.logs)
            if len(self.known) < self.most:
                every = np.concatenate([self.known, hashes[new]])
                order = np.argsort(every)
                self.known, self.values = every[order], np.concatenate([self.values, values[new]])[order]
        owner = np.searchsorted(offsets, starts, "right") - 1
        return np.stack([np.bincount(owner, v[which], len(offsets) - 1) for v in values.T], axis=1)


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its key as text is 1 modulo 3. A null key is not."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, word, n``: how often each word, of any length, stands in the texts of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part, data, offsets in _lowered(rows, "text", 1 << 22):
                names = pc.dictionary_encode(part.column("lang"))
                starts, ends = _spans(data, offsets)
                owner = np.searchsorted(offsets, starts, "right") - 1
                code = names.indices.to_numpy()[owner].astype(np.uint64)
                hashes = mix(span_hash(prefix_sums(BYTE[data]), starts, ends) ^ mix(code + np.uint64(1)))
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_pydict({"lang": names.dictionary.take(pa.array(code[first].astype(np.int32))), "word": pa.array(words, pa.binary()), "n": n})

    counted = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(count, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", rounds: int = ROUNDS) -> Model:
    """Piece probabilities of every language of ``docs``, learnt from all its texts.

    Rows with a null text or language teach nothing; without any the model knows no language. Words of any length are
    learnt from, so also languages that write without blanks. They are counted
    and written once, each round reads them in tasks that send one expected count per language and piece: the driver
    holds languages x vocabulary and nothing that grows with the texts.
    """
    spark = docs.sparkSession
    words = written(count_words(docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()), text, lang), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    size = Pieces(path).size
    logs = np.full((size, len(languages)), -np.log(size))
    for _ in range(rounds if languages else 0):
        model = spark.sparkContext.broadcast(Model(path, languages, logs))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            totals: dict[str, np.ndarray] = {}
            for rows in batches:
                for name in pc.unique(rows.column("lang")).to_pylist():
                    mine = rows.filter(pc.equal(rows.column("lang"), name))
                    found, column = mine.column("word").cast(pa.large_binary()), np.ascontiguousarray(m.logs[:, m.languages.index(name)])
                    data, at = np.frombuffer(found.buffers()[2], np.uint8), np.frombuffer(found.buffers()[1], np.int64)[found.offset :]
                    total = totals.setdefault(name, np.zeros(len(column)))
                    total += expected_counts(m.pieces, data, at[: len(found)], at[1 : len(found) + 1], mine.column("n").to_numpy(), column)
            for name, total in totals.items():
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(ids), pa.string()), "id": ids, "n": total[ids]})

        made = words.mapInArrow(expect, "lang string, id long, n double").groupBy("lang", "id").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full(logs.shape, ADDED)
        column = pc.index_in(made.column("lang"), pa.array(languages, pa.string())).to_numpy()
        counts[made.column("id").to_numpy(), column] += made.column("n").to_numpy()
        logs = np.log(counts / counts.sum(axis=0))
        model.unpersist()
    return Model(path, languages, logs)


def predict(docs: DataFrame, model: Model, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of each whole text in ``to`` and its posterior probability in ``score``.

    A null text, one without any letter, and every text where the model knows no language are ``und`` with score 0.
    Equal probabilities go to the alphabetically first language. Columns named as the new ones are replaced, all others
    stay; an empty table gives an empty one.
    """
    docs = docs.drop(to, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value.languages else None
        for rows in batches:
            for part, data, offsets in _lowered(rows, text):
                names, sure = np.full(part.num_rows, None, object), np.zeros(part.num_rows)
                if scorer is not None:
                    total = scorer(data, offsets)
                    names = np.array(shared.value.languages, object)[total.argmax(axis=1)]
                    sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                yield part.append_column(to, pa.array(names, pa.string())).append_column(score, pa.array(sure))

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(to, T.StringType()), T.StructField(score, T.DoubleType())]))
    known = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.col(to).isNotNull()
    return out.withColumns({to: F.when(known, F.col(to)).otherwise(F.lit(UNKNOWN)), score: F.when(known, F.col(score)).otherwise(F.lit(0.0))})
