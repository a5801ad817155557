"""LM scores by subword lattices.

A text is a sequence of pieces and one end: pieces that begin with the space mark
begin a word, so words' piece sequences follow one another without ambiguity. Each
piece and the end have a probability; a word's probability is the sum over all ways
to cut it into pieces, by forward recursion over its lattice in log space; a
text's is the product over its words, and the end.

Weights start from an existing vocabulary's scores and are re-estimated on training
documents by expectation-maximisation: expected piece counts of all distinct training
words, weighted by how often each occurs, beside the vocabulary's scores as
``prior`` pseudo-counts a piece on average. What is gathered from the corpus are
words with counts, on the executors; to the driver come expected counts of the
vocabulary's pieces alone, which its size bounds.

The plain word-unigram score with add-one smoothing is returned beside it.

To reach their documents, words' scores go to blocks of some three million words,
each block asking once for each of its distinct words. Documents are dealt to blocks
by the hash of id and text, so no source or group of copies fills one.

Defined results: a null or empty text is the end alone; without training documents
weights are the vocabulary's and the end counts once; repeated rows are scored each
(and count in training each); a null id counts as the text "" in the fold's hash;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, texts
from .unigram import SPACE, Vocabulary, vocabulary

#: Words in a block; Arrow rows sent at once; characters beyond which, and a probability below which, a word is summed in log space in training.
BLOCK_WORDS, ROWS, LONG, LEAST = 3_000_000, 100_000, 60, 1e-200


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, as UTF-8."""
    return (text or "").encode().lower().split()


class Lattice:
    """Forward (and backward) recursion over a word's segmentations under given weights.

    Words that come in order share prefixes: what is known of the last word's first
    characters is kept. Training takes probabilities where a word is short and
    likely enough for them, and log space beyond; scores are always in log space.
    """

    def __init__(self, v: Vocabulary, log_p: list[float]):
        self.v = v
        self.log = {p: log_p[k] for p, k in v.index.items()}
        self.byte_log = [log_p[v.bytes[b]] if b in v.bytes else -math.inf for b in range(256)]
        self.weight = {p: (math.exp(x), v.index[p]) for p, x in self.log.items()}
        self.last, self.forward = "", [0.0]
        self.seen, self.linear, self.edges_of = "", [1.0], [[]]

    def edges(self, s: str, i: int) -> list[tuple[int, float]]:
        """(start, log weight) of the pieces that end at ``i``; a character that is no piece by its bytes."""
        get = self.log.get
        out = [(j, w) for j in range(max(0, i - self.v.longest), i) if (w := get(s[j:i])) is not None]
        if s[i - 1] not in self.log:
            out.append((i - 1, sum([self.byte_log[b] for b in s[i - 1].encode()])))
        return out

    def log_marginal(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations."""
        s = SPACE + word
        a = self.forward
        del a[_common(s, self.last) + 1 :]
        exp, log = math.exp, math.log
        for i in range(len(a), len(s) + 1):
            terms = [a[j] + w for j, w in self.edges(s, i)]
            top = max(terms)
            a.append(top if len(terms) == 1 else top + log(sum([exp(t - top) for t in terms])))
        self.last = s
        return a[-1]

    def expect(self, word: str, times: float, into: list[float]) -> None:
        """Add the expected counts of each piece in ``times`` occurrences of ``word``."""
        if len(word) > LONG:
            self._expect_long(word, times, into)
            return
        s = SPACE + word
        n = len(s)
        a, edges = self.linear, self.edges_of
        keep = _common(s, self.seen) + 1
        del a[keep:], edges[keep:]
        get, longest = self.weight.get, self.v.longest
        for i in range(len(a), n + 1):
            own = [(j, *x) for j in range(max(0, i - longest), i) if (x := get(s[j:i])) is not None]
            if s[i - 1] not in self.weight:
                own.append((i - 1, math.exp(sum([self.byte_log[b] for b in s[i - 1].encode()])), -1))
            edges.append(own)
            a.append(sum([a[j] * w for j, w, _ in own]))
        self.seen = s
        if a[n] < LEAST:  # what a cut's probability loses below this floor is no share of the word
            self._expect_long(word, times, into)
            return
        b = [0.0] * (n + 1)  # of all segmentations, those with a cut here
        b[n] = times
        for i in range(n, 0, -1):
            if b[i]:
                scale = b[i] / a[i]
                for j, w, k in edges[i]:
                    share = scale * a[j] * w
                    b[j] += share
                    if k >= 0:
                        into[k] += share
                    else:
                        for x in s[j:i].encode():
                            into[self.v.bytes[x]] += share

    def _expect_long(self, word: str, times: float, into: list[float]) -> None:
        s = SPACE + word
        self.log_marginal(word)
        a = self.forward
        b = [0.0] * (len(s) + 1)
        b[-1] = times
        for i in range(len(s), 0, -1):
            if b[i]:
                for j, w in self.edges(s, i):
                    share = b[i] * math.exp(a[j] + w - a[i])
                    b[j] += share
                    k = self.v.index.get(s[j:i])
                    for x in [k] if k is not None else [self.v.bytes[c] for c in s[j:i].encode()]:
                        into[x] += share


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _strings(x: list[bytes]) -> pa.Array:
    return pa.array(x, pa.binary())


def count_words(docs: DataFrame) -> DataFrame:
    """``word`` (UTF-8), ``c`` (in training) and ``c_all`` of all documents. ``docs``: doc_id, text, held.
    Counted in each task first; words meet by hash after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, rest = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(trained.keys() | rest.keys())
            for k in range(0, len(words), ROWS):
                lot = words[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([_strings(lot), pa.array([trained[w] for w in lot], pa.int64()), pa.array([trained[w] + rest[w] for w in lot], pa.int64())], names=["word", "c", "c_all"])
            trained.clear()
            rest.clear()

        for b in batches:
            for text, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (rest if held else trained).update(words_of(text))
                if len(trained) + len(rest) > 400_000:
                    yield from out()
        yield from out()

    sent = docs.select("text", "held").mapInArrow(run, "word binary, c long, c_all long")
    return sent.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def fit(words: DataFrame, v_path: str, ends: int, prior: float = 1.0, rounds: int = 1) -> tuple[list[float], float]:
    """Natural-log weights by id of piece, and of the end, after ``rounds`` of expectation-maximisation."""
    v = vocabulary(v_path)
    log_p = list(v.log_p)
    sc = words.sparkSession.sparkContext
    base = np.zeros(v.size)
    base[v.kept] = np.exp(np.array(v.log_p)[v.kept]) * prior * len(v.kept)
    end = math.log(0.5)
    for _ in range(rounds):
        shared = sc.broadcast(log_p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = vocabulary(v_path)
            lattice, sums = Lattice(own, shared.value), [0.0] * own.size
            for b in batches:
                for w, c in sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                    lattice.expect(w.decode(), c, sums)
            into = np.array(sums)
            some = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(into[some])], names=["piece", "n"])

        sums = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        n = base.copy()
        for r in sums.collect():  # a row for each piece of the vocabulary at most
            n[r["piece"]] += r["n"]
        total = n.sum() + max(ends, 1)
        log_p = [math.log(x / total) if x > 0 else -math.inf for x in n]
        end = math.log(max(ends, 1) / total)
    return log_p, end


def score(docs: DataFrame, vocabulary_path: str, prior: float = 1.0, rounds: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document."""
    t = texts(docs)
    t = t.withColumn("held", held_out(F.col("doc_id")))
    words = materialize(count_words(t), "lm-words")
    s = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum("c_all").alias("all")).first()
    ends = t.filter(~F.col("held")).count()
    n, v = (s["n"] or 0) + ends, (s["v"] or 0) + (ends > 0)
    log_p, end = fit(words, vocabulary_path, ends, prior, rounds)
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(vocabulary_path), shared.value)
        for b in batches:
            rows = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            lp = [lattice.log_marginal(w.decode()) for w, _ in rows]
            yield pa.RecordBatch.from_arrays([_strings([w for w, _ in rows]), pa.array([c for _, c in rows], pa.int64()), pa.array(lp, pa.float64())], names=["word", "c", "lp"])

    scored = words.select("word", "c").mapInArrow(run, "word binary, c long, lp double")
    blocks = max(1, math.ceil((s["all"] or 0) / BLOCK_WORDS))
    kind = t.schema["doc_id"].dataType.simpleString()
    blocked = t.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition("block")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set[bytes]] = {}
        for b in batches:
            for block, text in zip(b.column("block").to_pylist(), b.column("text").to_pylist()):
                sets.setdefault(block, set()).update(words_of(text))
        for block, some in sets.items():
            lot = list(some)
            for k in range(0, len(lot), ROWS):
                part = lot[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int32)), _strings(part)], names=["block", "word"])

    # All columns are asked for, as the scoring does: so texts are shuffled once for both.
    asks = blocked.mapInArrow(asked, "block int, word binary")
    answers = asks.join(scored, "word").select("block", "word", "c", "lp")
    end_base = math.log10((ends + 1) / (n + v + 1))
    denominator = math.log10(n + v + 1)
    ten = math.log(10)

    def sum_up(left: pa.Table, right: pa.Table) -> pa.Table:
        place = dict(zip(right.column("word").to_pylist(), range(right.num_rows))).__getitem__
        c = right.column("c").to_numpy()
        # Of each word: the logarithm of its count and one, whether it is known, its marginal.
        log_c, known, lp = np.log10(c + 1.0), c > 0, right.column("lp").to_numpy()
        sizes = np.zeros(left.num_rows, np.int64)
        sums = np.zeros((left.num_rows, 3))
        for k, text in enumerate(left.column("text").to_pylist()):
            words = words_of(text)
            at = np.fromiter(map(place, words), np.intp, len(words))
            sizes[k] = len(at)
            sums[k] = log_c[at].sum(), known[at].sum(), lp[at].sum()
        return pa.table(
            {
                "doc_id": left.column("doc_id"),
                "held_out": left.column("held"),
                "n_tokens": pa.array(sizes + 1),
                "n_known": pa.array(sums[:, 1].astype(np.int64) + (ends > 0)),
                "train_tokens": pa.array(np.full(left.num_rows, n, np.int64)),
                "base_score": pa.array(sums[:, 0] - sizes * denominator + end_base),
                "score": pa.array((sums[:, 2] + end) / ten),
            }
        )

    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sum_up, out)
