"""Language-model scores by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

A token is a word: one of the frequent words of the corpus, or one of the cells that rarer words hash into; the number
of tokens follows the corpus. A rarer word has its cell's probability times its own share of the cell, from the corpus
counts, so that every word is scored as itself. The network reads WINDOW tokens on each side of a masked place, each
through an embedding table of its own distance, adds them, and predicts the token by the turns of its path in a binary
tree (a hierarchical softmax: the probabilities of all tokens sum to one). Corpus counts choose the vocabulary, the tree
and the first output weights; then tasks train on all their documents, and their weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memengine.llm.common import LOWER_BYTES, as_bytes, chunks, cut, hash_filter, lookup, passes, span_hash, table, words

#: Tokens come in steps of so many; one in CELLS is a cell of rarer words.
TOKENS, CELLS = 24 * 24, 6
#: A word that makes up one in FREQUENT * root(corpus words) of the corpus is frequent, and has a token of its own. A network that
#: has to fit in every task has LARGEST tokens at most; further words are in cells, with counts of their own like any there.
FREQUENT, LARGEST = 32, 576 * 228
WINDOW, WIDTH = 2, 16
#: Rounds over the corpus; places of a gradient step, and its size; places for each token that a task trains on at least, if it can.
ROUNDS, STEP, RATE, PLACES = 1, 6144, 0.1, 256
#: Slices that a network's weights are averaged in, and networks that meet at once.
SLICES, MEET = 64, 32
_SOLID = lookup(lambda c: c not in b" \t\n\r\x0b\x0c")


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (a run of anything but white space, A-Z lower-cased), and how many each text has."""
    data = LOWER_BYTES[data]
    start, end, count = words(data, at, _SOLID)
    return span_hash(data, start, end).view(np.int64), count


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted hashes of the frequent words
    tokens: np.ndarray  # their tokens: the rank of their count
    counts: np.ndarray  # corpus count of each token
    words: DataFrame | None = None  # (h, n) of every word of the corpus; stays on the driver

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None}

    @property
    def first_cell(self) -> int:
        return len(self.counts) - len(self.counts) // CELLS

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = self.first_cell + (h.view(np.uint64) % np.uint64(len(self.counts) - self.first_cell)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.tokens[at], out)
        return out.astype(np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, at in chunks(batch.column("body"), 2 << 20):
            h, n = np.unique(word_hashes(data, at)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts of every word of every document; the driver gets the frequent ones and the total of each rare cell.

    Tokens start with TOKENS counts in all, shared evenly, so that none is impossible.
    """
    counts = cut(as_bytes(docs).mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.filter(F.col("n") * FREQUENT >= isqrt(total)).count()
    size = min(LARGEST, TOKENS * max(1, -(-frequent * CELLS // ((CELLS - 1) * TOKENS))))
    cells = size // CELLS
    top = counts.orderBy(F.desc("n"), "h").limit(size - cells).toArrow()
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(h)
    made = Vocabulary(h[order], np.arange(len(h))[order], np.full(size, TOKENS / size), counts)
    made.counts[: len(h)] += n
    # unsigned h modulo the number of cells, from its two halves
    cell = F.pmod(F.shiftrightunsigned("h", 32) * (2**32 % cells) + F.col("h").bitwiseAND(F.lit(2**32 - 1)), F.lit(cells)).alias("cell")
    for r in counts.groupBy(cell).agg(F.sum("n").alias("n")).collect():
        made.counts[size - cells + r["cell"]] += r["n"]
    made.counts[size - cells :] -= np.bincount((h.view(np.uint64) % np.uint64(cells)).astype(np.int64), n, minlength=cells)
    return made


@dataclass
class Tree:
    """The paths of tokens from the root of a Huffman tree: path i is turn[first[i] : first[i + 1]], at nodes ``node``."""

    first: np.ndarray
    node: np.ndarray
    turn: np.ndarray  # 1 or -1

    def paths(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all turns of the tokens' paths, one path after the other: place of the token, node, turn; where each path starts."""
        n = self.first[tokens + 1] - self.first[tokens]
        start = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(self.first[tokens] - start, n)
        return np.repeat(np.arange(len(tokens)), n), self.node[at], self.turn[at], start


def huffman(counts: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree of shortest mean paths, and for each node the log odds of a turn of 1."""
    n = len(counts)
    weight = [*counts.tolist(), *[0.0] * (n - 1)]
    up, side, odds = np.full(2 * n - 1, -1), np.zeros(2 * n - 1, np.float32), np.zeros(n - 1, np.float32)
    heap = [(w, i) for i, w in enumerate(counts.tolist())]
    heapify(heap)
    for made in range(n, 2 * n - 1):
        (low, a), (high, b) = heappop(heap), heappop(heap)
        weight[made] = low + high
        up[[a, b]], side[a], side[b], odds[made - n] = made, -1, 1, np.log(high / low)
        heappush(heap, (weight[made], made))
    at, tokens, found = np.arange(n), np.arange(n), []
    while len(tokens):  # a step up for all tokens at once
        above = up[at]
        on = above >= 0
        found.append((tokens[on], above[on] - n, side[at[on]]))
        at, tokens = above[on], tokens[on]
    token, node, turn = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(token, kind="stable")
    return Tree(np.concatenate([[0], np.cumsum(np.bincount(token, minlength=n))]), node[order].astype(np.int32), turn[order]), odds


@dataclass
class Network:
    tree: Tree
    embed: np.ndarray  # (2 * WINDOW, tokens + 1, WIDTH); the last row stands beyond both ends of a document
    hidden: np.ndarray  # (WIDTH,) bias
    output: np.ndarray  # (nodes, WIDTH + 1); the last column is the bias

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.hidden, self.output]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def filled(self, flat: np.ndarray) -> "Network":
        out, at = [], 0
        for x in self.arrays():
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Network(self.tree, *out)


def start(counts: np.ndarray, seed: int = 0) -> Network:
    """Random embeddings, and output weights that give each token its share of the corpus."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    tree, odds = huffman(counts)
    return Network(tree, draw(2 * WINDOW, len(counts) + 1, WIDTH), np.zeros(WIDTH, np.float32), np.concatenate([np.zeros((len(odds), WIDTH), np.float32), odds[:, None]], axis=1))


def contexts(tokens: np.ndarray, count: np.ndarray, edge: int) -> np.ndarray:
    """(tokens, 2 * WINDOW) neighbours of each place within its own text; ``edge`` where the text has none."""
    of = np.repeat(np.arange(len(count)), count)
    out = np.full((len(tokens), 2 * WINDOW), edge, np.int32)
    for k, d in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
        out[a, k] = np.where(of[a] == of[b], tokens[b], edge)
    return out


def _read(net: Network, around: np.ndarray) -> np.ndarray:
    x = net.embed[0][around[:, 0]]
    for k in range(1, 2 * WINDOW):
        x += net.embed[k][around[:, k]]
    return np.tanh(x + net.hidden)


def log_probabilities(net: Network, around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token given its neighbours."""
    x = _read(net, around)
    place, node, turn, first = net.tree.paths(tokens)
    out = net.output[node]
    z = np.einsum("ij,ij->i", x[place], out[:, :WIDTH])
    z += out[:, WIDTH]
    z *= -turn
    return -np.add.reduceat(np.logaddexp(0, z), first) if len(first) else z


def _add_at(rows: np.ndarray, seen: np.ndarray, at: np.ndarray, values: np.ndarray, rate: float) -> None:
    """rows[at] += rate * values, summed where ``at`` repeats, and over the root of the squares that a row has ``seen``."""
    order = np.argsort(at.astype(np.uint16) if len(rows) <= 1 << 16 else at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    total, at = np.add.reduceat(values[order], first), at[first]
    seen[at] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    rows[at] += rate * total / np.sqrt(seen[at] + 1e-8)[:, None]


def train_step(net: Network, around: np.ndarray, tokens: np.ndarray, rate: float, seen: list[np.ndarray] | None = None) -> None:
    """One gradient step, in place, on the sum of log probabilities; steps of a row shrink by the root of its squares (AdaGrad).

    ``seen`` has those sums of squares from step to step; without it, each step stands alone.
    """
    seen = fresh(net) if seen is None else seen
    x = _read(net, around)
    place, node, turn, first = net.tree.paths(tokens)
    there, out = x[place], net.output[node]
    z = np.einsum("ij,ij->i", there, out[:, :WIDTH])
    z += out[:, WIDTH]
    pull = turn / (1 + np.exp(turn * z))
    dx = np.add.reduceat(out[:, :WIDTH] * pull[:, None], first) * (1 - x * x)
    step = np.empty((len(node), WIDTH + 1), np.float32)
    np.multiply(there, pull[:, None], out=step[:, :WIDTH])
    step[:, WIDTH] = pull
    _add_at(net.output, seen[-1], node, step, rate)
    total = dx.sum(0)
    seen[0] += total @ total / WIDTH
    net.hidden += rate * total / np.sqrt(seen[0] + 1e-8)
    for k in range(2 * WINDOW):
        _add_at(net.embed[k], seen[1 + k], around[:, k], dx, rate)


def fresh(net: Network) -> list[np.ndarray]:
    """Sums of squares of gradients before the first step: of the hidden bias, each embedding and each node."""
    return [np.zeros(1, np.float32), *np.zeros(net.embed.shape[:2], np.float32), np.zeros(len(net.output), np.float32)]


def _train(held, rate: float):
    """Trains on every place of the rows of a partition; returns the weights in slices, each with the places that they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, net = held.value
        mine, seen = net.filled(net.flat().copy()), 0
        squares = fresh(mine)
        for batch in batches:
            for _, _, data, at in chunks(batch.column("body")):
                h, count = word_hashes(data, at)
                tokens = words_of(h)
                around = contexts(tokens, count, len(words_of.counts))
                for a in range(0, len(tokens), STEP):
                    train_step(mine, around[a : a + STEP], tokens[a : a + STEP], rate, squares)
                seen += len(tokens)
        if seen:
            slices = [x.tobytes() for x in np.array_split(mine.flat(), SLICES)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(SLICES, task)), pa.array(np.arange(SLICES)), pa.array(slices, pa.binary()), pa.array(np.full(SLICES, float(seen)))], names=["task", "at", "w", "seen"])

    return run


def _mean(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The mean of a slice's weights over some tasks, each by the places that it has seen."""
    seen = rows.column("seen").to_numpy()
    total = sum(np.frombuffer(w.as_py(), np.float32).astype(np.float64) * n for w, n in zip(rows.column("w"), seen, strict=True))
    task = rows.column("task")[0].as_py() // MEET
    return pa.table({"task": [task], "at": [key[0].as_py()], "w": pa.array([(total / seen.sum()).astype(np.float32).tobytes()], pa.binary()), "seen": [seen.sum()]})


def train(docs: DataFrame, words_of: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Weights averaged over all tasks, each by the places that it trained on; the driver gets one network a round.

    A larger network is trained in larger tasks, so that the weights that leave them stay a like share of the corpus. The
    mean is taken of MEET tasks at a time. It depends on which documents a task has, as the order of any training does.
    """
    net, shape = start(words_of.counts), "task long, at long, w binary, seen double"
    places, bodies = words_of.counts.sum() - TOKENS, as_bytes(docs)
    tasks = max(1, int(places // (PLACES * len(words_of.counts))))
    bodies = bodies.coalesce(tasks) if tasks < bodies.rdd.getNumPartitions() else bodies
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast((words_of, net))
        means, left = bodies.mapInArrow(_train(held, rate), shape), bodies.rdd.getNumPartitions()
        while left > 1:
            means, left = means.groupBy("at", F.floor(F.col("task") / MEET)).applyInArrow(_mean, shape), -(-left // MEET)
        got = means.select("at", "w").toPandas().sort_values("at")
        if len(got):
            net = net.filled(np.concatenate([np.frombuffer(w, np.float32) for w in got["w"]]))
    return net


def _network_scores(held, often):
    """A row for each chunk of texts: what the network gives them, the rarer words, and which of those each text has.

    log_likelihood has, for a rarer word, its cell's probability over the cell's count and one for a word that the
    corpus does not have; the logarithm of the word's own count is still to be added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, net = held.value
        base, made = TaskContext.get().partitionId() << 32, 0
        own = np.zeros(len(words_of.counts))
        own[words_of.first_cell :] = np.log(words_of.counts[words_of.first_cell :] - TOKENS / len(own) + 1)
        for batch in batches:
            for a, b, data, at in chunks(batch.column("body"), 2 << 20):
                h, count = word_hashes(data, at)
                tokens = words_of(h)
                around = contexts(tokens, count, len(words_of.counts))
                logs = np.concatenate([np.zeros(0)] + [log_probabilities(net, around[i : i + 8192], tokens[i : i + 8192]) for i in range(0, len(tokens), 8192)]) - own[tokens]
                ends = np.concatenate([[0], np.cumsum(count)])
                total = np.diff(np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])[ends])
                rare = np.flatnonzero(tokens >= words_of.first_cell)
                rare = rare[passes(often.value, h[rare])]  # words that may have a count of over one
                known, which = np.unique(h[rare], return_inverse=True)
                n_rare = np.diff(np.searchsorted(rare, ends))
                lists = [pa.array([x], pa.list_(t)) for x, t in ((batch.column("doc_id").slice(a, b - a), pa.int64()), (count, pa.int64()), (total, pa.float64()), (n_rare, pa.int64()), (known, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), *lists, pa.array([which.astype(np.int32).tobytes()])], names=["chunk", "ids", "counts", "logs", "n_rare", "words", "which"])
                made += 1

    return run


def _with_own_counts(key, texts: pa.Table, seen: pa.Table) -> pa.Table:
    """The rows of a chunk of texts, their rarer words' logarithms of counts added."""
    row = texts.slice(0, 1).combine_chunks()
    ids, counts, logs, n_rare, words = (row.column(c).chunk(0).flatten() for c in ("ids", "counts", "logs", "n_rare", "words"))
    own = np.zeros(len(words))
    own[seen.column("i").to_numpy()] = np.log(seen.column("n").to_numpy())
    more = own[np.frombuffer(row.column("which")[0].as_py(), np.int32)]
    ends = np.concatenate([[0], np.cumsum(n_rare.to_numpy())])
    total = logs.to_numpy() + np.diff(np.concatenate([[0.0], np.cumsum(more)])[ends])
    count = counts.to_numpy()
    return pa.table({"doc_id": ids, "n_tokens": count, "log_likelihood": total, "per_token": total / np.maximum(count, 1)})


def score(docs: DataFrame, words_of: Vocabulary, net: Network) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) for each row: the sum of every word's conditional log probability.

    per_token is the mean, 0 for a text without words, as null and empty ones are. Rows that repeat are each scored;
    other columns are not looked at. Counts of rarer words are joined in; each chunk of texts asks once for a word.
    """
    sc = docs.sparkSession.sparkContext
    held, repeated = sc.broadcast((words_of, net)), words_of.words.filter("n > 1")
    often = sc.broadcast(hash_filter(repeated, "h"))
    texts = cut(as_bytes(docs).mapInArrow(_network_scores(held, often), "chunk long, ids array<long>, counts array<long>, logs array<double>, n_rare array<long>, words array<long>, which binary"))
    asked = texts.select("chunk", F.posexplode("words").alias("i", "h"))
    # a count of one adds nothing, nor does a word that the corpus does not have
    seen = asked.join(repeated, "h").select(F.col("chunk").alias("of"), "i", "n")
    return texts.groupBy("chunk").cogroup(seen.groupBy("of")).applyInArrow(_with_own_counts, "doc_id long, n_tokens long, log_likelihood double, per_token double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words_of = vocabulary(docs)
    return score(docs, words_of, train(docs, words_of))
