"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts each token from SIDE tokens on either side of it: the hidden layer is the tanh of
the neighbours' embeddings, each scaled by its place, the output a softmax in two steps, over groups of tokens and over
the tokens of a group. The most frequent words are tokens of their own, the others share classes by their hashes: a
word's probability is that of its class times its share of the class, by the counts of all words.

The network is trained in numpy on the executors, over all documents: in each round, every task starts from the same
parameters, masks some positions of its own documents, predicts them and descends; the tasks' parameters are averaged in
a tree, each by the tokens it saw. It starts from the counts of all tokens.

The network is the prior of a memory: what stands between two words elsewhere in the corpus, not in the document
itself, is counted exactly, and a token's probability is (n + KAPPA p) / (N + KAPPA), p the network's, n of N the
token's count there. The counts of contexts stay on the executors and grow with the corpus. Contexts that a share of all
positions have are counted before, and their positions spread over tasks to which the counts go along: at most one for
each token. So all contexts count alike.

A document's score is the sum of the log probabilities of its words, each given its real neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, cut, give_back, lowered, mix, pick, word_hashes

#: Tokens by groups: 0 is the edge of a document, then the most frequent words, then classes of other words.
GROUPS, SIZE = 64, 64
TOKENS = GROUPS * SIZE
WORDS = 3071
#: Neighbours on either side, and the width of embeddings and hidden layer.
SIDE, DIM = 2, 16
#: Passes over the corpus, the share of positions that each masks and trains on (one of so many), and how fast.
ROUNDS, MASK, RATE = 1, 8, 0.2
#: Positions of one step of training, and of one block of scoring.
STEP, BLOCK = 2048, 1 << 15
#: How much the network's probability weighs against what was counted in a context.
KAPPA = 1.0
#: Contexts of more positions than this, and than this share of all positions, are counted before; which ones is estimated
#: from one document of so many, and decides only about the way.
HOT_LEAST, HOT_SHARE, HOT_SAMPLE = 1 << 18, 1 / (1 << 20), 64
#: Contexts, or rare words, that a task reads at once, about.
RANGE = 1 << 19
#: The network's log probabilities are rounded to so many steps a nat, 255 steps at most: a byte goes along with a context.
FINE = 12
#: Characters that a task turns into tokens at once.
AT_ONCE = 1 << 21
#: Bytes of text whose words and contexts are sent together.
RUN = 1 << 22
#: Tasks whose parameters are added up by one task.
FAN = 64
NAMES = ["kind", "range", "row", "entries", "doc_id", "n_tokens", "value"]


def _batches(parts):
    """(word hashes, word counts) of bounded runs of texts."""
    for part in parts:
        text = part.column("text")
        for a, b in batches(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), AT_ONCE):
            yield word_hashes([lowered(t) for t in text.slice(a, b - a).to_pylist()])
    give_back()


#: What is sent in packed columns, (bytes, type) each: contexts with token, row in the run and log probability; the same for
#: one hot context; how often tokens stand in it; rare words with their rows; words with their counts.
CONTEXT_FIELDS = ((7, U64), (2, np.uint16), (4, np.uint32), (1, np.uint8))
HOT_FIELDS = CONTEXT_FIELDS[1:]
THERE_FIELDS = ((2, np.uint16), (8, np.int64))
WORD_FIELDS = ((8, U64), (4, np.uint32))
COUNT_FIELDS = ((8, U64), (4, np.uint32))


def packed(columns: list[np.ndarray], fields, ranges: int) -> list[tuple[int, bytes]]:
    """(range, entries) for columns of which the first, the key, is sorted: entries by columns and by the significance of
    bytes, so that what neighbours share compresses."""
    top = columns[0] >> U64(8 * fields[0][0] - 32)
    return joined(top * U64(ranges) >> U64(32), columns, fields)


def joined(of: np.ndarray, columns: list[np.ndarray], fields) -> list[tuple[int, bytes]]:
    """(range, entries) for columns of which of, sorted, says the ranges."""
    if not len(of):
        return []
    bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    own = [c.astype(kind, copy=False).view(np.uint8).reshape(len(c), -1)[:, :width] for c, (width, kind) in zip(columns, fields)]
    return [(int(of[a]), b"".join(c[a:b].T.tobytes() for c in own)) for a, b in zip(bounds, bounds[1:])]


def unpacked(b: bytes, fields) -> list[np.ndarray]:
    raw = np.frombuffer(b, dtype=np.uint8).reshape(sum(w for w, _ in fields), -1)
    out, at = [], 0
    for width, kind in fields:
        x = np.zeros((raw.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
        x[:, :width] = raw[at : at + width].T
        out.append(x.reshape(-1).view(kind))
        at += width
    return out


def frequent(d: DataFrame, words: int = WORDS) -> DataFrame:
    """kind, id, n: the most frequent words of each range of hashes (kind 0), among them those of all, and how many words the
    classes would have if all words were in classes (kind 1)."""
    ranges, classes = 4 * d.rdd.getNumPartitions(), TOKENS - words - 1

    def run(parts):
        for h, _ in _batches(parts):
            word, n = np.unique(h, return_counts=True)
            rows = packed([word, n], COUNT_FIELDS, ranges)
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["r", "b"])

    def most(held):
        word, n = (np.concatenate(x) for x in zip(*held))
        word, at = np.unique(word, return_inverse=True)
        n = np.bincount(at, n).astype(np.int64)
        total = np.bincount((word % U64(classes)).astype(np.int64), n, minlength=classes).astype(np.int64)
        some, signed = np.flatnonzero(total), word.view(np.int64)
        top = np.lexsort((signed, -n))[:words]
        kind = np.repeat(np.array([0, 1], dtype=np.int32), (len(top), len(some)))
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([signed[top], some])), pa.array(np.concatenate([n[top], total[some]]))], ["kind", "id", "n"])

    def add(parts):
        at, held = None, []
        for part in parts:
            for r, b in zip(part.column("r").to_pylist(), part.column("b")):
                if r != at and held:
                    yield most(held)
                    held = []
                at = r
                held.append(unpacked(b.as_py(), COUNT_FIELDS))
        if held:
            yield most(held)

    return d.select("text").mapInArrow(run, "r long, b binary").repartition("r").sortWithinPartitions("r").mapInArrow(add, "kind int, id long, n long")


@dataclass
class Vocabulary:
    """The hashes of the most frequent words, sorted, and the token of each: tokens follow the frequency, so that groups do."""

    words: np.ndarray
    token: np.ndarray
    last: int  # the last token that is a word; those above are classes

    counts: np.ndarray  # how often each token occurs

    @classmethod
    def of(cls, d: DataFrame, words: int = WORDS) -> "Vocabulary":
        """From all texts; ties among the most frequent words go by hash."""
        rows = cut(frequent(d, words))
        top = rows.where("kind = 0").orderBy(F.desc("n"), "id").limit(words).collect()
        h, n = (np.array([r[c] for r in top], dtype=np.int64) for c in ("id", "n"))
        counts = np.zeros(TOKENS, dtype=np.int64)
        for r in rows.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).collect():
            counts[1 + words + r["id"]] = r["n"]
        np.subtract.at(counts, 1 + words + (h.view(U64) % U64(TOKENS - words - 1)).astype(np.int64), n)
        counts[1 : 1 + len(h)] = n
        order = np.argsort(h)
        return cls(h[order], (1 + order).astype(np.int64), words, counts)

    def tokens(self, h: np.ndarray) -> np.ndarray:
        w = h.view(np.int64)
        out = (1 + self.last + (h % U64(TOKENS - self.last - 1)).astype(np.int64)).astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            out = np.where(self.words[at] == w, self.token[at], out)
        return out


def framed(h: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, and words, of all documents with SIDE edges before each and after the last; the places of the words among them."""
    place = np.arange(len(h)) + SIDE * (np.repeat(np.arange(len(counts)), counts) + 1)
    x = np.zeros(len(h) + SIDE * (len(counts) + 1), dtype=np.int64)
    y = np.zeros(len(x), dtype=U64)
    x[place], y[place] = vocab.tokens(h), h
    return x, y, place


def window(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The neighbours of each place, left to right."""
    return x[place[:, None] + np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])]


class Network:
    """embed (TOKENS, DIM), scale (2 SIDE, DIM), bias (DIM), group (GROUPS, DIM), group_bias, out (TOKENS, DIM), out_bias."""

    SHAPES = ((TOKENS, DIM), (2 * SIDE, DIM), (DIM,), (GROUPS, DIM), (GROUPS,), (TOKENS, DIM), (TOKENS,))

    def __init__(self, parts: list[np.ndarray]):
        self.embed, self.scale, self.bias, self.group, self.group_bias, self.out, self.out_bias = self.parts = parts

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 5) -> "Network":
        """Knows how frequent tokens are, and nothing else: the edge is as good as impossible."""
        rng = np.random.default_rng(seed)
        share = np.log((counts + 0.5) / (counts.sum() + 0.5 * TOKENS))
        share[0] = -30
        g = share.reshape(GROUPS, SIZE)
        of_group = np.log(np.exp(g).sum(axis=1))
        parts = [rng.normal(0, 0.3, s) if i == 0 else np.ones(s) if i == 1 else np.zeros(s) for i, s in enumerate(cls.SHAPES)]
        parts[3], parts[4], parts[5], parts[6] = rng.normal(0, 0.05, cls.SHAPES[3]), of_group, rng.normal(0, 0.05, cls.SHAPES[5]), (g - of_group[:, None]).reshape(-1)
        return cls([p.astype(np.float32) for p in parts])

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Network":
        ends = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])
        return cls([p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, ends[:-1]), cls.SHAPES)])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.embed[near[:, i]] * self.scale[i] for i in range(2 * SIDE)) + self.bias)

    def log_probabilities(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target between its neighbours."""
        out = np.zeros(len(target), dtype=np.float32)
        for a in range(0, len(target), BLOCK):
            t = target[a : a + BLOCK]
            h = self.hidden(near[a : a + BLOCK])
            z = h @ self.group.T + self.group_bias
            lp = _log_of(z, t // SIZE)
            for g, rows in _by_group(t):
                own = slice(g * SIZE, (g + 1) * SIZE)
                lp[rows] += _log_of(h[rows] @ self.out[own].T + self.out_bias[own], t[rows] - g * SIZE)
            out[a : a + BLOCK] = lp
        return out

    def gradient(self, near: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The log likelihood of the targets, and its derivatives."""
        h = self.hidden(near)
        grads = [np.zeros(s, dtype=np.float32) for s in self.SHAPES]
        z = h @ self.group.T + self.group_bias
        lp, d = _log_of(z, target // SIZE, True)
        grads[3], grads[4], back = d.T @ h, d.sum(axis=0), d @ self.group
        for g, rows in _by_group(target):
            own = slice(g * SIZE, (g + 1) * SIZE)
            more, d = _log_of(h[rows] @ self.out[own].T + self.out_bias[own], target[rows] - g * SIZE, True)
            lp[rows] += more
            grads[5][own], grads[6][own] = d.T @ h[rows], d.sum(axis=0)
            back[rows] += d @ self.out[own]
        back *= 1 - h * h
        grads[2] = back.sum(axis=0)
        for i in range(2 * SIDE):
            grads[1][i] = (back * self.embed[near[:, i]]).sum(axis=0)
        order = np.argsort(near.T.reshape(-1), kind="stable")
        tokens = near.T.reshape(-1)[order]
        begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        each = (back[None, :, :] * self.scale[:, None, :]).reshape(-1, DIM)[order]
        grads[0][tokens[begin]] = np.add.reduceat(each, begin, axis=0)
        return float(lp.sum()), grads


def _log_of(z: np.ndarray, at: np.ndarray, derivative: bool = False):
    """The log softmax of each row at one column; with its derivative by z, if asked for."""
    rows = np.arange(len(z))
    np.minimum(z, 80, out=z)  # what exp can take; the hidden layer is bounded, so logits are far below
    chosen = z[rows, at]
    e = np.exp(z, out=z)
    total = e @ np.ones(e.shape[1], dtype=e.dtype)
    lp = chosen - np.log(total)
    if not derivative:
        return lp
    d = e / -total[:, None]
    d[rows, at] += 1
    return lp, d


def _by_group(target: np.ndarray):
    """(group, rows) of the groups that targets are in."""
    g = target // SIZE
    order = np.argsort(g, kind="stable")
    bounds = np.searchsorted(g[order], np.arange(GROUPS + 1))
    return [(i, order[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]


def masked(y: np.ndarray, place: np.ndarray, round_: int, mask: int) -> np.ndarray:
    """The places of the words that a round masks: by the words around them, so that any split of the corpus masks alike."""
    with np.errstate(over="ignore"):
        k = mix(y[place - 1] * U64(0x9E3779B97F4A7C15) + y[place] * U64(0xC2B2AE3D27D4EB4F) + y[place + 1] * U64(0x165667B19E3779F9) + U64(round_))
    return place[k % U64(mask) == 0]


def train(d: DataFrame, vocab: Vocabulary, *, rounds: int = ROUNDS, mask: int = MASK, rate: float = RATE) -> Network:
    """The network after rounds of descent over all documents; parameters are averaged on the executors, FAN by FAN."""
    net = Network.start(vocab.counts)
    for round_ in range(rounds):
        first = net.flat()

        def run(parts, first=first, round_=round_):
            own = Network.of(first)
            square = [np.full(p.shape, 1e-3, dtype=np.float32) for p in own.parts]
            seen, near, target = 0, [], []

            def descend(n, t):
                _, grads = own.gradient(n, t)
                for p, g, s in zip(own.parts, grads, square):
                    g /= len(t)
                    s += g * g
                    p += rate * g / np.sqrt(s)

            for h, c in _batches(parts):
                x, y, place = framed(h, c, vocab)
                at = masked(y, place, round_, mask)
                near.append(window(x, at))
                target.append(x[at])
                if sum(map(len, target)) >= STEP:
                    n, t = np.concatenate(near), np.concatenate(target)
                    full = len(t) // STEP * STEP
                    for a in range(0, full, STEP):
                        descend(n[a : a + STEP], t[a : a + STEP])
                    seen, near, target = seen + full, [n[full:]], [t[full:]]
            t = np.concatenate(target) if target else np.zeros(0, dtype=np.int64)
            if len(t):
                descend(np.concatenate(near), t)
                seen += len(t)
            if seen:
                delta = ((own.flat() - first) * 64).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([delta.tobytes()])], ["seen", "delta"])

        rows = d.select("text").mapInArrow(run, "seen double, delta binary")
        rows, left = cut(rows.withColumn("id", F.monotonically_increasing_id())), None
        while (left := rows.count()) > FAN:
            rows = cut(rows.repartition(-(-left // FAN), "id").mapInPandas(_added, "seen double, delta binary").withColumn("id", F.monotonically_increasing_id()))
        got = rows.select("seen", "delta").collect()
        if not got:
            return net
        seen = sum(r["seen"] for r in got)
        net = Network.of(first + sum(np.frombuffer(r["delta"], dtype=np.float16).astype(np.float64) * (r["seen"] / seen) for r in sorted(got, key=lambda r: (r["seen"], r["delta"]))) / 64)
    return net


def _added(parts):
    """One row for all: the average of deltas, by what each has seen."""
    total, seen = None, 0.0
    for pdf in parts:
        for s, delta in zip(pdf["seen"], pdf["delta"]):
            x = np.frombuffer(delta, dtype=np.float16).astype(np.float64) * s
            total, seen = x if total is None else total + x, seen + s
    if seen:
        yield pd.DataFrame({"seen": [seen], "delta": [(total / seen).astype(np.float16).tobytes()]})


def _runs(parts):
    """(rows, word hashes, word counts) of bounded runs of texts of Arrow batches."""
    for part in parts:
        sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False)
        for a, b in batches(sizes, RUN):
            run = part.slice(a, b - a)
            yield run, *word_hashes([lowered(t) for t in run.column("text").to_pylist()])
    give_back()


def contexts(y: np.ndarray, place: np.ndarray) -> np.ndarray:
    """56 bits of the two words around each place."""
    with np.errstate(over="ignore"):
        return mix(y[place - 1] * U64(0x9E3779B97F4A7C15) + mix(y[place + 1] + U64(1))) >> U64(8)


def hot_contexts(d: DataFrame, positions: int) -> np.ndarray:
    """The contexts of too many positions for one task, sorted: fewer than 1 / HOT_SHARE, about."""
    empty = Vocabulary(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, np.zeros(0, np.int64))

    def run(parts):
        for h, c in _batches(parts):
            _, y, place = framed(h, c, empty)
            k, n = np.unique(contexts(y, place).view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n, pa.int64())], ["k", "n"])

    drawn = d.where(F.pmod(F.xxhash64("doc", F.lit(21)), F.lit(HOT_SAMPLE)) == 0).select("text")
    often = drawn.mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") * HOT_SAMPLE > max(HOT_LEAST, positions * HOT_SHARE))
    return np.sort(np.array([r["k"] for r in often.select("k").collect()], dtype=np.int64)).view(U64)


def among(key: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which contexts are hot, and the place of each of these among the hot ones."""
    if not len(hot):
        return np.zeros(len(key), dtype=bool), np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
    some = hot[at] == key
    return some, at[some]


def hot_counts(d: DataFrame, vocab: Vocabulary, hot: np.ndarray) -> DataFrame:
    """at, token, n: how often each token stands in each hot context."""

    def run(parts):
        for h, c in _batches(parts):
            x, y, place = framed(h, c, vocab)
            some, at = among(contexts(y, place), hot)
            pair, n = np.unique(at * TOKENS + x[place][some], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair // TOKENS), pa.array(pair % TOKENS), pa.array(n, pa.int64())], ["at", "token", "n"])

    return d.select("text").mapInArrow(run, "at long, token long, n long").groupBy("at", "token").agg(F.sum("n").alias("n"))


def hot_sent(counts: DataFrame, slices: np.ndarray) -> DataFrame:
    """The counts of hot_counts, packed, for each slice of their context: rows without a row, as _sums takes them."""

    def run(parts):
        rest = [np.zeros(0, dtype=np.int64)] * 3

        def whole(at, token, n):
            rows = joined(at, [token.astype(np.uint16), n], THERE_FIELDS)
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([slices[r] for r, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["at", "slices", "entries"])

        for part in parts:
            columns = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, part.columns)]
            a = np.searchsorted(columns[0], columns[0][-1:])  # the last context may go on
            a = int(a[0]) if len(a) else 0
            yield whole(*[c[:a] for c in columns])
            rest = [c[a:] for c in columns]
        yield whole(*rest)

    rows = counts.repartition("at").sortWithinPartitions("at").mapInArrow(run, "at long, slices long, entries binary")
    each = rows.select("at", "entries", F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"))
    none = lambda c: F.lit(None).cast(c)
    return each.select(F.lit(HOT).alias("kind"), (F.col("at") * SLICES + F.col("slice")).alias("range"), none("long").alias("row"), "entries", none("long").alias("doc_id"), none("long").alias("n_tokens"), none("double").alias("value"))


def corrections(context: np.ndarray, token: np.ndarray, row: np.ndarray, lp: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """row, and by how much each of its entries becomes likelier by what stands in the same context in other rows; entries
    whose context has no other row are left out. With counts, of all tokens, the entries are whole rows' of one context, but
    not all rows'."""
    order = np.argsort(context, kind="stable")
    c = context[order]
    if counts is None and len(c):
        same = c[1:] == c[:-1]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    order = order[np.lexsort((token[order], row[order], context[order]))]
    c, t, r, p = context[order], token[order].astype(np.int64), row[order], lp[order]
    if not len(c):
        return row[:0], p.astype(np.float64)
    begins = np.concatenate([[True], c[1:] != c[:-1]])
    of_context, begins = _sizes(begins), begins | np.concatenate([[True], r[1:] != r[:-1]])
    of_row, begins = _sizes(begins), begins | np.concatenate([[True], t[1:] != t[:-1]])
    alone = _sizes(begins)
    if counts is None:
        again = np.lexsort((t, c))
        of_token = np.empty(len(c), dtype=np.int64)
        of_token[again] = _sizes(np.concatenate([[True], (c[again[1:]] != c[again[:-1]]) | (t[again[1:]] != t[again[:-1]])]))
    else:
        of_context, of_token = np.full(len(c), counts.sum()), counts[t]
    elsewhere, there = of_context - of_row, of_token - alone
    some = elsewhere > 0
    q = p[some].astype(np.float64) / -FINE
    return r[some], np.log((there[some] + KAPPA * np.exp(q)) / (elsewhere[some] + KAPPA)) - q


def _sizes(begins: np.ndarray) -> np.ndarray:
    """For each entry, how many are in its run; begins says where runs begin."""
    at = np.flatnonzero(begins)
    n = np.diff(np.append(at, len(begins)))
    return np.repeat(n, n)


DOC, WORD, CONTEXT, HOT = 0, 1, 2, 3
#: The fields of each kind, and which of them is the row.
FIELDS = {WORD: (WORD_FIELDS, 1), CONTEXT: (CONTEXT_FIELDS, 2), HOT: (HOT_FIELDS, 1)}
#: Ranges of a hot context begin at its place among them times this.
SLICES = 1 << 40


def _shares(word: np.ndarray, row: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """row, and the log of the word's part of its class, of all occurrences of some rare words."""
    _, at, n = np.unique(word, return_inverse=True, return_counts=True)
    return row, np.log(n[at] / vocab.counts[vocab.tokens(word)])


def _sums(vocab: Vocabulary):
    """Rows sorted by kind and range, to row, doc_id, n_tokens, value: documents as they are, the words and contexts of a range together,
    with the counts of a hot context."""

    def close(kind, held, there):
        columns = [np.concatenate(x) for x in zip(*held)]
        if kind == WORD:
            return _by_row(*_shares(*columns, vocab))
        if kind == CONTEXT:
            return _by_row(*corrections(*columns))
        counts = np.zeros(TOKENS, dtype=np.int64)
        counts[there[0]] = there[1]
        return _by_row(*corrections(np.zeros(len(columns[0]), dtype=U64), *columns, counts))

    def run(parts):
        at, held, there = None, [], None
        for part in parts:
            kinds = part.column("kind").to_numpy(zero_copy_only=False)
            own = part.filter(pa.array(kinds == DOC))
            if own.num_rows:
                yield own.select(["row", "doc_id", "n_tokens", "value"])
            rest = part.filter(pa.array(kinds != DOC))
            for kind, r, first, b in zip(*[rest.column(c).to_pylist() for c in ("kind", "range", "row")], rest.column("entries")):
                if (kind, r) != at:
                    if held:
                        yield close(at[0], held, there)
                    at, held, there = (kind, r), [], None
                if first is None:
                    there = unpacked(b.as_py(), THERE_FIELDS)
                    continue
                fields, i = FIELDS[kind]
                columns = unpacked(b.as_py(), fields)
                columns[i] = columns[i].astype(np.int64) + first
                held.append(columns)
        if held:
            yield close(at[0], held, there)

    return run


def _by_row(row: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    row, at = np.unique(row, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64()), pa.array(np.bincount(at, value, minlength=len(row)), pa.float64())], ["row", "doc_id", "n_tokens", "value"])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every whole text, by a model of all of them.

    Words are runs of other than ASCII white space, A-Z in lower case. Null, empty and blank texts have no tokens, sum 0
    and a null mean. Repeated rows count as often as they are there, score alike, and make each other likelier: the memory
    leaves out a row's own words only. A null id stays null; an empty table gives an empty one; other columns are left
    behind; very long texts are scored whole, in one run each. Ties among the most frequent words go by hash.
    """
    d = pick(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    vocab = Vocabulary.of(d, WORDS)
    net = train(d, vocab, rounds=rounds)
    positions = int(vocab.counts.sum())
    hot, slices, counts = hot_contexts(d, positions), np.zeros(0, np.int64), None
    if len(hot):
        counts, slices = cut(hot_counts(d, vocab, hot)), np.ones(len(hot), dtype=np.int64)
        for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():
            slices[r["at"]] = -(-r["n"] // RANGE)
    ranges = max(1, -(-positions // RANGE))

    def run(parts):
        for rows, h, counts in _runs(parts):
            x, y, place = framed(h, counts, vocab)
            t = x[place]
            fine = np.clip(np.rint(net.log_probabilities(window(x, place), t) * -FINE), 0, 255).astype(np.uint8)
            ends, row = np.cumsum(counts), rows.column("row").to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0.0], np.cumsum(fine / -FINE)])
            n, none, kind = len(row), lambda of, k: pa.nulls(k, of), lambda of, k: pa.array(np.full(k, of), pa.int32())
            # A document's row goes with a random number, so that no task gets them all.
            yield pa.RecordBatch.from_arrays([kind(DOC, n), pa.array((mix(row) >> U64(40)).view(np.int64)), rows.column("row"), none(pa.binary(), n), rows.column("doc"), pa.array(counts, pa.int64()), pa.array(sums[ends] - sums[ends - counts])], NAMES)
            owner = np.repeat(np.arange(n, dtype=np.uint32), counts)
            rare = np.flatnonzero(t > vocab.last)
            rare = rare[np.argsort(h[rare])]
            key = contexts(y, place)
            some, at = among(key, hot)
            keep, spread = np.flatnonzero(~some), np.flatnonzero(some)
            keep = keep[np.argsort(key[keep])]
            # A run's entries of a hot context go to one slice, so that a row's stay together.
            to = at * SLICES + (mix(row[:1]) % slices[at].view(U64)).view(np.int64)
            order = np.lexsort((t[spread], to))
            to, spread = to[order], spread[order]
            blobs = [(WORD, *b) for b in packed([h[rare], owner[rare]], WORD_FIELDS, ranges)] + [(CONTEXT, *b) for b in packed([key[keep], t[keep], owner[keep], fine[keep]], CONTEXT_FIELDS, ranges)]
            blobs += [(HOT, *b) for b in joined(to, [t[spread], owner[spread], fine[spread]], HOT_FIELDS)]
            for a in range(0, len(blobs), 256):
                k = len(some := blobs[a : a + 256])
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in some], pa.int32()), pa.array([b[1] for b in some], pa.int64()), pa.array(np.full(k, row[0])), pa.array([b[2] for b in some], pa.binary()), none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k)], NAMES)

    sent = d.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "kind int, range long, row long, entries binary, doc_id long, n_tokens long, value double")
    sent = sent.unionByName(hot_sent(counts, slices)) if counts is not None else sent
    parts = sent.repartition("kind", "range").sortWithinPartitions("kind", "range").mapInArrow(_sums(vocab), "row long, doc_id long, n_tokens long, value double")
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("value").alias("log_likelihood")).drop("row")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
