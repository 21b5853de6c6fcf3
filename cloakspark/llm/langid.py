"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's subwords are the byte 2-, 3- and 4-grams of its words, word ends included, letters only and A-Z in lower
case. Each is hashed to a bucket with an embedding; their average goes through a linear layer to a softmax. Both are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. The temperature is calibrated on
a part of the sample that isn't trained on, and so are the two thresholds of rejection, by the length of a text: one for the
probability of the best language, one for how usual the text's subwords are in all learned languages together, which
tells texts in other languages and junk from what was learned. As all is linear before the softmax, embedding
and layer are multiplied once after training, and a prediction is an average of the products' rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, give_back, mix, pick, text_batches

ORDERS = (2, 3, 4)
BITS = 13
BUCKETS = 1 << BITS
DIM = 16
#: The bounds of what training reads: rows in all and of each language (about, by a hash of the id), and of a longer text so
#: many characters, from a place that depends on the id.
SAMPLE_ROWS, ROWS_PER_LANGUAGE, EXCERPT = 8192, 500, 8192
UNDETERMINED = "und"
#: A text is rejected if its best language has less than DOUBT times the least probability, or its subwords are more than
#: UNUSUAL standard deviations less likely than the mean, of clean validation windows of its length (in powers of two).
DOUBT, UNUSUAL = 0.35, 12.0
LENGTHS = 24
#: Bytes that a task turns into subwords at once.
AT_ONCE = 1 << 19

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_LETTER = mix(np.arange(256)).astype(np.uint32) | np.uint32(1)
_ANY_LETTER = regex.compile(r"\p{L}")


def subwords(docs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the bucket of the subword at each byte (BUCKETS where none begins); where each document begins."""
    x = _FOLD[np.frombuffer(b"    ".join([b"", *docs, b""]), dtype=np.uint8)]
    starts = np.concatenate([[4], 4 + np.cumsum([len(d) + 4 for d in docs])[:-1]]).astype(np.int64) - 1
    gap = x == 32
    v = _LETTER[x]
    h, out = v, []
    with np.errstate(over="ignore"):
        for n in range(2, max(ORDERS) + 1):
            h = h[: len(v) - n + 1] * np.uint32(0x9E3779B1) + v[n - 1 :]
            none = gap[:-1] & gap[1:] if n == 2 else gap[1 : len(h) + 1].copy()
            for i in range(2, n - 1):
                none |= gap[i : len(h) + i]
            if n in ORDERS:
                ids = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int32)
                ids[none] = BUCKETS
                out.append(ids)
    return out, starts


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]  # for each order, BUCKETS + 1 rows of a logit for each language, the last one zero
    bias: np.ndarray
    temperature: float
    usual: tuple[np.ndarray, ...]  # for each order, the log probability of each bucket over all languages, the last one zero
    doubtful: np.ndarray  # by length, the least probability of the best language
    unusual: np.ndarray  # by length, the least mean of usual

    def sums(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, mean of usual, and number of subwords."""
        ids, starts = subwords(docs)
        total, count = np.zeros((len(docs), len(self.languages) + 1), dtype=np.float64), np.zeros(len(docs))
        for t, u, i in zip(self.tables, self.usual, ids):
            at = np.minimum(starts, len(i) - 1)
            for c in range(len(self.languages)):
                total[:, c] += np.add.reduceat(t[:, c][i], at, dtype=np.float64)
            total[:, -1] += np.add.reduceat(u[i], at, dtype=np.float64)
            count += np.add.reduceat((i != BUCKETS).astype(np.int32), at)
        total /= np.maximum(count, 1)[:, None]
        return total[:, :-1] + self.bias, total[:, -1], count

    def logits(self, docs: list[bytes]) -> np.ndarray:
        return self.sums(docs)[0]

    def probabilities(self, docs: list[bytes]) -> np.ndarray:
        return _softmax(self.logits(docs) / self.temperature)

    def judged(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its probability, and whether it is accepted."""
        z, usual, count = self.sums(docs)
        p = _softmax(z / self.temperature)
        length = _length(count)
        return p.argmax(axis=1), p.max(axis=1), (p.max(axis=1) >= self.doubtful[length]) & (usual >= self.unusual[length])


def _length(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), LENGTHS - 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], *, steps: int = 700, batch: int = 32, rate: float = 1.0, seed: int = 7) -> Model | None:
    """The model for these labelled texts (None without any): SGD over random runs of words, a fifth kept for calibration."""
    texts, labels = zip(*[(t, y) for t, y in zip(texts, labels) if t and _ANY_LETTER.search(t)]) if any(t and _ANY_LETTER.search(t) for t in texts) else ((), ())
    languages = tuple(sorted(set(labels)))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    words = [t.encode().split() for t in texts]
    by = [[i for i, y in enumerate(labels) if y == lang] for lang in languages]
    fit = [own[len(own) // 5 :] for own in by]
    n = len(languages)
    e = rng.normal(0, 0.1, (len(ORDERS), BUCKETS + 1, DIM)).astype(np.float32)
    e[:, BUCKETS] = 0
    w, b = np.zeros((DIM, n), dtype=np.float32), np.zeros(n, dtype=np.float32)

    def window(i: int, shortest: int = 1) -> bytes:
        size = int(np.exp(rng.uniform(np.log(shortest), np.log(200))))
        at = int(rng.integers(0, max(1, len(words[i]) - size + 1)))
        return b" ".join(words[i][at : at + size])

    for step in range(steps if n > 1 else 0):
        y = np.concatenate([rng.permutation(n) for _ in range(-(-batch // n))])[:batch]
        ids, starts = subwords([window(fit[c][int(rng.integers(len(fit[c])))]) for c in y])
        count = np.maximum(sum(np.add.reduceat((i != BUCKETS).astype(np.float32), np.minimum(starts, len(i) - 1)) for i in ids), 1)
        hidden = sum(np.add.reduceat(e[o][i], np.minimum(starts, len(i) - 1), axis=0) for o, i in enumerate(ids)) / count[:, None]
        g = _softmax(hidden @ w + b).astype(np.float32)
        g[np.arange(batch), y] -= 1
        lr = rate * (1 - step / steps)
        back = (g @ w.T) * (lr / count)[:, None]
        w -= lr * hidden.T @ g / batch
        b -= lr * g.mean(axis=0)
        for o, i in enumerate(ids):
            real = np.flatnonzero(i != BUCKETS)
            owner = np.searchsorted(starts, real, side="right") - 1
            np.subtract.at(e[o], i[real], back[np.maximum(owner, 0)])
    tables = tuple(np.ascontiguousarray(e[o] @ w) for o in range(len(ORDERS)))
    usual = []
    for o in range(len(ORDERS)):
        share = np.zeros(BUCKETS)
        for own in fit:
            n_of = np.bincount(np.concatenate([subwords([b" ".join(words[i])])[0][o] for i in own]), minlength=BUCKETS + 1)[:BUCKETS] + 0.5
            share += n_of / n_of.sum() / n
        usual.append(np.append(np.log(share), 0.0).astype(np.float32))
    anything = np.zeros(LENGTHS) - np.inf
    model = Model(languages, tables, b, 1.0, tuple(usual), anything, anything)
    held = [(window(i), c) for c, own in enumerate(by) for i in own[: max(1, len(own) // 5)] for _ in range(8)]
    z, y = model.logits([d for d, _ in held]), np.array([c for _, c in held])
    grid = np.exp(np.linspace(np.log(0.02), np.log(4), 60))
    losses = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    best = _softmax(z / temperature).max(axis=1)
    _, likely, count = model.sums([d for d, _ in held])
    length, doubtful, unusual = _length(count), anything.copy(), anything.copy()
    for i in range(LENGTHS):
        own = length == i
        if own.sum() >= 20:
            spread = max(float(likely[own].std()), 0.02)
            doubtful[i] = DOUBT * best[own].min()
            unusual[i] = min(likely[own].mean() - UNUSUAL * spread, likely[own].min() - 2 * spread)
        elif i:  # longer texts than there were windows of: as the longest windows
            doubtful[i], unusual[i] = doubtful[i - 1], unusual[i - 1]
    return Model(languages, tables, b, temperature, tuple(usual), doubtful, unusual)


def held_out(id_column):
    """Whether a row is one that training never reads; null ids count as such, though the result says false."""
    return F.crc32(id_column.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model learned from a bounded sample of labelled rows, chosen by a hash of the id: about rows_per_language rows of each
    language, and about sample_rows in all, however many languages there are. None if there is no labelled text."""
    d = pick(docs, doc=id_col, text=text_col, lang=lang_col).where(~held_out(F.col("doc")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = cut(d.groupBy("lang").count())
    languages = counts.count()
    if not languages:
        return None
    each = min(float(rows_per_language), sample_rows / languages)
    n = F.length("text")
    at = F.when(n > EXCERPT, F.pmod(F.xxhash64(F.col("doc"), F.lit(13)), n - EXCERPT)).otherwise(0).cast("int") + 1
    drawn = F.pmod(F.xxhash64(F.col("doc"), F.lit(11)), F.lit(1 << 30)) < F.lit(each) / F.col("count") * (1 << 30)
    near = F.broadcast(counts) if languages <= 1 << 16 else counts
    rows = d.join(near, "lang").where(drawn).select("doc", F.substring(F.col("text"), at, F.lit(EXCERPT)).alias("text"), "lang").collect()
    rows = sorted(rows, key=lambda r: (r["doc"], r["text"], r["lang"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every whole text.

    lang_pred is und, with score 0 and not accepted, for texts that are null or without a letter, and for all texts if
    there was nothing to learn from. score is the calibrated probability of lang_pred; accepted says that neither it nor
    the likelihood of the text's subwords is under the calibrated threshold for its length. Very long texts are read whole. Repeated rows give repeated results; ties go to the language first in the alphabet; an
    empty table gives an empty one; a null id stays null and isn't held out; other columns are left behind.
    """

    def run(parts):
        for doc, texts in text_batches(parts, AT_ONCE):
            pred, score, accepted = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for i, c, s, ok in _scored(model, texts):
                pred[i], score[i], accepted[i] = model.languages[c], float(min(1.0, s)), bool(ok)
            yield pa.RecordBatch.from_arrays([doc, pa.array(pred), pa.array(score), pa.array(accepted)], ["doc_id", "lang_pred", "score", "accepted"])

    d = pick(docs, doc=id_col, text=text_col)
    out = d.mapInArrow(run, f"doc_id {d.schema['doc'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


def _scored(model: Model | None, texts: list[str | None]):
    """(place, language, probability, accepted) of the texts that have a letter."""
    known = [i for i, t in enumerate(texts) if model and t and _ANY_LETTER.search(t)]
    if known:
        yield from zip(known, *model.judged([texts[i].encode() for i in known]))


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the documents whose language is rejected; all columns stay.

    Null and letterless texts are rejected, and all are if no text is labelled; null ids, repeated rows and very long texts are
    treated like others, an empty table stays one.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    if model is None:
        return docs.limit(0)

    def run(parts):
        for part in parts:
            text, keep = part.column(text_col), np.zeros(part.num_rows, dtype=bool)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for a, b in batches(sizes, AT_ONCE):
                for i, _, _, ok in _scored(model, text.slice(a, b - a).to_pylist()):
                    keep[a + i] = ok
            yield part.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, docs.schema)
