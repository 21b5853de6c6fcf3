"""Benchmark decontamination by q-gram lemma filtering.

Each benchmark item is looked for in overlapping windows. A region of a text that is within k edits of a window of m
characters shares at least m + 1 - q (k + 1) of its q-grams with it, all on diagonals at most k apart. So the shared
q-grams are counted in overlapping bands of diagonals; bands that reach the bound are verified by banded alignment.
The filter loses no region; what remains has an edit distance that was computed. Items of fewer than q characters have
no q-gram and are looked for as they are.

Documents are searched many at a time, laid end to end between gaps whose characters no alignment may take, and each
begins at a multiple of the bands' distance: what is found in a document doesn't depend on its neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, mix, pick, text_batches, without

Q = 8
#: Characters of a window; windows begin every half of it, and one ends at the item's end. Shorter items are one window.
WINDOW = 50
#: Edits for each character of a window: 3 for 50.
EDITS = 0.075
#: Diagonals between the beginnings of two bands.
STEP = 16
#: What fills the space between documents: no character, and at least so many of it that no band reaches two documents.
GAP, GAP_CHAR = 128, 0xFFFFFFFE
#: Characters of benchmark items that tasks hold at once, and bytes of texts in which several such blocks are looked for in turn.
ITEM_CHARS, HOLD = 1 << 20, 1 << 24
#: Characters of text that a task searches at once.
AT_ONCE = 1 << 18
#: Bits of the table that says which q-grams are worth a look.
TABLE_BITS = 20

_LOW = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x10000)], dtype=np.uint32)
_LOW[9:14] = 32
_CODE = mix(np.arange(0x10000)).astype(np.uint32) | np.uint32(1)


def folded(text: str | None) -> np.ndarray:
    """Code points, in lower case where that is one character of the basic plane, ASCII white space as spaces; positions stay."""
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(x < 0x10000, _LOW[np.minimum(x, 0xFFFF)], x) if len(x) and x.max() > 0xFFFF else _LOW[x]


def qgrams(x: np.ndarray) -> np.ndarray:
    """32-bit hashes of the 8 characters from each position on."""
    with np.errstate(over="ignore"):
        h = _CODE[x & np.uint32(0xFFFF)] + (x >> np.uint32(16))
        for width, k in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
            h = h[:-width] * np.uint32(k) + h[width:]
            h ^= h >> np.uint32(15)
    return h


def item_windows(n: int) -> list[tuple[int, int]]:
    """Where an item's windows begin and end."""
    if n <= WINDOW:
        return [(0, n)]
    return [(a, a + WINDOW) for a in dict.fromkeys([*range(0, n - WINDOW + 1, WINDOW // 2), n - WINDOW])]


def budget(m: int) -> int:
    """The edits that a window of m characters may differ by: below what the q-gram bound can tell, and none if very short."""
    return max(0, min(int(m * EDITS), (m - Q) // Q))


class Index:
    """The q-grams of all windows of the items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.windows: list[tuple[int, int, np.ndarray]] = []  # item, begin, characters
        for key, text in items:
            x = folded(text)
            self.windows += [(key, a, x[a:b]) for a, b in item_windows(len(x)) if b > a]
        self.short: dict[int, list[int]] = {}  # windows without a q-gram, by length
        for w, (_, _, x) in enumerate(self.windows):
            if len(x) < Q:
                self.short.setdefault(len(x), []).append(w)
        grams = [qgrams(w) if len(w) >= Q else np.zeros(0, np.uint32) for _, _, w in self.windows]
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.window = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, int)
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self.hashes >> np.uint32(32 - TABLE_BITS)] = True
        self.k = np.array([budget(len(w)) for _, _, w in self.windows], dtype=np.int64)
        self.least = np.array([max(1, len(w) + 1 - Q * (k + 1)) for (_, _, w), k in zip(self.windows, self.k)], dtype=np.int64)

    def regions(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(window, first diagonal) of all bands of x that share enough q-grams."""
        if len(x) < Q or not len(self.hashes):
            return []
        h = qgrams(x)
        at = np.flatnonzero(self.table[h >> np.uint32(32 - TABLE_BITS)])
        lo, hi = (np.searchsorted(self.hashes, h[at], side=s) for s in ("left", "right"))
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        if not len(at):
            return []
        total = np.cumsum(n)
        where = np.arange(total[-1]) - np.repeat(total - n, n) + np.repeat(lo, n)
        window, diagonal = self.window[where], np.repeat(at, n) - self.offset[where] + WINDOW
        width = len(x) // STEP + WINDOW // STEP + 3
        band = diagonal // STEP + 1
        key = window * width + band
        early = diagonal % STEP <= self.k[window]  # near a band's beginning: also in the band before
        key, count = np.unique(np.concatenate([key, key[early] - 1]), return_counts=True)
        good = count >= self.least[key // width]
        return [(int(k // width), int((k % width - 1) * STEP - WINDOW)) for k in key[good]]

    def matches(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, begin, end, edits) of the verified regions of x; of a band's alignments, the best one that ends first."""
        found = self.regions(x)
        out = self._exact(x)
        for a in range(0, len(found), 4096):
            out += self._align(x, found[a : a + 4096])
        return out

    def _exact(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """All places of the windows that are too short for a q-gram."""
        out = []
        for n, own in self.short.items():
            if len(x) < n:
                continue
            h = np.zeros(len(x) - n + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - n + 1 + i]
                keys = [int(sum(int(c) * pow(0x9E3779B97F4A7C15, n - 1 - i, 1 << 64) for i, c in enumerate(self.windows[w][2])) & (2**64 - 1)) for w in own]
            at = np.flatnonzero(np.isin(h, np.array(keys, dtype=np.uint64)))
            for w, key in zip(own, keys):
                for a in at[h[at] == np.uint64(key)].tolist():
                    if (x[a : a + n] == self.windows[w][2]).all():
                        out.append((w, a, a + n, 0))
        return out

    def _align(self, x: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Banded alignment of all found regions at once: column c of row i is the character before begin + i + c. Gaps can't be aligned with anything."""
        m = max((len(self.windows[w][2]) for w, _ in found), default=0)
        kmax = int(self.k.max(initial=0))
        wide = STEP + 3 * kmax + 2
        begin = np.array([d - kmax for _, d in found])
        size = np.array([len(self.windows[w][2]) for w, _ in found])
        pattern = np.full((len(found), m), 0xFFFFFFFF, dtype=np.uint32)
        for r, (w, _) in enumerate(found):
            pattern[r, : size[r]] = self.windows[w][2]
        padded = np.concatenate([np.full(WINDOW + kmax + 1, GAP_CHAR, np.uint32), x, np.full(m + wide + kmax + 1, GAP_CHAR, np.uint32)])
        big = 1 << 20
        col = np.arange(wide)
        d = np.zeros((len(found), wide), dtype=np.int64)
        s = begin[:, None] + col[None, :]  # where each alignment began
        final = np.full((len(found), wide), big, dtype=np.int64)
        origin = np.zeros((len(found), wide), dtype=np.int64)
        place = begin + WINDOW + kmax + 1
        for i in range(m):
            ch = padded[np.clip(place[:, None] + i + col[None, :], 0, len(padded) - 1)]
            cost = d + np.where(ch == GAP_CHAR, big, ch != pattern[:, i : i + 1])  # to the same column: one character of each
            up = np.concatenate([d[:, 1:], np.full((len(found), 1), big)], axis=1) + 1  # a pattern character left out
            from_up = up < cost
            best = np.where(from_up, up, cost)
            org = np.where(from_up, np.concatenate([s[:, 1:], s[:, -1:]], axis=1), s)
            run = best * 4096 - col * 4096 + col  # a text character left out: one column on, one edit more
            least = np.minimum.accumulate(run, axis=1)
            source = ((least % 4096) + 4096) % 4096
            d = np.take_along_axis(best, source, axis=1) + col - source
            s = np.take_along_axis(org, source, axis=1)
            done = size == i + 1
            final[done], origin[done] = d[done], s[done]
        end = begin[:, None] + size[:, None] + col[None, :]
        final[(end > len(x)) | (end < 0) | (origin < 0)] = big
        at = final.argmin(axis=1)
        row = np.arange(len(found))
        edits = final[row, at]
        return [(w, int(origin[r, at[r]]), int(end[r, at[r]]), int(edits[r])) for r, (w, _) in enumerate(found) if edits[r] <= self.k[w]]


def _found(index: Index, parts):
    """doc_id, item_id, start, end, edits, regions of Arrow batches (doc, text)."""
    for doc, own in text_batches(parts, AT_ONCE):
        texts = [folded(t) for t in own]
        gaps = [GAP + -len(t) % STEP for t in texts]
        starts = np.cumsum([0] + [len(t) + g for t, g in zip(texts, gaps[:-1])])
        best: dict[tuple[int, int], list[int]] = {}
        for w, begin, end, edits in index.matches(np.concatenate([y for t, g in zip(texts, gaps) for y in (t, np.full(g, GAP_CHAR, np.uint32))])):
            i = int(np.searchsorted(starts, begin, side="right")) - 1
            begin, end = begin - int(starts[i]), end - int(starts[i])
            have = best.setdefault((i, index.windows[w][0]), [begin, end, edits, 0])
            have[:] = [min(have[0], begin), max(have[1], end), min(have[2], edits), have[3] + 1]
        rows = [(i, item, *v) for (i, item), v in sorted(best.items())]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
        yield pa.RecordBatch.from_arrays([doc.take(columns[0]), *columns[1:]], ["doc_id", "item_id", "start", "end", "edits", "regions"])


def _search(blocks: list[Broadcast]):
    """One pass: a task holds a run of texts and looks for the items of one block after another in it."""

    def held(parts):
        run, size = [], 0
        for part in parts:
            for a, b in batches(pc.binary_length(part.column("text")).to_numpy(zero_copy_only=False), HOLD):
                run.append(part.slice(a, b - a))
                size += run[-1].nbytes
                if size >= HOLD:
                    yield run
                    run, size = [], 0
        if run:
            yield run

    def run(parts):
        if len(blocks) == 1:
            yield from _found(Index(blocks[0].value), parts)
            return
        for some in held(parts):
            for block in blocks:
                index = Index(block.value)
                block.__dict__.pop("_value", None)  # it can be read again from its file
                yield from _found(index, some)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end, edits, regions: one row for each document row and item of which it holds a window.

    start and end span all verified regions (code points, end exclusive), edits is the least of their distances,
    regions their number. Texts and items of fewer than q characters, null and empty ones have no q-gram and no row.
    Items with a null id aren't looked for; rows that repeat an id give rows each; equal items each give a row; either table may be
    empty; a null doc_id stays null. The items go to all tasks in blocks of a bounded number of characters (or one item), of which
    a task holds one at a time; the documents are read once.
    """
    d = pick(docs, doc=id_col, text=text_col)
    d = d.withColumn("doc", F.col("doc").cast("long"))
    b = pick(benchmark, item=item_col, text=item_text_col).where("item IS NOT NULL AND text IS NOT NULL").withColumn("item", F.col("item").cast("long"))
    blocks = max(1, -(-int(b.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    sent = []
    for i in range(blocks):
        items = sorted((r["item"], r["text"]) for r in b.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect())
        sent.append(d.sparkSession.sparkContext.broadcast(items))
        if blocks > 1:
            sent[-1].__dict__.pop("_value", None)  # the driver, too, holds one block at a time
    return d.where(F.length("text") > 0).mapInArrow(_search(sent), "doc_id long, item_id long, start long, end long, edits long, regions long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **items: str) -> DataFrame:
    """docs without the documents that hold a window of a benchmark item; rows with null ids and all columns stay."""
    return without(docs, id_col, leaks(docs, benchmark, id_col=id_col, text_col=text_col, **items).select("doc_id"))
