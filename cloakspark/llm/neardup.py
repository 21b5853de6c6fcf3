"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct k-word shingles. SuperMinHash gives each element a random order of the
signature's slots and the value rank + fraction at each slot; a slot keeps its least value, and an element stops
once its rank is beyond all that the slots hold. Bands of the signature propose pairs of documents, sets confirm
them. Bands hold at least 1 - 4e-6 of the pairs at the threshold itself, and more of closer ones.

Band keys are shuffled once, packed: a task sends its keys of one range as one row. Keys that more than a fixed share
of the documents have, of which there can only be a fixed number, aren't shuffled but looked up.

Hot groups: equal sets are one class from the start. In a bucket, all members are held against its least member
first; only members of buckets that still fall into several components go on, in blocks of bounded size, against
the members of other components. So a bucket of thousands of copies costs one comparison each. Pairs are verified in
cells of bounded size, to which a document's set goes once for all its pairs there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, bounded, cut, lowered, mix, pick, shingle_hashes, text_batches, without

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: Pairs whose one-byte sketches agree in less than this share of the slots aren't verified: 5 standard deviations below 0.8.
SKETCH_MARGIN = 0.16
#: Members of a bucket that one task holds against as many others.
BLOCK = 1024
#: Documents, and elements of their sets, that a cell of the verification holds on each side, about.
CELL_DOCS, CELL_ELEMENTS = 512, 1 << 20
#: Band keys that a task packs or reads at once.
KEYS_AT_ONCE = 1 << 20
#: Keys of more than this share of the documents aren't shuffled: at most BANDS / HOT_SHARE of them.
HOT_SHARE = 1 / 4096
#: The share is estimated from one document of so many; fewer than HOT_LEAST there are never hot.
HOT_SAMPLE, HOT_LEAST = 64, 32
#: Elements of the sets that are signed at once (a byte for each element and slot).
SIGN_AT_ONCE = 1 << 15
#: Bytes of text that are made into sets at once.
AT_ONCE = 1 << 19

_FRACTION = U64((1 << 40) - 1)


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """The signatures of non-empty sets of 64-bit hashes: a row of slots values, rank * 2**40 + fraction."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    out = np.full((len(sets), slots), np.iinfo(np.int64).max, dtype=np.int64)
    for begin, end in batches(sizes, SIGN_AT_ONCE):
        h = out[begin:end].reshape(-1)
        elements = np.concatenate(sets[begin:end])
        owner = np.repeat(np.arange(end - begin), sizes[begin:end])
        order = None
        for rank in range(slots):
            with np.errstate(over="ignore"):
                r = mix(elements + U64((rank * 0x632BE59BD9B4E019 + 1) & (2**64 - 1)))
            other = rank + ((r >> U64(40)) % U64(slots - rank)).astype(np.int64)
            if rank == 0:
                slot = other
            else:
                at = np.arange(len(elements)) * slots
                slot = order[at + other].astype(np.int64)
                order[at + other] = order[at + rank]
            np.minimum.at(h, owner * slots + slot, (r & _FRACTION).astype(np.int64) + (rank << 40))
            if rank + 1 == slots:
                break
            open_ = h.reshape(-1, slots).max(axis=1) >= (rank + 1) << 40  # a later rank could still lower a slot
            if not open_.any():
                break
            stay = open_[owner]
            if rank == 0:
                n = int(stay.sum())
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), n)
                at, k = np.arange(n) * slots, other[stay]
                order[at + k] = 0  # slot 0 and the drawn one change places
            elif not stay.all():
                order = order.reshape(-1, slots)[stay].reshape(-1)
            elements, owner = elements[stay], owner[stay]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    out = np.zeros((len(signatures), bands), dtype=U64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(signatures), (b + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), dtype=U64)
            for r in range(rows):
                key = mix(key * U64(0x9FB21C651E98DF25) + signatures[:, b * rows + r].astype(U64))
            out[:, b] = key
    return out.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """One byte for each slot."""
    return (mix(signatures.astype(U64)) & U64(255)).astype(np.uint8)


def set_digest(s: np.ndarray) -> bytes:
    """128 bits of a set: equal sets have equal digests."""
    with np.errstate(over="ignore"):
        return b"".join(int(mix(s ^ U64(seed)).sum(dtype=U64)).to_bytes(8, "big") for seed in (0x1234567, 0xABCDEF987654321))


def _sign(k: int):
    def run(parts):
        for doc, texts in text_batches(parts, AT_ONCE):
            sets = shingle_hashes([lowered(t) for t in texts], k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = superminhash([sets[i] for i in full])
            keys, sk = band_keys(sig), sketches(sig)
            rows = {i: j for j, i in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [
                    doc,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([keys[rows[i]] if i in rows else None for i in range(len(sets))], pa.list_(pa.int64())),
                    pa.array([sk[rows[i]].tobytes() if i in rows else None for i in range(len(sets))], pa.binary()),
                ],
                ["doc", "n", "digest", "bands", "sketch"],
            )

    return run


_ENTRY = (("key", np.uint64), ("doc", np.int64), ("n", np.int64))


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x by significance, so that what neighbours share compresses."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _unplanes(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack(ranges: int, hot: np.ndarray):
    """Rows (doc, n, bands) to rows (range, key, doc, n) of packed entries, one for each range of keys; hot keys are left out."""

    def flush(key, doc, n):
        key, doc, n = map(np.concatenate, (key, doc, n))
        if len(hot):
            cold = ~np.isin(key, hot)
            key, doc, n = key[cold], doc[cold], n[cold]
        order = np.argsort(key)
        key, doc, n = key[order], doc[order], n[order]
        of = (key >> U64(32)) * U64(ranges) >> U64(32)
        bounds = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(key)] if len(key) else [0]
        runs = list(zip(bounds, bounds[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array([int(of[a]) for a, _ in runs], pa.int64()), *[pa.array([_planes(x[a:b]) for a, b in runs], pa.binary()) for x in (key, doc, n)]], ["range", "key", "doc", "n"]
        )

    def run(parts):
        held, size = ([], [], []), 0
        for part in parts:
            for a in range(0, part.num_rows, KEYS_AT_ONCE // BANDS):
                own = part.slice(a, KEYS_AT_ONCE // BANDS)
                bands = own.column("bands").flatten().to_numpy(zero_copy_only=False).view(U64)
                each = len(bands) // own.num_rows
                for x, more in zip(held, (bands, np.repeat(own.column("doc").to_numpy(zero_copy_only=False), each), np.repeat(own.column("n").to_numpy(zero_copy_only=False), each))):
                    x.append(more)
                size += len(bands)
                if size >= KEYS_AT_ONCE:
                    yield flush(*held)
                    held, size = ([], [], []), 0
        if size:
            yield flush(*held)

    return run


def _buckets(parts):
    """Packed rows, sorted by range, to the members of all keys that several documents have, but for their leaders: key, doc, n, leader, ln, c."""

    def members(key, doc, n):
        key, doc, n = (np.concatenate([_unplanes(b, kind) for b in x]) for x, (_, kind) in zip((key, doc, n), _ENTRY))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        order = order[np.lexsort((doc[order], key[order]))]
        key, doc, n = key[order], doc[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(begin, len(key)))
        leader, ln, c = (np.repeat(x, count) for x in (doc[begin], n[begin], count))
        rest = doc != leader
        return pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in (key.view(np.int64), doc, n, leader, ln, c)], ["key", "doc", "n", "leader", "ln", "c"])

    at, held = None, ([], [], [])
    for part in parts:
        for r, *packed in zip(*[part.column(c).to_pylist() for c in ("range", "key", "doc", "n")]):
            if r != at and held[0]:
                yield members(*held)
                held = ([], [], [])
            at = r
            for x, b in zip(held, packed):
                x.append(b)
    if held[0]:
        yield members(*held)


def shared_buckets(reps: DataFrame) -> DataFrame:
    """key, doc, n, leader, ln, c for rows (doc, n, bands): members of keys of several documents, leaders (the least) apart."""
    total, drawn = reps.count(), reps.where(F.pmod(F.xxhash64("doc", F.lit(77)), F.lit(HOT_SAMPLE)) == 0)
    often = drawn.select(F.explode("bands").alias("key")).groupBy("key").count().where(F.col("count") >= max(HOT_LEAST, total * HOT_SHARE / HOT_SAMPLE))
    hot = np.sort(np.array([r["key"] for r in often.collect()], dtype=np.int64)).view(U64)  # at most BANDS / HOT_SHARE, about
    ranges = max(1, -(-total * BANDS // KEYS_AT_ONCE))
    packed = reps.select("doc", "n", "bands").mapInArrow(_pack(ranges, hot), "range long, key binary, doc binary, n binary")
    out = packed.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_buckets, "key long, doc long, n long, leader long, ln long, c long")
    if not len(hot):
        return out
    keys = F.broadcast(reps.sparkSession.createDataFrame(pd.DataFrame({"key": hot.view(np.int64)})))
    rows = reps.select("doc", "n", F.explode("bands").alias("key")).join(keys, "key")
    least = rows.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("l"), F.count("*").alias("c"))
    least = least.select("key", F.col("l.doc").alias("leader"), F.col("l.n").alias("ln"), "c")
    return out.unionByName(rows.join(F.broadcast(least), "key").where("doc <> leader").select(*out.columns))


def _contract(parts):
    """Union-find over the edges of one partition: a forest with the same components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in parts:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1 << 20:  # bounded memory: hand on what there is and begin again
            yield pd.DataFrame([(x, find(x)) for x in list(parent) if find(x) != x], columns=["u", "v"], dtype="int64")
            parent.clear()
    yield pd.DataFrame([(x, find(x)) for x in list(parent) if find(x) != x], columns=["u", "v"], dtype="int64")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp (least node of its component) for all nodes of edges (u, v); edges stay on the executors.

    Each partition contracts its edges by union-find; then large-star and small-star steps, each one written to the
    shared folder, until nothing changes.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInPandas(_contract, "u long, v long"))
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.x).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, large.u == least.x).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        last = now


def _compare(threshold: float):
    """Streams the sorted rows of (key, i, j) groups; yields pairs of different components that the sketches don't rule out."""
    least = threshold - SKETCH_MARGIN

    def group(g: pd.DataFrame) -> pd.DataFrame | None:
        n, comp, doc, blk = (g[c].to_numpy() for c in ("n", "comp", "doc", "blk"))
        sk = np.frombuffer(b"".join(g["sketch"]), dtype=np.uint8).reshape(len(g), -1)
        i, j = g["i"].iat[0], g["j"].iat[0]
        left, right = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        us, vs = [], []
        for a in left:
            r = right[(right > a) if i == j else slice(None)]
            r = r[(comp[r] != comp[a]) & (np.minimum(n[r], n[a]) >= threshold * np.maximum(n[r], n[a]) - 1e-9)]
            if len(r):
                r = r[(sk[r] == sk[a]).mean(axis=1) >= least]
                us.append(np.full(len(r), a))
                vs.append(r)
        if not us:
            return None
        us, vs = np.concatenate(us), np.concatenate(vs)
        us, vs = np.where(doc[us] > doc[vs], us, vs), np.where(doc[us] > doc[vs], vs, us)
        return pd.DataFrame({"u": doc[us], "v": doc[vs], "nu": n[us], "nv": n[vs]})

    def run(parts):
        rest = None
        for pdf in parts:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            new = np.flatnonzero(np.any([(x := pdf[c].to_numpy())[1:] != x[:-1] for c in ("key", "i", "j")], axis=0)) + 1
            bounds = [0, *new]
            out = [x for a, b in zip(bounds, bounds[1:]) if (x := group(pdf.iloc[a:b])) is not None]
            rest = pdf.iloc[bounds[-1] :]
            if out:
                yield pd.concat(out, ignore_index=True)
        if rest is not None and len(rest) and (x := group(rest)) is not None:
            yield x

    return run


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs.

    Words are runs of other than ASCII white space, A-Z in lower case. Two documents are linked if the Jaccard
    similarity of their k-word shingle sets is at least threshold; component_id is the least id that links reach,
    kept says whether it is the row's own. Null, empty and blank texts have the empty set and stay alone. Rows that
    repeat an id share the component of all rows of this id, and each is kept if the component's id is theirs. A row
    with a null id has a null component and is kept. Empty tables give empty ones; other columns are left behind.
    """
    d = pick(docs, doc=id_col, text=text_col).withColumn("doc", F.col("doc").cast("long"))
    signed = cut(d.mapInArrow(_sign(k), "doc long, n long, digest binary, bands array<long>, sketch binary"))
    full = signed.where("n > 0 AND doc IS NOT NULL")
    classes = full.groupBy("digest", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("c"))
    extra = bounded(full.select("doc", "digest", "n").join(classes.where("c > 1").select("digest", "n", "rep"), ["digest", "n"]).where("doc <> rep").distinct())
    copies = extra.select(F.col("doc").alias("u"), F.col("rep").alias("v"))
    reps = full.join(extra.select("doc", "digest", "n"), ["doc", "digest", "n"], "left_anti")
    members = cut(shared_buckets(reps))
    fits = F.least("n", "ln") >= F.greatest("n", "ln") * F.lit(threshold) - F.lit(1e-9)
    star = members.where(fits).groupBy(F.col("doc").alias("u"), F.col("leader").alias("v")).agg(F.max("n").alias("nu"), F.max("ln").alias("nv"))
    sk = reps.select("doc", "sketch")
    star = _likely(star, sk, threshold)
    salts = star.groupBy("v").agg(_blocks(F.count("*"), F.sum("nu")).alias("salts"))
    star = star.join(salts, "v").select("u", "v", F.xxhash64("v", F.pmod(F.xxhash64("u"), "salts")).alias("cell"))
    found = cut(_verified(d, star, k, threshold))
    comps = cut(connected_components(found))
    # Members other than leaders, in buckets that hold several components.
    open_ = members.where("c > 2").select("key", "doc", "n").join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    several = open_.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("c")).where("a <> b").select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    rows = open_.join(several, "key").withColumn("blk", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).join(sk, "doc")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "doc", "n", "comp", "sketch")
    pairs = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_compare(threshold), "u long, v long, nu long, nv long")
    pairs = cut(pairs.groupBy("u", "v").agg(F.max("nu").alias("nu"), F.max("nv").alias("nv")))
    more = cut(_verified(d, _celled(pairs), k, threshold))
    comps = cut(connected_components(found.union(more).union(copies)))
    out = signed.join(comps.select(F.col("node").alias("doc"), "comp"), "doc", "left")
    out = out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "doc").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _likely(pairs: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """The pairs that their sketches don't rule out."""
    p = pairs.join(sk.select(F.col("doc").alias("u"), F.col("sketch").alias("su")), "u").join(sk.select(F.col("doc").alias("v"), F.col("sketch").alias("sv")), "v")

    def run(parts):
        for pdf in parts:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(len(pdf), -1) for c in ("su", "sv"))
                yield pdf.loc[(a == b).mean(axis=1) >= threshold - SKETCH_MARGIN, ["u", "v", "nu", "nv"]]

    return cut(p.mapInPandas(run, "u long, v long, nu long, nv long"))


def _blocks(docs, elements):
    """In how many blocks so many documents with so many elements go."""
    return F.greatest(F.lit(1), F.ceil(docs / CELL_DOCS), F.ceil(elements / CELL_ELEMENTS)).cast("long")


def _celled(pairs: DataFrame) -> DataFrame:
    """pairs (u, v, nu, nv) with a cell: documents with common partners come into the same cells.

    A document's label is the least document two steps away; a label's documents are split into blocks of bounded size,
    and a cell holds the pairs of two blocks. So a document goes to as many cells as its partners have blocks.
    """
    both = pairs.select("u", "v", "nu").union(pairs.select(F.col("v"), F.col("u"), F.col("nv")))
    first = both.groupBy("u").agg(F.least("u", F.min("v")).alias("l"), F.max("nu").alias("n"))
    second = both.select("u", "v").join(first.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
    labels = first.select("u", "n").join(second, "u")
    sizes = labels.groupBy("l").agg(_blocks(F.count("*"), F.sum("n")).alias("b"))
    labels = cut(labels.join(sizes, "l").select("u", F.xxhash64("l", F.pmod(F.xxhash64("u"), "b")).alias("block")))
    p = pairs.select("u", "v").join(labels.withColumnRenamed("block", "a"), "u").join(labels.select(F.col("u").alias("v"), F.col("block").alias("b")), "v")
    return p.select("u", "v", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("cell"))


def _cell_sets(k: int):
    def run(parts):
        for at, texts in text_batches(parts, AT_ONCE):
            sets = shingle_hashes([lowered(t) for t in texts], k)
            cell, doc = at.field("cell"), at.field("doc")
            yield pa.RecordBatch.from_arrays([cell, doc, pa.nulls(len(doc), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cell", "u", "v", "s"])

    return run


def _confirm(percent: int):
    """Rows (cell, u, v, s), sorted by cell with the sets (null v) first, to the pairs whose sets reach the threshold."""

    def run(parts):
        at, sets = None, {}
        for part in parts:
            us, vs = [], []
            for cell, u, v, s in zip(*[part.column(c).to_pylist() for c in ("cell", "u", "v", "s")]):
                if cell != at:
                    at, sets = cell, {}
                if v is None:
                    sets.setdefault(u, []).append(np.frombuffer(s, dtype=U64))
                elif any(_reach(a, b, percent) for a in sets.get(u, ()) for b in sets.get(v, ())):
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return run


def _reach(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return False
    a, b = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(d: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (u, v, cell) whose full sets reach the threshold: a set goes to a cell once, and pairs meet it there."""
    need = pairs.select("cell", F.col("u").alias("doc")).union(pairs.select("cell", F.col("v").alias("doc"))).distinct()
    own = d.join(bounded(need), "doc").select(F.struct("cell", "doc").alias("doc"), "text")
    rows = own.mapInArrow(_cell_sets(k), "cell long, u long, v long, s binary").unionByName(pairs.select("cell", "u", "v", F.lit(None).cast("binary").alias("s")))
    return rows.repartition("cell").sortWithinPartitions("cell", F.col("v").asc_nulls_first()).mapInArrow(_confirm(round(threshold * 100)), "u long, v long").distinct()


def deduplicate(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one of the least id. Rows with null ids stay; all columns stay."""
    return without(docs, id_col, near_duplicates(docs, k=k, threshold=threshold, id_col=id_col, text_col=text_col).where("NOT kept").select("doc_id"))
