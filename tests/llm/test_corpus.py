"""Language ID, line dedup, decontamination, license scan, LM scoring and the pipeline, held against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cloakspark.llm import bpe, decontam, langid, licenses, linededup, lm

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, host int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", 1) for i, t, lang, s in rows], DOCS)


# Language ID


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d)
    got = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert sum(r["accepted"] for r in got) / len(got) > 0.995


def test_language_rejection_on_both_sides(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    finnish = "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto ja heidan on toimittava toisiaan kohtaan veljeyden hengessa".split()
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(finnish) for _ in range(rng.choice([40, 200, 2000]))), None, None) for i in range(40)]
    rows += [(100 + i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(80)), None, None) for i in range(40)]
    model = langid.fit(d)
    assert not any(r["accepted"] for r in langid.predict(docs(spark, rows), model).collect())
    clean = [r for r in langid.predict(d, model).join(d.select("doc_id", "text"), "doc_id").collect() if r["held_out"] and len(r["text"] or "") > 100]
    assert sum(r["accepted"] for r in clean) >= 0.999 * len(clean) > 100


def test_language_of_more_than_200_languages_and_a_bounded_sample(spark, monkeypatch):
    rng = random.Random(8)
    rows, n = [], 0
    for lang in range(230):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)]
        for _ in range(4):
            rows.append((n, " ".join(rng.choice(words) for _ in range(30)), f"l{lang:03d}", None))
            n += 1
    d = docs(spark, rows)
    monkeypatch.setattr(langid, "train", lambda texts, labels: (texts, labels))
    texts, labels = langid.fit(d)
    assert len(set(labels)) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}) > 220
    texts, labels = langid.fit(d, sample_rows=115)
    assert 30 < len(texts) < 300
    texts, _ = langid.fit(docs(spark, [(i, "ab " * 50_000, "x", None) for i in range(9)]))
    assert texts and {len(t) for t in texts} == {langid.EXCERPT}


def test_language_edges(spark):
    base = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    model = langid.fit(docs(spark, [(r["doc_id"], r["text"], r["lang"], None) for r in base]))
    rows = [(1, None, "en", None), (2, "", None, None), (3, "12 !? \n", "de", None), (None, base[0]["text"], None, None), (4, "x" * 200_000, None, None), (4, "x" * 200_000, None, None), (5, "the and of", None, None)]
    got = langid.predict(docs(spark, rows), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[None]["lang_pred"] == base[0]["lang"]
    assert by[5]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert sorted(r["doc_id"] for r in langid.keep_identified(docs(spark, [*rows, *[(100 + r["doc_id"], r["text"], r["lang"], None) for r in base]])).where("doc_id < 4").collect()) == []


def test_language_nothing_to_learn(spark):
    rows = [(1, "some words", None, None)]
    assert langid.fit(docs(spark, rows)) is None
    assert langid.predict(docs(spark, rows), None).first()["lang_pred"] == "und"
    empty = docs(spark, [])
    assert langid.predict(empty, langid.fit(empty)).count() == 0 and langid.keep_identified(empty).columns == empty.columns


def test_prediction_is_the_average_it_claims(spark):
    model = langid.train(["the cat and the dog"] * 10 + ["der hund und die katze"] * 10, ["en"] * 10 + ["de"] * 10, steps=50)
    ids, starts = langid.subwords([b"the dog", b"hund"])
    want = []
    for i, n in ((0, 7), (1, 4)):
        rows = [t[j] for t, x in zip(model.tables, ids) for j in x[starts[i] : starts[i] + n + 2] if j != langid.BUCKETS]
        want.append(np.sum(rows, axis=0) / len(rows) + model.bias)
    assert np.allclose(model.logits([b"the dog", b"hund"]), want, atol=1e-5)


# Line dedup


def surely(k, n):
    """The lower end of Wilson's interval of k - 1 of n - 1."""
    k, n = k - 1, n - 1
    p = k / n
    return (p + 3.8416 / (2 * n) - 1.96 * (p * (1 - p) / n + 3.8416 / (4 * n * n)) ** 0.5) / (1 + 3.8416 / n)


def brute_lines(rows, ratio, copies_once=False):
    own = {(t, s) for _, t, _, s in rows} if copies_once else [(t, s) for _, t, _, s in rows]
    pages, count = Counter(s for _, s in own), Counter()
    for t, s in own:
        count.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in count.items() if n > 1 and surely(n, pages[k[0]]) > ratio}
    chars = lambda xs: sum(len(x.strip(" ")) for x in xs)
    out = []
    for i, t, _, s in rows:
        kept = [x for x in (t or "").split("\n") if (s, x.strip(" ")) not in bad]
        out.append((i, t if t is None or (copies_once and chars(kept) < 0.5 * chars(t.split("\n"))) else "\n".join(kept)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    lines = ["Menu", " Menu ", "Footer", "", "  ", *(f"line {i}" for i in range(300))]
    rows = [(i, "\n".join(rng.choice(lines[:6] if rng.random() < 0.4 else lines) for _ in range(rng.randint(0, 12))), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    rows += [(7, None, None, "a"), (7, "Menu", None, "a"), (8, "Menu\nMenu", None, "rare")]
    for ratio in (0.02, 0.1, 0.5):
        out = linededup.dedup_lines(docs(spark, rows), ratio=ratio)
        assert out.columns == docs(spark, []).columns
        key = lambda x: (x[0], x[1] or "", x[1] is None)
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted(brute_lines(rows, ratio), key=key)
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_in_hosts_of_every_size(spark):
    rows = []
    for host, (pages, having) in {"two": (2, 2), "nine": (9, 9), "ten2": (10, 2), "ten3": (10, 3), "all17": (500, 17), "all18": (500, 18), "one": (1, 1)}.items():
        rows += [(len(rows) + i, f"line {host} {i}\n" + ("footer" if i < having else "other") + ("" if i < having else f" {i}"), None, host) for i in range(pages)]
    lost = Counter(r["source"] for r in linededup.dedup_lines(docs(spark, rows), dropped_col="n").where("n > 0").collect())
    assert lost == {"two": 2, "nine": 9, "ten3": 3, "all18": 18}


def test_copy_groups_reach_near_dedup(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    copy, near = ["\n".join(say(12) for _ in range(20)) for _ in range(2)]
    rows = [(i, "Menu of the site\n" + "\n".join(say(12) for _ in range(6)), "en", "a") for i in range(60)]
    rows += [(100 + i, copy, "en", "a") for i in range(30)]
    for i in range(30):
        lines = near.split("\n")
        lines[i % 20] = lines[i % 20] + f" edit{i}"
        rows.append((200 + i, "\n".join(lines), "en", "a"))
    out = pipeline.line_dedup(spark, docs(spark, rows), "")
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(got[i]["text"] == t.replace("Menu of the site\n", "") for i, t, *_ in rows) and got[100]["n_chars"] == len(copy)
    left = {r["doc_id"] for r in pipeline.near_dedup(spark, out, "").collect()}
    assert left == {*range(60), 100, 200}
    found = {(r["n_docs"], r["n_pages"]) for r in linededup.boilerplate(docs(spark, rows[:90]), copies_once=True).collect()}
    assert found == {(60, 61)}


def test_hosts(spark):
    urls = ["http://A.example.org/x?y", "https://u@b.example:8080", "ftp://c", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(linededup.host_of(linededup.F.col("url")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["a.example.org", "b.example", "c", None, None]


# Decontamination


def semi_global(p, x):
    d = [0] * (len(x) + 1)
    for a in p:
        n = [d[0] + 1]
        for j in range(1, len(x) + 1):
            n.append(min(d[j - 1] + (a != x[j - 1]), d[j] + 1, n[j - 1] + 1))
        d = n
    return min(d)


def test_decontamination_against_alignment_of_everything(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "on", "of", "étude", "x"]
    items = [(i, " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(rng.choice([3, 14, 25])))) for i in range(6)] + [(6, None), (7, "short"), (8, "")]
    rows = []
    for i in range(40):
        s = list(rng.choice(items[:6])[1])
        for _ in range(rng.randint(0, 14)):
            p = rng.randrange(len(s))
            s[p : p + 1] = rng.choice(["", "z", s[p] + "q"])
        s = "".join(s)[rng.choice([0, 0, 30]) :]
        rows.append((i, rng.choice(["", "before it "]) + (s.upper() if i % 5 == 0 else s.replace(" ", "\n") if i % 5 == 1 else s) + rng.choice(["", " and after"]), None, None))
    rows += [(50, None, None, None), (51, "", None, None), (52, "clean " * 4000, None, None), (3, items[0][1], None, None), (None, items[1][1], None, None)]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs(spark, rows), bench).collect()}
    want = set()
    index = decontam.Index([x for x in items if x[1]])
    for i, t, *_ in rows:
        if i != 52:
            x = decontam.folded(t).tolist()
            want |= {(i, item) for (item, _, p), k in zip(index.windows, index.k) if len(x) >= decontam.Q and semi_global(p.tolist(), x) <= k}
    assert got == want and (52, 0) not in got
    kept = decontam.decontaminate(docs(spark, rows), bench)
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, *_ in rows if i is not None and i not in {d for d, _ in want})


def in_region(item, text, window=50, step=25):
    """Whether text holds a window of item within its edits, by the definition alone: windows, budgets and distances are computed here."""
    fold = lambda t: [w.lower() if len(w.lower()) == 1 else w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t)]
    p, x = fold(item), fold(text)
    begins = [0] if len(p) <= window else sorted({*range(0, len(p) - window + 1, step), len(p) - window})
    for a in begins:
        w = p[a : a + window]
        k = max(0, min(int(len(w) * 3 / 40), (len(w) - 8) // 8))
        if w and semi_global(w, x) <= k:
            return True
    return False


def test_decontamination_at_the_ends_of_documents_in_every_place_of_a_batch(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnop "
    items = [(i, "".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate((50, 50, 75, 120, 24))] + [(8, "qrstuv"), (9, "Wxyz")]
    rows, n = [], 0
    for i, t in items[:5]:
        for cut in (1, 2, 3, 4):
            for edge in (t[cut:], t[:-cut], "zz"[: cut % 3] + t[1:], t[: len(t) // 2] + t[len(t) // 2 + cut :]):
                rows += [(n, "clean words of their own, nothing else in here", None, None), (n + 1, edge, None, None), (n + 2, rng.choice(["", "x", "tail"]), None, None)]
                n += 3
    rows += [(n, "qrstuv", None, None), (n + 1, "no QRSTUVW yz", None, None), (n + 2, "wxy z", None, None), (n + 3, "wxyz", None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, *_ in rows for i, p in items if in_region(p, t)}
    first = None
    for parts in (1, 3, 7):
        for _ in range(2):
            rng.shuffle(rows)
            got = sorted(map(tuple, decontam.leaks(docs(spark, rows).repartition(parts), bench).collect()))
            assert {x[:2] for x in got} == want and all(0 <= x[2] < x[3] for x in got)
            assert first is None or got == first
            first = got
    kept = {r["doc_id"] for r in decontam.decontaminate(docs(spark, rows), bench).collect()}
    assert kept == {d for d, *_ in rows} - {d for d, _ in want}


def test_decontamination_in_blocks_and_empty(spark, monkeypatch):
    d, b = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    whole = sorted(map(tuple, decontam.leaks(d, b).collect()))
    monkeypatch.setattr(decontam, "ITEM_CHARS", 2000)
    assert sorted(map(tuple, decontam.leaks(d, b).collect())) == whole
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    exact = {(i, r["item_id"]) for r in b.collect() for i, t in texts.items() if r["text"] in t}
    assert exact <= {x[:2] for x in whole}


# License scan


def test_licenses_against_containment_everywhere(spark):
    rng = random.Random(6)
    names = sorted(licenses.TEMPLATES)
    rows = []
    for i in range(120):
        name = rng.choice(names)
        w = licenses.TEMPLATES[name].split()
        for _ in range(rng.choice([0, 0, len(w) // 25])):
            w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(["filler", "words"] * rng.randint(0, 30) + w + ["more", "text"] * rng.randint(0, 30)), name, None))
    rows += [(200, None, None, None), (201, "", None, None), (202, "two words", None, None), (203, "the " * 50_000, None, None), (None, "All RIGHTS\nreserved!", None, None)]
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs(spark, rows)).collect()}
    want = set()
    for i, t, *_ in rows:
        s, n = licenses.shingles([t])
        for name in names:
            own = np.unique(licenses.shingles([licenses.TEMPLATES[name]])[0])
            width = max(2 * len(own), 2 * licenses.WIDTH)
            if any(len(np.intersect1d(s[a : a + width], own)) >= licenses.CONTAINMENT * len(own) for a in (range(max(1, len(s) - len(own) + 1)) if i != 203 else [0])):
                want.add((i, name))
    strict = {(i, lang) for i, _, lang, _ in rows if (i, lang) in want}
    assert strict <= got and got <= want | strict
    assert licenses.scan(docs(spark, [])).count() == 0


# LM scoring


def slow_probability(net, near, target):
    """The network's definition, one token at a time."""
    h = np.tanh(sum(net.embed[t].astype(float) * net.scale[i] for i, t in enumerate(near)) + net.bias)
    g = [float(h @ net.group[i] + net.group_bias[i]) for i in range(lm.GROUPS)]
    own = range(target // lm.SIZE * lm.SIZE, (target // lm.SIZE + 1) * lm.SIZE)
    z = [float(h @ net.out[i] + net.out_bias[i]) for i in own]
    return g[target // lm.SIZE] - np.log(np.sum(np.exp(g))) + z[target % lm.SIZE] - np.log(np.sum(np.exp(z)))


def test_lm_network(spark):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, lm.TOKENS)
    counts[0] = 0
    net = lm.Network.start(counts)
    net = lm.Network([p + rng.normal(0, 0.3, p.shape).astype(np.float32) for p in net.parts])
    near, target = rng.integers(0, lm.TOKENS, (40, 2 * lm.SIDE)), rng.integers(1, lm.TOKENS, 40)
    near[:, 1] = near[0, 1]  # one token in many places
    want = [slow_probability(net, n, t) for n, t in zip(near.tolist(), target.tolist())]
    assert np.allclose(net.log_probabilities(near, target), want, atol=1e-3)
    like, grads = net.gradient(near, target)
    assert abs(like - sum(want)) < 1e-2
    total = lambda parts: sum(slow_probability(lm.Network(parts), n, t) for n, t in zip(near.tolist(), target.tolist()))
    for i, g in enumerate(grads):
        for at in sorted(zip(*np.nonzero(np.abs(g) > 0.05)), key=lambda x: -abs(g[x]))[:3]:
            parts = [p.astype(np.float64) for p in net.parts]
            parts[i][at] += 1e-4
            up = total(parts)
            parts[i][at] -= 2e-4
            assert abs((up - total(parts)) / 2e-4 - g[at]) < 0.02 * max(1, abs(g[at])), (i, at)


def loop_scores(rows, net, vocab):
    """The docstring's score by plain loops over words: the network, the word's share of its class, the contexts of other rows."""
    hashed = lambda w: int(lm.word_hashes([w.encode()])[0].view(np.int64)[0])
    docs_ = [[w.lower() for w in (t or "").split()] for _, t, *_ in rows]
    tokens = {w: int(vocab.tokens(np.array([hashed(w)], dtype=np.int64).view(np.uint64))[0]) for d in docs_ for w in d}
    words, of_token, seen = Counter(w for d in docs_ for w in d), Counter(), []
    for w, n in words.items():
        of_token[tokens[w]] += n
    assert dict(of_token) == {t: n for t, n in enumerate(vocab.counts.tolist()) if n}
    around = lambda d, i: (d[i - 1] if i else None, d[i + 1] if i + 1 < len(d) else None)
    for d in docs_:
        seen.append((Counter(around(d, i) for i in range(len(d))), Counter((around(d, i), tokens[d[i]]) for i in range(len(d)))))
    all_c, all_t = sum((c for c, _ in seen), Counter()), sum((t for _, t in seen), Counter())
    out = []
    for d, (c, t) in zip(docs_, seen):
        score = 0.0
        for i, w in enumerate(d):
            near = [tokens[d[j]] if 0 <= j < len(d) else 0 for j in [*range(i - lm.SIDE, i), *range(i + 1, i + 1 + lm.SIDE)]]
            lp, k = round(slow_probability(net, near, tokens[w]) * lm.FINE) / lm.FINE, around(d, i)
            n, there = all_c[k] - c[k], all_t[k, tokens[w]] - t[k, tokens[w]]
            score += np.log((there + lm.KAPPA * np.exp(lp)) / (n + lm.KAPPA)) if n else lp
            score += np.log(words[w] / of_token[tokens[w]]) if tokens[w] > vocab.last else 0
        out.append((len(d), score))
    return out


def test_lm_scores_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(lm, "RUN", 3000)
    monkeypatch.setattr(lm, "RANGE", 200)
    monkeypatch.setattr(lm, "WORDS", 25)
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 80]))), None, None) for i in range(120)]
    rows += [(500, rows[3][1], None, None), (500, rows[3][1].upper(), None, None), (900, None, None, None), (901, " \n", None, None), (None, "w1 W2 w3", None, None), (902, "w1 " * 40_000, None, None)]
    d = docs(spark, rows).repartition(3)
    got = {(r["doc_id"], r["n_tokens"], round(r["log_likelihood"], 1), r["mean_log_likelihood"] is None) for r in lm.score(d).collect()}
    assert len(lm.score(d).collect()) == len(rows)
    p = lm.pick(d, doc="doc_id", text="text")
    vocab = lm.Vocabulary.of(p, lm.WORDS)
    net = lm.train(p, vocab)
    want = [(i, n, s) for (i, *_), (n, s) in zip(rows, loop_scores(rows, net, vocab))]
    for i, n, s in want:  # but for what lies at the edge of two steps of 1 / FINE
        assert any(g[:2] == (i, n) and abs(g[2] - s) < 0.06 + 1e-4 * n for g in got), (i, n, s, [g for g in got if g[0] == i])
    assert all(g[3] == (g[1] == 0) for g in got)


def test_lm_tells_texts_that_occur_twice_and_trains(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(20000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, say(rng.randint(30, 200)), None, None) for i in range(300)]
    rows += [(1000 + i, t, None, None) for i in range(20) for t in [say(rng.randint(30, 200))] for _ in range(2)]
    rows += [(2000 + i, "alpha beta gamma delta " * rng.randint(4, 9), None, None) for i in range(60)] + [(3000, "delta beta alpha gamma " * 9, None, None)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score(docs(spark, rows)).collect()}
    once, twice = [got[i] for i in range(300)], [got[1000 + i] for i in range(20)]
    assert min(twice) > np.quantile(once, 0.95) and got[2000] > got[3000] + 1
    p = lm.pick(docs(spark, [r for r in rows if 2000 <= r[0] < 3000]), doc="doc_id", text="text")
    vocab = lm.Vocabulary.of(p)
    h, c = lm.word_hashes([b"alpha beta gamma delta " * 9])
    x, _, place = lm.framed(h, c, vocab)
    like = [float(n.log_probabilities(lm.window(x, place), x[place]).mean()) for n in (lm.Network.start(vocab.counts), lm.train(p, vocab, rounds=6, mask=2))]
    assert like[1] > like[0] + 0.2


def test_lm_leaves_hot_contexts_to_the_network(spark, monkeypatch):
    rows = [(i, "the cat the dog the cow", None, None) for i in range(30)]
    p = lm.pick(docs(spark, rows), doc="doc_id", text="text")
    monkeypatch.setattr(lm, "HOT_SAMPLE", 1)
    monkeypatch.setattr(lm, "HOT_LEAST", 29)
    monkeypatch.setattr(lm, "HOT_SHARE", 0)
    assert len(lm.hot_contexts(p, 180)) == 5  # the _ the is one context with two places
    monkeypatch.setattr(lm, "HOT_LEAST", 40)
    assert len(lm.hot_contexts(p, 180)) == 1
    assert lm.score(docs(spark, rows)).count() == 30 and lm.score(docs(spark, [])).count() == 0


def test_lm_counts_hot_contexts_exactly(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 25)
    monkeypatch.setattr(lm, "HOT_SAMPLE", 1)
    monkeypatch.setattr(lm, "HOT_SHARE", 0)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 9, 40]))), None, None) for i in range(200)]
    rows += [(300 + i, "the cat the dog the cow", None, None) for i in range(40)] + [(400, "w1 " * 500, None, None), (401, "one " * 500, None, None), (402, None, None, None)]
    d = docs(spark, rows).repartition(6)
    p = lm.pick(d, doc="doc_id", text="text")
    vocab = lm.Vocabulary.of(p, lm.WORDS)
    want = loop_scores(rows, lm.train(p, vocab), vocab)
    for least, size in ((3, 20), (30, 20), (3, 1 << 19)):  # all but the rarest, some, each in many slices or in one
        monkeypatch.setattr(lm, "HOT_LEAST", least)
        monkeypatch.setattr(lm, "RANGE", size)
        hot = lm.hot_contexts(p, sum(n for n, _ in want))
        counts = lm.hot_counts(p, vocab, hot).groupBy("at").sum("n").collect()
        assert len(counts) == len(hot) > 5 and min(r["sum(n)"] for r in counts) > least and max(r["sum(n)"] for r in counts) > 500
        got = {r["doc_id"]: (r["n_tokens"], r["log_likelihood"]) for r in lm.score(d).collect()}
        assert len(got) == len(rows)
        for (i, *_), (n, s) in zip(rows, want):
            assert got[i][0] == n and abs(got[i][1] - s) < 0.06 + 1e-4 * n, (least, size, i, n, s, got[i])


def test_lm_parameters_are_averaged_in_a_tree(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)), None, None) for i in range(40)]
    p = lm.pick(docs(spark, rows).repartition(9), doc="doc_id", text="text")
    vocab = lm.Vocabulary.of(p)
    flat = []
    for fan in (64, 2):
        monkeypatch.setattr(lm, "FAN", fan)
        flat.append(lm.train(p, vocab, rounds=1).flat())
    assert np.allclose(*flat, atol=2e-3)


# The pipeline


def test_pipeline_against_its_parts_by_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_neardup import brute

    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    model = langid.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
    left = [r for r in rows if r[1] and langid._ANY_LETTER.search(r[1]) and model.judged([r[1].encode()])[2][0]]
    lines = dict(brute_lines([(r[0], r[1], r[2], r[3]) for r in left], 0.02, copies_once=True))
    alone = {i for i, c in brute(list(lines.items()), 5).items() if i == c}
    index = decontam.Index([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    clean = {i for i in alone if not index.matches(decontam.folded(lines[i]))}
    own = bpe.load(bpe.default_path())
    got = {r["doc_id"]: r["n_tokens"] for r in pipeline.run(spark, DIR).collect()}
    assert got == {i: len(own.encode(lines[i])) for i in clean}
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, d, DIR).columns == d.columns, name
        assert stage(spark, d.limit(0), DIR).count() == 0


def test_stages_with_nulls_repeats_long_texts_and_clashing_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(60).collect()]
    rows = [(*r, 1, "x", 2.0, "s") for r in base]
    rows += [(None, None, None, None, None, None, None, None, None), (7001, None, "en", "src1", None, 1, "x", 2.0, "s"), (7002, "", None, None, 0, 1, None, 2.0, "s"), (7003, "the and of " * 60_000, "en", "src0", 1, 1, "x", 2.0, "s")]
    rows += [rows[0], rows[0], (7004, " \n\t", "en", None, 3, 1, "x", 2.0, "s")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, doc int, host string, n double, line_hash string"
    d = spark.createDataFrame(rows, kind)
    for name, stage in pipeline.STAGES:
        out = stage(spark, d, DIR)
        got = out.collect()
        if name == "encoding":
            assert len(got) == len(rows)
        else:
            assert out.columns == d.columns, name
            ids = {r["doc_id"] for r in got}
            assert (7003 in ids) and (None in ids or name == "language_id"), name
            assert {7001, 7002, 7004} <= ids or name == "language_id", name
