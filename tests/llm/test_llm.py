"""The operators for training data against brute force and on rows that are null, empty, long, equal or repeated."""

import importlib.util
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotlattice.llm import embeddings, graph, jaccard, katz, licenses, mixing, outliers, packing, quality_knn, queries, repeats, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, hash string, k1 long, lot int, n long"


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with ones used inside."""
    ids = range(len(texts)) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, None if s is None else "en", s, len(t or ""), 1, "r", None, 1, None, 1) for i, t, s in zip(ids, texts, sources)], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_texts():
    rng = random.Random(7)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    return [None, "", "   \n\t ", "one", "One", "a b c d", base, base, " ".join(near), prose(rng, 20000), "é" * 900, "x" * 2000, base.upper()]


def sets_of(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def roots_of(sets, ids):
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    group = defaultdict(list)
    for i in range(len(sets)):
        group[root(i)].append(ids[i])
    return [min((x for x in group[root(i)] if x is not None), default=None) if sets[i] else ids[i] for i in range(len(sets))]


# ---------------------------------------------------------------- 8


def test_jaccard_on_odd_rows(spark):
    texts = odd_texts()
    ids = [*range(20, 20 + len(texts) - 1), None]
    got = jaccard.jaccard_components(docs_of(spark, texts, ids)).select("doc_id", "n_shingles", "component_id").collect()
    want = list(zip(ids, map(len, sets_of(texts)), roots_of(sets_of(texts), ids)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_jaccard_chain_of_edits(spark):
    rng = random.Random(3)
    words = prose(rng, 200).split()
    texts = []
    for _ in range(60):
        words = list(words)
        words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [prose(rng, 150) + " " + " ".join(words[:60]) for _ in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == roots_of(sets_of(texts), list(range(len(texts))))


def test_long_words_that_swap_letters_are_two(spark):
    word = "a"
    while len(word) < 2048:  # Thue-Morse words: sums of powers of an odd base can't tell them from their complements
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, [word, other, word])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_jaccard_when_tasks_send_often(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 2000)
    monkeypatch.setattr(jaccard, "CHUNK", 700)
    rng = random.Random(21)
    base = [prose(rng, 60).split() for _ in range(6)]
    texts = []
    for i in range(120):
        w = list(base[i % 6])
        w[rng.randrange(60)] = rng.choice(["x", "y", w[0]])
        texts.append(" ".join(w) + " one common line that all of them have")
    ids = list(range(len(texts)))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs_of(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in ids] == roots_of(sets_of(texts), ids)


def test_trie_links_hold_the_same_components_as_all_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40))).astype(np.uint64) for _ in range(150)]
    sets += [np.sort(rng.permutation(s)[: max(1, len(s) - 1)]) for s in sets[:60]]
    known, want = graph.Sets(len(sets)), graph.Sets(len(sets))
    links = jaccard.trie_links(sets, known)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    assert known.roots().tolist() == want.roots().tolist()
    assert len(links) == len(sets) - len(set(want.roots().tolist()))


def test_representatives(spark):
    texts = odd_texts()
    df = docs_of(spark, [*texts, texts[6]], [*range(len(texts)), 6])
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 9, 10, 11]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 7), (3, 1), (None, 2)], "a long, b long")
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(41)}


# ---------------------------------------------------------------- 7


def test_repeats_on_odd_rows(spark):
    rng = random.Random(11)
    passage = prose(rng, 150)
    texts = [*odd_texts(), prose(rng, 50) + passage + prose(rng, 40), prose(rng, 30) + passage[3:] + "é", passage[:399], passage[10:500] + passage[10:500]]
    got = repeats.digest(repeats.unrepeated(docs_of(spark, texts))).collect()
    want = [(i, len((t or "").encode()), *b, b[0]) for i, (t, b) in enumerate(zip(texts, repeats.brute_force([(t or "").encode() for t in texts])))]
    assert sorted(map(tuple, got)) == want


def repeats_and_marks(texts, window=400, mark=200):
    bodies = [(t or "").encode() for t in texts]
    return [(i, len(b), *r, m[0]) for i, (b, r, m) in enumerate(zip(bodies, repeats.brute_force(bodies, window), repeats.brute_force(bodies, mark)))]


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_with_marks_and_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # with 3, most anchors are dealt out by windows
    rng = random.Random(5)
    common = [prose(rng, 60)[:n] for n in (150, 330, 430)]
    texts = [prose(rng, rng.randint(0, 40)) + common[i % 3] + prose(rng, rng.randint(0, 40)) for i in range(40)]
    texts += [*odd_texts(), texts[0], texts[1] * 3, common[2]]
    got = repeats.digest(repeats.unrepeated(docs_of(spark, texts), mark=200)).collect()
    assert sorted(map(tuple, got)) == repeats_and_marks(texts)
    got = repeats.unrepeated(docs_of(spark, texts), window=200).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(r[0], r[-1]) for r in repeats_and_marks(texts)]


def test_index_matches():
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 99, 60).astype(np.uint8)) for _ in range(6)]
    texts = [parts[0] + parts[1], parts[2] + parts[1], parts[3], parts[4] + parts[5], b"ab" * 30]
    for k, (t, match) in enumerate(zip(texts, repeats.index_matches(texts))):
        for i in range(len(t)):
            best = 0
            for j, u in enumerate(texts):
                for at in range(len(u)):
                    if (j, at) != (k, i):
                        n = 0
                        while i + n < len(t) and at + n < len(u) and t[i + n] == u[at + n]:
                            n += 1
                        best = max(best, n)
            assert match[i] == best


def test_repeats_as_text(spark):
    a = "é" * 300
    got = repeats.unrepeated(docs_of(spark, ["x" + a + "1", a + "2"]), keep=("doc_id", "row"), as_text=True).orderBy("doc_id").collect()
    assert [(r.row, r.kept) for r in got] == [("r", "x1"), ("r", "2")]


# ---------------------------------------------------------------- 3


def good_turing(n, k=5):
    """Katz's discounts from counts of counts n[1..k + 1] that a weighted line through (log r, log n_r) stands for."""
    pts = [(math.log(r), math.log(n[r]), n[r]) for r in range(1, k + 2) if n[r]]
    slope = -2.0
    if len(pts) > 1:
        w = sum(p[2] for p in pts)
        mx, my = sum(p[0] * p[2] for p in pts) / w, sum(p[1] * p[2] for p in pts) / w
        slope = sum(p[2] * (p[0] - mx) * (p[1] - my) for p in pts) / sum(p[2] * (p[0] - mx) ** 2 for p in pts)
    slope = min(slope, -1.05)
    smooth = lambda r: r**slope
    common = (k + 1) * smooth(k + 1) / smooth(1)
    return {r: ((r + 1) * smooth(r + 1) / smooth(r) / r - common) / (1 - common) for r in range(1, k + 1)}


class PlainKatz:
    """The model word by word, from the formulas: nothing of it comes from the code under test."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            for k in range(1, order + 1):
                padded = ["\0begin"] * (k - 1) + t
                self.counts[k].update(tuple(padded[i : i + k]) for i in range(len(t)))
        of = lambda c: Counter(c.values())
        self.d = [None] + [good_turing(of(c)) for c in self.counts[1:]]
        self.n = sum(self.counts[1].values())
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, r in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = r
        self.known = {g[0] for g in self.counts[1]}

    def discounted(self, k, r):
        return self.d[k][r] * r if r <= 5 else r

    def p(self, history, w):
        k = len(history) + 1
        if k == 1:
            low = sum((1 - self.d[1][r]) * r for r in self.counts[1].values() if r <= 5)
            scale = 1.0 if low > 0 else self.n / (self.n + 1)
            if w in self.known:
                return self.discounted(1, self.counts[1][(w,)]) / self.n * scale
            return low / self.n if low > 0 else 1 / (self.n + 1)
        seen = self.after[k].get(history)
        if not seen:
            return self.p(history[1:], w)
        total = sum(seen.values()) + all(r > 5 for r in seen.values())
        if w in seen:
            return self.discounted(k, seen[w]) / total
        left = 1 - sum(self.discounted(k, r) for r in seen.values()) / total
        return left / (1 - sum(self.p(history[1:], x) for x in seen)) * self.p(history[1:], w)

    def score(self, t):
        padded = ["\0begin"] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_on_odd_rows(spark, order):
    rng = random.Random(31)
    texts = [*(t if len(t or "") < 5000 else prose(rng, 400) for t in odd_texts()), "a b", "a c", "b a", "c c c", "a b a b a b a b", *(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(25)), "new words here"]
    ids = [*range(len(texts) - 1), None]
    got = {r.doc_id: r for r in katz.katz_scores(docs_of(spark, texts, ids).repartition(3), order=order).collect()}
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), "\0end"] for i, t in zip(ids, texts)}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids}
    plain = PlainKatz([tokens[i] for i in ids if not held[i]], order)
    c, n, v = plain.counts[1], plain.n, len(plain.counts[1])
    for h in [("\0begin",) * (order - 1), ("a", "b", "a")[: order - 1], ("zz", "a", "b")[: order - 1]]:
        assert sum(plain.p(h, w) for w in plain.known) + plain.p(h, "\0none") == pytest.approx(1)
    for i in ids:
        t, r = tokens[i], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(c[(w,)] > 0 for w in t), n)
        assert r.score == pytest.approx(plain.score(t), rel=1e-9), i
        assert r.base_score == pytest.approx(sum(math.log10((c[(w,)] + 1) / (n + v + 1)) for w in t))


@pytest.mark.parametrize("bits", [20, 64])  # values sorted with their places, and places sorted by value
def test_katz_distinct_numbers(bits):
    x = np.random.default_rng(1).integers(0, 1 << 10, 5000).astype(np.uint64)
    values, some, at = katz.firsts(x, bits)
    assert values.tolist() == sorted(set(x.tolist())) and (x[some] == values).all() and (values[at] == x).all()
    assert [len(a) for a in katz.firsts(x[:0], bits)] == [0, 0, 0]
    numbers = np.array([katz.BEGIN, (2 << katz.PLACE) + 1, 7, (1 << katz.PLACE) + 9, 0], np.uint64)
    dense, most = katz.dense_numbers(numbers, 3)
    assert np.argsort(dense).tolist() == np.argsort(numbers).tolist() and int(dense.max()) < 1 << most < 1 << 20


def test_katz_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(katz, "TOKENS", 60)
    monkeypatch.setattr(katz, "SLICE", 200)
    rng = random.Random(32)
    texts = [" ".join(rng.choice(["a", "b", "c", "dd", "ee", "ff"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    got = {r.doc_id: r.score for r in katz.katz_scores(docs_of(spark, texts).repartition(4)).collect()}
    tokens = [[*WORD.findall(t), "\0end"] for t in texts]
    plain = PlainKatz([t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2], 3)
    for i, t in enumerate(tokens):
        assert got[i] == pytest.approx(plain.score(t), rel=1e-9)


def test_discounts_are_usable():
    for counts in ([0, 0, 0, 0, 0, 0, 0], [0, 5, 0, 0, 0, 0, 0], [0, 100, 40, 20, 12, 8, 6], [0, 1, 9, 1, 9, 1, 9]):
        d = katz.discounts(np.array(counts))
        assert (d[1:] > 0).all() and (d <= 1).all()


# ---------------------------------------------------------------- 2


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*odd_texts(), "hello <|endoftext|> there", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "<|endoftext|> x  <|endoftext|>  y", "a  b", " lead", "trail ", "it's 12 o'clock\n\n now \t x", "\u00a0nbsp \u3000wide", "two\n words here", "end\n", "mixed \u00e9\u4e2d 1,2"]
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = packing.pack(docs_of(spark, texts).repartition(3), size=256).collect()
    doc, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        doc[r.doc_id].append((r.start, r.length))
        seq[r.sequence_id].append((r.offset, r.length))
    for pieces, size in [(sorted(p), len(ids[i])) for i, p in doc.items()] + [(sorted(p), None) for p in seq.values()]:
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        total = sum(n for _, n in pieces)
        assert total == size if size else total == 256 or total & (total - 1) == 0
    assert len(doc) == len(texts)


def test_lengths_that_never_fill_one_another_stay_bounded(spark):
    texts = [" ".join(["a"] * 159)] * 300  # 160 ids each with the end, windows of 256
    rows = packing.pack(docs_of(spark, texts).repartition(1), size=256, most_open=8).toPandas()
    assert rows.groupby("doc_id").length.sum().eq(160).all() and rows.drained.mean() > 0.9
    sizes = rows.groupby("sequence_id").length.sum()
    assert ((sizes == 256) | (sizes & (sizes - 1) == 0)).all() and sizes.sum() == 300 * 160


def test_place_takes_the_level_with_least_squares():
    p, rng = packing.Packer(16, 0), random.Random(1)
    for _ in range(300):
        size = rng.randint(1, 15)
        before = p.count.copy()
        options = []
        for level in range(0, 17 - size):
            if level == 0 or before[level]:
                c = before.copy()
                c[level] -= level > 0
                if level + size < 16:
                    c[level + size] += 1
                options.append(int((c[1:16] ** 2).sum()))
        p.place((None, 0), size)
        assert int((p.count[1:16] ** 2).sum()) == min(options)


# ---------------------------------------------------------------- 6


def test_mixing_matches_sql(spark):
    texts = [*odd_texts(), *(" ".join("w" * (i % 7 + 1) for _ in range(i)) for i in range(60))]
    sources = [random.Random(i).choice(["a", "b", "c", "d", None]) for i in range(len(texts))]
    df = docs_of(spark, [*texts, texts[5]], [*range(len(texts)), 5], [*sources, sources[5]])
    got = mixing.mix(df).drop("copies").toPandas()
    documents = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents[["doc_id", "text", "source"]])
    want = con.sql(mixing.SQL).df()
    order = ["doc_id", "size", "taken"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want[got.columns].sort_values(order, ignore_index=True), check_dtype=False)
    assert (got.taken <= 3 * got["size"]).all()
    drawn = mixing.drawn(df)
    assert drawn.columns == df.columns and drawn.count() == mixing.mix(df).agg(F.sum("copies")).first()[0]


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 30 and got["c"] == 60 and got["b"] == pytest.approx(940) and got[None] == 0


# ---------------------------------------------------------------- 5


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked)


def test_base_rules(spark):
    rng = random.Random(4)
    p = prose(rng, 30)
    texts = [*odd_texts(), "a b c d e f g h " * 9, f"{p}\n{p}\n\n \n{p} ", "# * $ % & | < > x", " ".join(["w"] * 25), "line\r\nline\r\nline", f"{p} {prose(rng, 40)} {p}"]
    got = {r.doc_id: r for r in outliers.robust_outliers(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_stats(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_the_least_determinant_leaves_out_a_third_that_is_tight_elsewhere(spark):
    """Outliers that are few and far must not be in the half that is kept, whatever the start."""
    rng = np.random.default_rng(3)
    good = (rng.normal(0, 0.05, (300, outliers.DIMS)) + 1) * outliers.STEP
    bad = (rng.normal(0, 0.002, (60, outliers.DIMS)) + 3) * outliers.STEP
    rows = [("en", "s", *map(int, v)) for v in np.concatenate((good, bad))]
    x = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} long" for i in range(outliers.DIMS)))
    (est,) = outliers.estimates(x).collect()
    assert all(abs(est[f"m{i}"] - 1) < 0.02 for i in range(outliers.DIMS))


def brute_estimate(x, groups):
    """Minimum determinant over three starts in numpy, group by group: (distance, log determinant)."""
    x = x / outliers.STEP
    floor = np.array([f[1] for f in outliers.FEATURES])
    prior, p = outliers.PRIOR, len(floor)
    rows = {g: x[[h == g for h in groups]] for g in dict.fromkeys(groups)}
    dist = lambda v, m, cov: np.einsum("ni,ij,nj->n", v - m, np.linalg.inv(cov), v - m)

    def moments(sets, factor):
        whole = np.concatenate(list(sets.values())).mean(axis=0)
        return {
            g: ((len(v) * v.mean(axis=0) + prior * whole) / (len(v) + prior), factor * len(v) / (len(v) + prior) * np.cov(v.T, ddof=0).reshape(p, p) + np.diag(floor**2)) for g, v in sets.items()
        }

    medians = {g: (len(v) * np.median(v, axis=0) + prior * np.median(x, axis=0)) / (len(v) + prior) for g, v in rows.items()}
    mads = {g: 1.4826 * np.median(abs(v - np.median(v, axis=0)), axis=0) for g, v in rows.items()}
    now = [{g: (m, np.diag((1.5 * floor) ** 2)) for g, m in medians.items()}, {g: (m, np.diag(mads[g] ** 2 + floor**2)) for g, m in medians.items()}, moments(rows, 1.0)]
    det = lambda e: {g: np.linalg.slogdet(cov)[1] for g, (_, cov) in e.items()}
    for step in range(outliers.STEPS):
        new = []
        for est in now:
            near = {}
            for g, v in rows.items():
                q = np.minimum(np.floor(np.log1p(dist(v, *est[g])) * 64), 4096)
                near[g] = v[q <= np.percentile(q, outliers.KEEP * 100)]
            new.append(moments(near, outliers.CONSISTENT))
        fell = step == 0 or any(det(b)[g] < det(a)[g] - outliers.FALL for a, b in zip(now, new) for g in rows)
        now = new
        if not fell:
            break
    best = {g: min((round(det(e)[g], 6), i) for i, e in enumerate(now)) for g in rows}
    return {g: ((lambda v, e=now[i][g]: dist(v / outliers.STEP, *e)), d) for g, (d, i) in best.items()}


def test_estimates_match_numpy(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(20, 300)) for _ in range(150)] + [" ".join(w + "***" for w in prose(rng, 60).split()) for _ in range(12)] + [prose(rng, 80).upper() for _ in range(8)]
    sources = [random.Random(i).choice(["a", "b", None]) for i in range(len(texts))]
    df = docs_of(spark, texts, sources=sources)
    x = outliers.measured(df).where("not base_failed").orderBy("doc_id").select("doc_id", "source", *outliers.X).toPandas()
    v = x[outliers.X].to_numpy(float)
    d = brute_estimate(v, [s if isinstance(s, str) else None for s in x.source])
    got = {r.doc_id: r for r in outliers.robust_outliers(df).collect()}
    for i, (doc, s) in enumerate(zip(x.doc_id, x.source)):
        far, log_det = d[s if isinstance(s, str) else None]
        assert got[doc].d2 == pytest.approx(far(v[i : i + 1])[0], rel=1e-6) and got[doc].log_det == pytest.approx(log_det, abs=1e-5)
    assert all(got[i].kept for i in range(150) if not got[i].base_failed) and not any(got[i].kept for i in range(150, 170))
    assert sorted(r.doc_id for r in outliers.accepted(df).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_each_feature_rejects_by_itself(spark):
    rng = random.Random(12)
    lined = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    clean = [lined(prose(rng, rng.randint(60, 300)).split(), 10) for _ in range(200)]
    words_ = lambda: prose(rng, 300).split()
    half = [" ".join(prose(rng, 5).split()) for _ in range(30)] * 2
    rng.shuffle(half)
    ws = words_()
    odd = {
        "word_length": lined([w + w[: len(w) // 2] for w in words_()], 10),
        "symbols": lined([w + "#" * (i % 6 == 0) for i, w in enumerate(words_())], 10),
        "dup_lines": "\n".join(half),
        "repeats": " ".join(ws[:240] + ws[:36]),
        "capitals": lined([w.capitalize() if i % 2 else w for i, w in enumerate(words_())], 10),
    }
    got = {r.doc_id: r for r in outliers.robust_outliers(docs_of(spark, [*clean, *odd.values()])).collect()}
    assert sum(got[i].kept for i in range(200)) >= 199
    for i, name in enumerate(odd, 200):
        assert not got[i].base_failed and not got[i].kept, (name, got[i].d2)


# ---------------------------------------------------------------- 4


def test_license_scan_matches_sql(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT")
    texts = [*odd_texts(), f"Copyright (c) 2020 Somebody\nAll rights reserved\n\n{mit}", mit.upper().replace(",", "").replace(" ", "  "), "Some words.\nReleased under the MIT LICENCE!\nmore", "Licensed under CC BY-NC 4.0.", "copyright notice is no licence"]
    df = docs_of(spark, texts)
    got = licenses.scan(df).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.register("documents", df.toPandas()[["doc_id", "text"]])
    want = con.sql(licenses.sql()).df()[list(got.columns)].sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got.fillna("-"), want.fillna("-"), check_dtype=False)
    assert list(got.license[-5:].fillna("-")) == ["MIT", "MIT", "-", "CC-BY-NC-4.0", "-"] and list(got.line_licenses[-3:]) == ["MIT", "CC-BY-NC-4.0", ""]


def test_whole_licenses_in_their_usual_forms(spark):
    body = {n: next(t for m, t in licenses.KNOWN if m == n) for n in ("MIT", "ISC")}
    file = lambda n: (licenses.Path(licenses.__file__).parent / "license_texts" / f"{n}.txt").read_text()
    commented = "".join(f"# {x}\n" for x in file("BSD-3-Clause").replace("<year>, <owner>", "2021 Some Body").split("\n"))
    cases = [
        ("MIT", f"MIT License\n\nCopyright (c) 2020 X\n\n{body['MIT']}"),
        ("ISC", f"ISC License\n\nCopyright <YEAR> <HOLDER>\n\n{body['ISC']}"),
        ("BSD-3-Clause", commented),
        *[(n, file(n)) for n, *_ in licenses.WHOLE],
        ("GPL-3.0", file("GPL-3.0").split("END OF TERMS")[0]),
        *[("MIT", f"{line}\n{body['MIT']}") for line in ("# Copyright 2020 X", "// Copyright (c) X", "* Copyright 2020 X", "Copyright The X Authors", "Copyright <YEAR> <HOLDER>", "Copyright Jane Doe")],
        (None, f"copyright holders be liable\n{body['MIT']}"),
        (None, f"Some words.\n{body['MIT']}"),
    ]
    df = docs_of(spark, [t for _, t in cases])
    got = licenses.scan(df).toPandas().sort_values("doc_id", ignore_index=True)
    assert list(got.license.fillna("-")) == [n or "-" for n, _ in cases]
    con = duckdb.connect()
    con.register("documents", df.toPandas()[["doc_id", "text"]])
    want = con.sql(licenses.sql()).df()[list(got.columns)].sort_values("doc_id", ignore_index=True)
    pd.testing.assert_frame_equal(got.fillna("-"), want.fillna("-"), check_dtype=False)


def test_every_license_has_a_hit_a_variant_and_a_near_miss(spark):
    swap = [("http://", "https://"), ("acknowledgment", "acknowledgement"), ("authorization", "authorisation"), ("favor", "favour"), ("license", "licence"), ("organization", "organisation"), ("program ", "programme "), ("recognize", "recognise"), ("sublicense", "sub-license"), ("while", "whilst"), ("wilful", "willful")]
    cases = []
    for name, text in {n: t for n, t in reversed(licenses.KNOWN) if len(t) > 500}.items():
        other = text
        for a, b in swap:
            other = other.replace(a, b)
        words = text.split(" ")
        cases += [(name, text), (name, f"Copyright (c) 1999, 2020 Some One and Others\nAll rights reserved.\n\n{other.upper()}"), (None, " ".join(["perhaps" if i == len(words) // 2 else w for i, w in enumerate(words)])), (None, text[: len(text) * 2 // 3])]
    got = {r.doc_id: r.license for r in licenses.scan(docs_of(spark, [t for _, t in cases])).collect()}
    assert len(cases) >= 4 * 12
    assert [(i, got[i]) for i, (n, _) in enumerate(cases) if got[i] != n] == []


# ---------------------------------------------------------------- 1


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * (0.1 + 0.05 * (i % 5))).tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(5)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, [None] + [1.0] * 15, 0), (304, rows[0][1], None), (305, [], 0), (306, [1.0], 0), (307, [2.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n long, cid long")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, block=16).collect()}
    assert len(got) == len(rows)
    fit = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, up = Counter(), {i: i for i, _, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(fit)):
        for b in range(a):
            (i, x, p), (j, y, q) = fit[a], fit[b]
            if p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((root(i), root(j)))
                up[hi] = lo
    assert sum(links.values()) > 100
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links[i], root(i), root(i) == i), i


@pytest.mark.parametrize("size", [1e200, 1e-200, 1.0])
def test_near_vectors_of_any_norm(spark, size):
    rows = [(1, [size, size], 0), (2, [size, 1.0001 * size], 0), (3, [size, -size], 0), (4, [1.0, 1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


# ---------------------------------------------------------------- 9


def test_votes_match_a_plain_count(spark):
    """Neighbours by (similarity, id), one document at a time, with many equal texts among the labelled."""
    rng = random.Random(17)
    some = [prose(rng, rng.randint(5, 60)) for _ in range(25)]
    texts = [some[i % 25] + " x" * (i % 3) for i in range(150)] + [prose(rng, 30) for _ in range(20)] + ["", None]
    df = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, (i * 7) % 3 % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    model = quality_knn.fit(df, labels, dims=8, k=5)
    ids = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5]
    known = {}

    def vector(t):
        body = np.frombuffer((t or "").encode(), np.uint8)
        x = quality_knn.terms(np.array([0, len(body)]), body)[0].astype(np.float16).astype(float) * model.weight
        y = np.round(np.float32(x / np.linalg.norm(x)).astype(float) @ model.axes, 6)
        return np.float32(y / np.linalg.norm(y)).astype(float)

    for i in ids:
        known[i] = vector(texts[i])
    assert model.k == 5 and len(model.labels) == len(ids)
    got = {r.doc_id: r.score for r in quality_knn.classify(df, model).collect()}
    for i, t in enumerate(texts):
        if not t:
            assert got[i] == 0
            continue
        body = np.frombuffer(t.encode(), np.uint8)
        x = quality_knn.terms(np.array([0, len(body)]), body)[0].astype(float) * model.weight
        y = np.round(np.float32(x / np.linalg.norm(x)).astype(float) @ model.axes, 6)
        v = np.float32(y / np.linalg.norm(y)).astype(float)
        near = sorted((-round(float(v @ known[j]), 9), j) for j in ids)[:5]
        votes = [(max(-c, 0) ** 8 + 1e-12, (j * 7) % 3 % 2) for c, j in near]
        assert got[i] == pytest.approx(sum(a * q for a, q in votes) / sum(a for a, _ in votes), abs=1e-6)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_knn.classify(docs, quality_knn.fit(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.95
    assert (got[got.quality == 1].predicted == 1).mean() > 0.97


def test_quality_on_odd_rows(spark):
    df = docs_of(spark, odd_texts(), [*range(len(odd_texts()) - 1), None])
    labels = spark.createDataFrame([(6, 1, 0), (10, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_knn.classify(df, quality_knn.fit(df, labels)).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r.score <= 1 for r in rows)
    none = quality_knn.classify(df, quality_knn.fit(df, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.0, 0.5}


# ---------------------------------------------------------------- 10


def test_url_verdicts(spark):
    urls = ["http://a.net/x", "https://www.Example.net/en/1?q", "https://example.com/de/", "http://my.example.com/deu/", "http://x.org/fr/?a#b", "http://x.org/fr", "http://net", None, "no scheme", "http://", "a://b://c/d", "http://bad.host.io/win/prize?ref=x", "http://notexample.com/de/x", "http://h?x/y#z"]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, tokens int")
    teach = spark.createDataFrame([(f"http://s{i}.io/win/p{i}?ref=x", True) for i in range(30)] + [(f"http://s{i}.io/news/p{i}?ref=x", False) for i in range(60)] + [(f"http://s{i}.io/win/p{i}", False) for i in range(60)] + [(None, True), ("http://a.b/c", None)], "url string, block boolean")
    got = {r.page_id: r for r in url_rules.judge(pages, teach).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.net", "/x", "net/", "block"), ("www.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("my.example.com", "/deu/", None, "allow"), ("x.org", "/fr/", "org/fr/", "allow"), ("x.org", "/fr", None, "allow"), ("net", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("bad.host.io", "/win/prize", None, "block"), ("notexample.com", "/de/x", None, "allow"), ("h", "", None, "allow"),
    ]


def test_words_inside_path_segments_are_mined(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("aeioulnrst") for _ in range(9))
    teach = [(f"http://{name()}.io/{name()}-bets_{name()}/{name()}", True) for _ in range(40)] + [(f"http://{name()}.io/{name()}-news-{name()}", False) for _ in range(60)]
    pages = spark.createDataFrame([(0, "http://a.io/best-Bets-2024", None), (1, "http://a.io/best-news", None), (2, "http://a.io/bets", None), (3, "http://a.io/alphabets", None)], "page_id long, url string, html string")
    got = {r.page_id: r.mined for r in url_rules.judge(pages, spark.createDataFrame(teach, "url string, block boolean"), min_support=0.05).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False}


def test_urls_that_share_many_tokens_are_mined_at_once(spark):
    long = "&".join(f"q{i}=1" for i in range(40))
    rng = random.Random(6)
    some = lambda: "&".join(f"r{i}=1" for i in range(30) if rng.random() < 0.8)
    teach = [(f"http://a{i}.io/x?{long}", True) for i in range(30)] + [(f"http://b{i}.io/y?{some()}", i % 2 == 0) for i in range(80)] + [(f"http://c{i}.io/z", False) for i in range(34)]
    rules = url_rules.mine(spark.createDataFrame(teach, "url string, block boolean")).collect()
    assert any(set(r.rule) <= {*(f"query=q{i}" for i in range(40)), "path=x", "word=path.x"} for r in rules) and all(len(r.rule) <= 12 for r in rules)
    few = spark.createDataFrame([(f"http://a{i}.io/x?{long if i < 4 else ''}", i % 3 == 0) for i in range(64)], "url string, block boolean")
    assert url_rules.mine(few).count() == 0


def test_rules_hold_on_urls_not_seen_and_chance_makes_none(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("aeioulnrst") for _ in range(6))
    def url(bad):
        return f"http://{rng.choice(['www', 'm', 'blog'])}.{rng.choice(['free', 'win', 'big']) if bad else name()}-{rng.choice(['bets', 'casino']) if bad else name()}.io/{rng.choice(['en', 'de'])}/{rng.randint(1, 9999)}"

    rows = [(url(b), b if rng.random() < 0.95 else not b) for b in (rng.random() < 0.3 for _ in range(600))]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, block boolean"))
    unseen = [(url(b), b) for b in (rng.random() < 0.3 for _ in range(300))]
    hit = {r.url for r in url_rules.blocked_urls(spark.createDataFrame(unseen, "url string, block boolean"), rules).collect()}
    assert {u for u, b in unseen if b} == hit
    chance = [(u, rng.random() < 0.3) for u, _ in rows]
    assert url_rules.mine(spark.createDataFrame(chance, "url string, block boolean")).count() == 0


def test_mined_rules_match_counting(spark):
    teach = spark.createDataFrame([(f"http://h{i % 4}.io/{'ab'[i % 2]}/{'xyz'[i % 3]}", i % 4 == 1 or i % 6 == 0) for i in range(240)], "url string, block boolean")
    rules = url_rules.mine(teach, 0.05).collect()
    rows = [(set(r.t), r.block) for r in teach.select(url_rules.url_tokens(F.col("url")).alias("t"), "block").collect()]
    assert rules
    for r in rules:
        hit = [b for t, b in rows if set(r.rule) <= t]
        assert r.confidence == pytest.approx(sum(hit) / len(hit)) and r.confidence >= 0.6 and r.support == pytest.approx(sum(hit) / len(rows))
    single = {next(iter(r.rule)) for r in rules if len(r.rule) == 1}
    assert not any(len(r.rule) > 1 and single & set(r.rule) for r in rules)
    urls = teach.select("url").distinct()
    want = {u.url for u in urls.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect() if any(set(r.rule) <= set(u.t) for r in rules)}
    got = {r.url for r in url_rules.blocked_urls(urls, spark.createDataFrame([(r.rule,) for r in rules], "rule array<string>")).collect()}
    assert got == want


# ---------------------------------------------------------------- all


def test_empty_tables(spark):
    docs = docs_of(spark, ["x"]).limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    teach = spark.createDataFrame([], "url string, block boolean")
    for df in (
        embeddings.near_vectors(vectors), packing.pack(docs), katz.katz_scores(docs), licenses.scan(docs), outliers.robust_outliers(docs), outliers.accepted(docs), mixing.mix(docs), mixing.drawn(docs),
        repeats.unrepeated(docs), jaccard.jaccard_components(docs), jaccard.representatives(docs), quality_knn.classify(docs, quality_knn.fit(docs, labels)), url_rules.judge(pages, teach),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES)
    assert names == ("quality rules", "n-gram Jaccard join", "suffix-array dedup", "mixing", "packing")
    rows = {r.doc_id: r for r in docs.collect()}
    one = stages[0](spark, docs, SF).cache()
    kept = {r.doc_id for r in outliers.robust_outliers(docs).where("kept").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    ids = sorted(kept)
    comp = roots_of(sets_of([rows[i].text for i in ids]), ids)
    two = stages[1](spark, one, SF).cache()
    assert {r.doc_id for r in two.collect()} == set(comp)
    ids = sorted(set(comp))
    three = stages[2](spark, two, SF).cache()
    brute = repeats.brute_force([rows[i].text.encode() for i in ids], repeats.MARK)
    got = {r.doc_id: r for r in three.collect()}
    assert three.columns == docs.columns and sorted(got) == ids
    for i, (removed, _, _) in zip(ids, brute):
        assert (got[i].text == rows[i].text) == (removed == 0) and got[i].n_chars == len(got[i].text)
    four = stages[3](spark, three, SF).cache()
    copies = Counter(r.doc_id for r in four.collect())
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(three).collect() if r["size"]}
    assert four.columns == docs.columns and all(copies[i] == n for i, n in taken.items())
    pieces = stages[4](spark, four, SF).toPandas()
    assert pieces.groupby("doc_id").row.nunique().to_dict() == dict(copies)
    assert not pieces.duplicated(["row", "start"]).any() and (pieces.groupby("row").length.sum() == pieces.groupby("row").doc_tokens.first()).all()


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(41)
    passage = prose(rng, 60)
    texts = [*odd_texts(), *(f"{prose(rng, 40)}\n{passage}\n{prose(rng, 40)}" for _ in range(12)), *(prose(rng, rng.randint(20, 90)) for _ in range(20))]
    texts += [texts[-1]] * 3
    rows = [(None if i == 3 else i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", len(t or "")) for i, t in enumerate(texts)] + [(50, texts[-5], "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit("r")).withColumn("size", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("hash", F.lit("h"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    known = {t for t in texts if t}
    assert len(pieces) and not pieces.duplicated(["row", "start"]).any()
    assert set(pieces.doc_id.dropna().astype(int)) <= {r[0] for r in rows if r[0] is not None} and known
    sizes = pieces.groupby("sequence_id").length.sum()
    assert ((sizes == 2048) | (sizes & (sizes - 1) == 0)).all()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_queries_are_registered():
    found = sorted(queries.queries(), key=lambda k: int(k[2:].split("_")[0]))
    assert [int(k[2:].split("_")[0]) for k in found] == list(range(1, 14))
    assert importlib.util.find_spec("corpus_pipeline")


def test_rules_hold_tokens_that_alone_say_nothing_beside_many_that_say_more(spark):
    rng = random.Random(3)
    some = lambda bad: "&".join(f"d{i}=1" for i in range(22) if rng.random() < (0.72 if bad else 0.62))
    rows = [(f"http://s{i}.io{'/p' * (i % 2)}{'/q' * (i // 2 % 2)}/?{some(i % 4 in (0, 3))}", i % 4 in (0, 3)) for i in range(280)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, block boolean"))
    unseen = spark.createDataFrame([("http://new.io/p/q/",), ("http://new.io/p/",), ("http://new.io/q/",)], "url string")
    assert {r.url for r in url_rules.blocked_urls(unseen, rules).collect()} == {"http://new.io/p/q/"}


def test_katz_asks_without_scores(monkeypatch):
    said = []

    class Stub:
        def __init__(self, *_):
            pass

        def climb(self, level, answers, scores=True):
            said.append(scores)

    monkeypatch.setattr(katz, "Chunk", Stub)
    katz._climbed([], None, [None, None], 1)
    assert said == [False, False]
