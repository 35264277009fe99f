"""Funnels, line dedup and the conversation trie against plain Python and on rows that are null, empty, long, equal or repeated."""

import hashlib
import math
import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shotlattice.llm import funnels, lines, trie

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- funnels

CLICKS = "client_id long, kind string, ts timestamp_ntz, lot int, client string, at long, n1 long"


def clicks_of(spark, rows):
    """Events with columns whose names clash with ones used inside."""
    return spark.createDataFrame([(c, k, t, 1, "x", 5, None) for c, k, t in rows], CLICKS)


def plain_funnels(rows, limit=timedelta(minutes=60)):
    by = defaultdict(set)
    for c, k, t in rows:
        if None not in (c, k, t):
            by[c, k].add(t)
    by = {k: sorted(v) for k, v in by.items()}

    def after(c, k, t):
        have = by.get((c, k), [])
        i = bisect_right(have, t)
        return have[i] if i < len(have) else None

    out = {}
    for f, (*steps, bad) in funnels.FUNNELS.items():
        for c in {c for c, _ in by}:
            n, times = [0] * 4, [[], [], []]
            for t in by.get((c, steps[0]), []):
                n[0] += 1
                for s in (1, 2, 3):
                    x, e = after(c, steps[s], t), after(c, bad, t)
                    if x is None or x - t > limit or (e is not None and e <= x):
                        break
                    n[s] += 1
                    times[s - 1].append((x - t) // timedelta(microseconds=1))
                    t = x
            if n[0]:
                out[f, c] = (*n, max(i + 1 for i in range(4) if n[i]), *[sorted(v)[math.ceil(90 * len(v) / 100) - 1] if v else None for v in times])
    depths = Counter((f, v[4]) for (f, _), v in out.items())
    return {k: (*v, depths[k[0], v[4]]) for k, v in out.items()}


def found_funnels(df):
    return {(r.funnel, r.client_id): (r.n1, r.n2, r.n3, r.n4, r.deepest, r.t2, r.t3, r.t4, r.same_depth) for r in df.collect()}


def some_clicks(seed, n, gap):
    rng, rows, at = random.Random(seed), [], datetime(2024, 3, 31, 1, 30)
    for _ in range(n):
        at += timedelta(microseconds=rng.choice([0, 0, 1, gap, gap * 3]))
        rows.append((rng.choice([7, 7, 7, 7, 1, 2, 3]), rng.choice(["view"] * 6 + ["click"] * 5 + ["purchase"] * 3 + ["signup", "error"]), at))
    return rows


@pytest.mark.parametrize("lot_rows, gap", [(10_000, 200_000_000), (25, 200_000_000), (7, 900_000_000), (4, 20_000_000)])
def test_funnels_of_lots_of_any_size(spark, lot_rows, gap):
    rows = some_clicks(lot_rows, 700, gap)
    rows += rows[:60] + [(None, "view", rows[0][2]), (7, None, rows[0][2]), (7, "view", None), (9, "other", rows[0][2]), (10, "purchase", rows[0][2])]
    assert found_funnels(funnels.count_funnels(clicks_of(spark, rows), lot_rows=lot_rows)) == plain_funnels(rows)


def test_funnels_at_the_limits(spark):
    at = lambda *a: datetime(2024, 1, 1, 0, 0) + timedelta(*a)
    hour = (0, 3600)
    rows = [(1, "view", at()), (1, "click", at(*hour)), (1, "view", at(0, 7200)), (1, "purchase", at(0, 10800, 1))]  # the last step is a microsecond late
    rows += [(2, "view", at()), (2, "click", at()), (2, "error", at(0, 5)), (2, "click", at(0, 5))]  # equal times are not later; an error at the time of the step rules it out
    rows += [(3, "view", at()), (3, "error", at()), (3, "click", at(0, 5))]  # an error at the start doesn't
    got = found_funnels(funnels.count_funnels(clicks_of(spark, rows)))
    assert got == plain_funnels(rows)
    assert got["A", 1][:5] == (2, 1, 1, 0, 3) and got["A", 2][:2] == (1, 0) and got["A", 3][:2] == (1, 1)


def test_a_client_all_over_the_lots(spark):
    """One client, dense rows, every lot open at both sides; attempts leave their lot and the next one."""
    rows = [(5, k, datetime(2024, 1, 1) + timedelta(seconds=i)) for i, k in enumerate(["view"] * 40 + ["click"] * 40 + ["view"] * 40 + ["purchase"] * 40 + ["signup"])]
    assert found_funnels(funnels.count_funnels(clicks_of(spark, rows), lot_rows=6)) == plain_funnels(rows)


def test_no_clicks(spark):
    assert funnels.count_funnels(clicks_of(spark, [])).count() == 0
    assert funnels.count_funnels(clicks_of(spark, [(1, "other", datetime(2024, 1, 1)), (None, "view", None)])).count() == 0


def test_micros_keep_the_calendar_in_any_zone(spark):
    at = datetime(2024, 3, 31, 2, 30, 1, 5)  # does not exist in Berlin
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        df = clicks_of(spark, [(1, "view", at)])
        assert df.select(funnels.micros(F.col("ts"), df.schema["ts"].dataType)).first()[0] == (at - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


# ---------------------------------------------------------------- lines

LINES = "doc_id long, text string, id string, row int, dropped int, keep string, n_lines int, first string"


def plain_lines(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(BLANK).translate(UPPER)
    last = lambda i: (i is None, i or 0)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        have = (t or "").split("\n")
        kept = [x for x in have if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)], key=last) == i]
        out.append((i, len(have), len(have) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found_lines(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, "i", 1, 2, "k", 3, "f") for i, t in rows], LINES)
    return sorted(map(tuple, lines.digest(lines.deduplicated(docs, **how)).collect()), key=repr)


@pytest.mark.parametrize("named", [1024, 1])
def test_lines_on_odd_rows(spark, named):
    rng = random.Random(3)
    some = [f"line number {i} of them" for i in range(12)] + ["short", "", "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü", "  Line Number 3 OF them\t\r", "\x0bline number 4 of them\x0c", " line number 5 of them"]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "line number 1 of them\n" * 3), (None, "line number 2 of them\nonly here, at null"), (None, "line number 2 of them"), (5, rows[5][1]), (5, "line number 7 of them\nanother text"), (104, "the longest line " * 20000 + "\nx")]
    rows += [(200 + i, "found in a third of all\nof its own %d and more" % i) for i in range(30)]
    rows += [(300, "\n".join(f"one of many lines {i // 2}" for i in range(5000))), (301, "\n".join(f"one of many lines {i}" for i in range(0, 5000, 2)))]
    assert found_lines(spark, rows, named=named) == plain_lines(rows)


def test_keep_bitmaps_are_runs(spark):
    docs = spark.createDataFrame([(1, "a line that repeats\nanother that repeats"), (2, "head\na line that repeats\nANOTHER that repeats \nmiddle\na line that repeats"), (3, "a line that repeats")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(k) for k in r.keep], r.n_dropped) for r in lines.deduplicated(docs).collect()}
    assert got == {1: ([(0, 2)], 0), 2: ([(0, 1), (3, 1)], 3), 3: ([], 1)}


def test_no_lines(spark):
    assert found_lines(spark, []) == []


# ---------------------------------------------------------------- trie

TURNS = "conv_id long, turn long, role string, text string, lot int, pos long, h string, node long, depth int"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, have in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - int(math.fmod(c, 100)), [])[:h] + have[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def found_trie(spark, rows):
    df = trie.conversation_trie(spark.createDataFrame([(*r, 1, 2, "h", 3, 4) for r in rows], TURNS))
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect())


def test_trie_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ünï", "", None])) for c in [*range(60), *range(100, 140), 250, 251, -3, -250] for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"the same {t}") for c in range(300, 340) for t in range(9)]  # copies
    rows += [(400, None, "user", "null first"), (400, 0, "user", "b"), (400, 0, "user", "a"), (400, 0, "user", "a"), (400, 0, None, "a"), (None, 0, "user", "no conversation")]
    rows += [(500, t, "user", "long " * 3000 + str(t % 2)) for t in range(40)]
    rng.shuffle(rows)
    assert found_trie(spark, rows) == plain_trie(rows)


def test_small_tries(spark):
    assert found_trie(spark, []) == []
    for rows in ([(1, 0, "user", "x")], [(0, 0, "user", "x"), (1, 0, "user", "x")], [(3, 0, "user", None)], [(c, 0, "u", "x") for c in (3, 4, 5)]):
        assert found_trie(spark, rows) == plain_trie(rows)


def test_hashes_of_ends_span_batches():
    import pandas as pd

    rows = pd.DataFrame({"depth": 1, "node": [1] * 5 + [2] * 2, "first": range(7), "piece": list("abcdefg")})
    got = pd.concat(trie._hashes([rows[:2], rows[2:3], rows[3:6], rows[6:]]))
    assert got["ends_sha256"].tolist() == [hashlib.sha256(x).hexdigest() for x in (b"a,b,c,d,e", b"f,g")]


# ---------------------------------------------------------------- texts made to share sums of powers

TWINS = ("n" * 32, "mmppnnmpmnlommpnnplolnmomnmlnnnn")


def crafted_texts():
    """Two texts that differ by the coefficients of (x - 1) (x^2 - 1) (x^4 - 1) ... (x^32 - 1), which vanishes modulo 2^64 for every odd x."""
    poly = [1]
    for k in [1, *range(2, 33, 2)]:
        poly = [a - b for a, b in zip([0] * k + poly, poly + [0] * k)]
    assert len(poly) == 274 and max(map(abs, poly)) == 6
    rng = random.Random(1)
    head, tail = ("".join(rng.choice("abcdefghij") for _ in range(200)) for _ in range(2))
    return [head + "".join(chr(109 + (c if side else 0)) for c in poly) + tail for side in (0, 1)]


def test_texts_that_share_every_polynomial_do_not_repeat(spark):
    from shotlattice.llm import repeats

    texts = crafted_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeats.digest(repeats.unrepeated(docs)).collect()} == {0: 0, 1: 0}


def test_words_that_share_every_polynomial_are_two(spark):
    from shotlattice.llm import jaccard, katz

    docs = spark.createDataFrame([(1, TWINS[0]), (2, TWINS[1])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == [(1, 1), (2, 2)]
    out, train = (next(i for i in range(1, 99) if (zlib.crc32(str(i).encode()) % 7 == 2) == held) for held in (True, False))
    docs = spark.createDataFrame([(out, TWINS[0]), (train, TWINS[1])], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.katz_scores(docs).collect()}
    assert got[out].held_out and got[out].n_known == 1 and got[out].base_score < got[train].base_score
