"""Katz backoff scores of n-grams: Good-Turing discounted counts with exactly normalised backoff weights, evaluated recursively.

Texts become chunks of token numbers once; all later steps exchange distinct words and distinct n-grams of chunks, not tokens.

1. ``chunks``: each holds about a million tokens as places in its own list of distinct words.
2. Level 1, by lots of words: each chunk sends its words with their training counts and gets back numbers and counts.
3. Levels 2 to ``order``, by lots of histories: a history is the number of an n-gram of the level below. Each chunk sends its n-grams with their training counts, and what the level below says of
   them; it gets back the counts of the whole corpus, numbers for the next level, and for histories of n-grams that are not known there what their backoff weight is made of.
   A history with more than a lot's share of the tokens is dealt by n-gram; there are fewer of those than lots, and Spark sums their parts before the driver sees them.
4. Each chunk scores its documents: P(w | h) = d_r r / c(h) if the n-gram has count r > 0, else alpha(h) P(w | h') with h' the history without its first word, down to P(w), which is
   discounted the same way and leaves the mass of words not known to one unknown word. A history that training has not seen has the weight 1.

A level's table holds, by lot and chunk, the counts, numbers and weights that chunks ask for; evaluation reads these. An n-gram that no document asks for is in none of them, as all documents are scored. Nothing grows on the driver but fixed numbers and the histories named in 3. Numbers are the lot and the place in it, in 64 bits.
"""

from __future__ import annotations

import pickle
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bucketed, buffers, dropped, hashed_words, mixed, parts_of, slices, written

END = np.uint64(0x5DEECE66D1234567)
#: Counts up to K are discounted.
K = 5
ORDER = 3
TOKENS = 600_000
SLICE = 1 << 20
#: Lots for each lot of the input's size, and turns in which the lots of a level are served: what is sent for a turn is gone before the next one begins.
FINER, TURNS = 2, 3
_DOC = np.dtype([("id", "<i8"), ("no_id", "u1"), ("train", "u1"), ("tokens", "<i8")])
#: The history at a document's start, at every level.
BEGIN = np.uint64(1 << 63)
#: Bits of a number that are the place in its lot.
PLACE = 40


def packed(x: np.ndarray) -> bytes:
    """An integer array, its length first, compressed by byte planes."""
    import pyarrow as pa

    body = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""
    return np.uint64(len(x)).tobytes() + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpacked(b: bytes, dtype) -> np.ndarray:
    import pyarrow as pa

    dtype = np.dtype(dtype)
    n = int(np.frombuffer(b, np.uint64, 1)[0])
    if not n:
        return np.zeros(0, dtype)
    body = pa.decompress(b[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()


def rising(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unrising(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpacked(b, dtype), dtype=dtype)


def paired(h: np.ndarray, w: np.ndarray) -> bytes:
    """Ascending pairs (history, word): each history once with the number of its words, words as steps within their history."""
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    step = np.diff(w, prepend=np.uint64(0))
    step[start] = w[start]
    return pickle.dumps((rising(h[start]), packed(np.diff(start, append=len(h)).astype(np.uint32)), packed(step)))


def unpaired(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histories and words of the pairs, the distinct histories and where each starts."""
    heads, many, step = pickle.loads(b)
    h, many, step = unrising(heads, np.uint64), unpacked(many, np.uint32).astype(np.int64), unpacked(step, np.uint64)
    if not len(h):
        return h, step, h, many
    start = np.concatenate(([0], np.cumsum(many)[:-1]))
    total = np.cumsum(step, dtype=np.uint64)
    w = total - np.repeat(total[start] - step[start], many)  # modulo 2**64
    return np.repeat(h, many), w, h, start


def summary(sums: np.ndarray) -> tuple[bytes, bytes]:
    """Rows of K + 1 whole numbers and a fraction."""
    return packed(sums[:, : K + 1].astype(np.int64).ravel()), sums[:, K + 1].tobytes()


def unsummary(x: tuple[bytes, bytes]) -> np.ndarray:
    return np.concatenate((unpacked(x[0], np.int64).reshape(-1, K + 1).astype(float), np.frombuffer(x[1]).reshape(-1, 1)), axis=1)


def discounts(counts: np.ndarray, k: int = K) -> np.ndarray:
    """d_0..d_k+1 from counts of counts n_1..n_k+1 (``counts[r]``): Good-Turing as Katz uses it, d_r = 1 above k.

    The counts of counts are smoothed first, as Good-Turing estimates need them: log n_r = a + b log r, fitted with weights n_r, b at most -1.05 (and -2 where fewer than two of them are not 0). So
    r* / r = (1 + 1/r)^(b + 1), and every d_r lies between 0 and 1 for a corpus of any size.
    """
    r = np.arange(1, k + 2)
    n = counts[1 : k + 2].astype(float)
    seen = n > 0
    b = -2.0
    if seen.sum() > 1:
        x, y, w = np.log(r[seen]), np.log(n[seen]), n[seen]
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        b = float((w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum())
    e = min(b, -1.05) + 1
    top = (k + 1) ** e
    d = np.ones(k + 2)
    d[0] = 0
    d[1 : k + 1] = ((1 + 1 / r[:k]) ** e - top) / (1 - top)
    return d


class Unigrams:
    """Base probabilities from corpus totals; ``unknown`` is the mass of words not known."""

    def __init__(self, tokens: int, words: int, documents: int, counts: np.ndarray):
        self.tokens, self.words, self.documents = tokens, words, documents
        self.d = discounts(counts)
        left = sum((1 - self.d[r]) * r * int(counts[r]) for r in range(1, K + 1))
        self.scale = 1.0
        if not tokens:
            self.unknown = 1.0
        elif left > 0:
            self.unknown = left / tokens
        else:  # no count is low enough: as if one more token had been seen
            self.unknown, self.scale = 1 / (tokens + 1), tokens / (tokens + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        """P(w) by count; the count 0 is the unknown word."""
        return np.where(c > 0, self.d[np.minimum(c, K + 1)] * c / max(self.tokens, 1) * self.scale, self.unknown)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def lot_of(words: np.ndarray, parts: int) -> np.ndarray:
    return (words % np.uint64(parts)).astype(np.int64)


def firsts(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of ``x`` (uint64, below 2**bits) ascending, where one of each is, and the place of every element among them.

    Where they fit into 64 bits, values are sorted with their places behind them, which takes a third of the time of sorting places by value.
    """
    n = len(x)
    if not n:
        return x, np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64((n - 1).bit_length())
    if bits + int(shift) <= 64:
        s = np.sort((x << shift) | np.arange(n, dtype=np.uint64))
        order = (s & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
        s >>= shift
    else:
        order = np.argsort(x)
        s = x[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(new) - 1
    return s[new], order[new], at


def dense_numbers(x: np.ndarray, parts: int) -> tuple[np.ndarray, int]:
    """Numbers (lot and place) without the gaps between lots, in the same order, and how many bits they have; BEGIN comes last."""
    if not len(x):
        return x, 0
    place = x & np.uint64((1 << PLACE) - 1)
    width = int(place.max()) + 1
    return np.minimum(x >> np.uint64(PLACE), np.uint64(parts)) * np.uint64(width) + place, (width * (parts + 1)).bit_length()


def by_lot(lots: np.ndarray, many: int) -> np.ndarray:
    """Places in order of lots (below ``many``), those of a lot as they were; small numbers are sorted by radix."""
    return np.argsort(lots.astype(np.uint16) if many <= 1 << 16 else lots, kind="stable")


def chunked(docs: DataFrame, parts: int) -> DataFrame:
    """(chunk, docs, words, counts, tokens): distinct words ordered by lot and hash, and every token's place among them."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["chunk", "docs", "words", "counts", "tokens"]
        state = {"next": TaskContext.get().partitionId() << 32, "n": 0}
        info, hashes = [], []

        def close():
            d, h = np.concatenate(info), np.concatenate(hashes)
            info.clear(), hashes.clear()
            words, at = np.unique(h, return_inverse=True)
            order = by_lot(lot_of(words, parts), parts)
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            at = place[at]
            train = np.repeat(d["train"] > 0, d["tokens"])
            counts = np.bincount(at[train], minlength=len(words)).astype(np.uint32)
            state["next"], state["n"] = state["next"] + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (state["next"] - 1, d.tobytes(), rising(words[order]), packed(counts), packed(at))], names)

        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            ids = batch.column("doc_id")
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            out = batch.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, SLICE):
                h, r = hashed_words(offsets[a : b + 1], data)
                n = np.bincount(r, minlength=b - a)
                d = np.zeros(b - a, _DOC)
                d["id"], d["no_id"], d["train"], d["tokens"] = ids[a:b], no_id[a:b], ~out[a:b], n + 1
                info.append(d)
                hashes.append(np.insert(h, np.cumsum(n), END))
                state["n"] += len(hashes[-1])
                if state["n"] >= TOKENS:
                    yield close()
        if info:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "chunk long, docs binary, words binary, counts binary, tokens binary")


ROWS = "kind int, chunk long, part int, a binary, b binary, c binary"


def _table(out: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*out)) or [[]] * 6
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "chunk", "part", "a", "b", "c"), cols, types)})


#: Kinds of rows: answers of a level to a chunk (the level's number), and these.
OWN, TOTALS, DEALT = 100, 102, 103


def counted_words(chunks: DataFrame, parts: int) -> DataFrame:
    """Level 1. Answers (numbers, counts) in the order of the chunk's words; TOTALS: the sums of a lot."""

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for chunk, words, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words, counts = unrising(words, np.uint64), unpacked(counts, np.uint32)
                cuts = np.searchsorted(lot_of(words, parts), np.arange(parts + 1))
                out += [(p, chunk, rising(words[x:y]), packed(counts[x:y])) for p, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["part", "chunk", "a", "b"])

    def count(key, table):
        part = key[0].as_py()
        asked = [(c, unrising(a, np.uint64), unpacked(b, np.uint32)) for c, a, b in zip(*(table.column(x).to_pylist() for x in ("chunk", "a", "b")))]
        words, at = np.unique(np.concatenate([a for _, a, _ in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([b for _, _, b in asked]).astype(float)).astype(np.int64)
        out, start = [], 0
        for chunk, a, _ in asked:
            mine = at[start : start + len(a)]
            start += len(a)
            out.append((1, chunk, part, rising(mine.astype(np.uint64)), packed(total[mine]), None))
        known = total > 0
        ends = total[words == END]
        totals = [total.sum(), known.sum(), ends.sum(), *np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2]]
        out.append((TOTALS, None, part, np.array(totals, np.int64).tobytes(), None, None))
        return _table(out)

    schema = "part int, chunk long, a binary, b binary"
    return chunks.select("chunk", "words", "counts").mapInArrow(ask, schema).groupBy("part").applyInArrow(count, ROWS)


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """Sum over the lots of their totals: ``n`` numbers a lot."""
    got = rows.where(F.col("kind") == TOTALS).select("a").mapInArrow(_read_totals, "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(n, np.int64)
    for r in got:
        out[r["at"]] = r["x"]
    return out


def _read_totals(batches):
    import pyarrow as pa

    for batch in batches:
        xs = [np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist()]
        at = np.concatenate([np.arange(len(x)) for x in xs]) if xs else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate(xs) if xs else at, pa.int64())], ["at", "x"])


def dealt_sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Histories dealt by n-gram, ascending, and their sums over all lots. Each has more than a lot's share of all tokens, so there are fewer than lots."""
    sums = rows.where(F.col("kind") == DEALT).select("chunk", "a").mapInArrow(_read_dealt, "h long, at int, x double")
    got = sums.groupBy("h", "at").agg(F.sum("x").alias("x")).collect()
    names = sorted({r["h"] & (1 << 64) - 1 for r in got})
    place = {h: i for i, h in enumerate(names)}
    out = np.zeros((len(names), K + 2))
    for r in got:
        out[place[r["h"] & (1 << 64) - 1], r["at"]] = r["x"]
    return np.array(names, np.uint64), out


def _read_dealt(batches):
    import pyarrow as pa

    for batch in batches:
        xs = [np.frombuffer(b) for b in batch.column(1).to_pylist()]
        h = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), K + 2) if xs else np.zeros(0, np.int64)
        at = np.tile(np.arange(K + 2), len(xs))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(at, pa.int32()), pa.array(np.concatenate(xs) if xs else np.zeros(0), pa.float64())], ["h", "at", "x"])


class Level:
    """What is known of a level when its table is counted: discounts, and the histories dealt by n-gram with their sums."""

    def __init__(self, d: np.ndarray, dealt: np.ndarray, sums: np.ndarray):
        self.d, self.dealt, self.sums = d, dealt, sums


def _found(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in ascending keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    return at, keys[at] == of


class Chunk:
    """A chunk at a level: per token the number and count of its n-gram of the level below, and of that n-gram's history.

    ``climb`` takes it one level up, by the answers to what ``distinct`` asks.
    """

    def __init__(self, rows: list[dict], uni: Unigrams, parts: int):
        self.uni, self.parts = uni, parts
        own = next(r for r in rows if r["kind"] == OWN)
        self.docs, self.at = np.frombuffer(own["a"], _DOC), unpacked(own["b"], np.uint32)
        answers = sorted((r for r in rows if r["kind"] == 1), key=lambda r: r["part"])
        word = np.concatenate([(np.uint64(r["part"]) << np.uint64(PLACE)) + unrising(r["a"], np.uint64) for r in answers])
        count = np.concatenate([unpacked(r["b"], np.int64) for r in answers])
        self.word, self.count = word, count[self.at]  # numbers of the chunk's words, ascending; counts of its tokens
        self.where, self.places = self.at.astype(np.int64), len(word)  # places of n-grams ascend as their numbers do
        self.number = word[self.at]
        self.first = np.concatenate(([0], np.cumsum(self.docs["tokens"])[:-1]))
        self.train = np.repeat(self.docs["train"] > 0, self.docs["tokens"])
        self.level, self.logp = 1, uni.p(count)[self.at]
        self.base = np.full(len(self.at), max(uni.tokens, 1), np.int64)  # what the level below divides by: c(h') and 1 more where it is closed

    def distinct(self, turn: int | None = None):
        """Distinct n-grams of the next level whose history is known, ordered by lot: token of each, place of each token's n-gram (-1: none), lot and whether dealt by n-gram; with ``turn`` of its lots only."""
        history, count = np.roll(self.number, 1), np.roll(self.count, 1)
        history[self.first], count[self.first] = BEGIN, self.uni.documents
        self.history, self.history_count = history, count
        known = np.flatnonzero(count > 0)
        if turn is not None:
            lot, hot = self.lots(known)
            mine = np.flatnonzero(lot % TURNS == turn)
            known, lot, hot = known[mine], lot[mine], hot[mine]
        local = np.roll(self.where, 1)
        local[self.first] = self.places  # BEGIN, after all others
        words = len(self.word)
        key, token, at = firsts(local[known].astype(np.uint64) * np.uint64(words) + self.at[known], ((self.places + 1) * words).bit_length())
        some, token = token, known[token]
        lot, hot = self.lots(token) if turn is None else (lot[some], hot[some])
        order = by_lot(lot * 2 + hot, 2 * self.parts)  # inside a lot by history, then by word
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        where = np.full(len(self.at), -1, np.int64)
        where[known] = place[at]
        return token[order], where, lot[order], hot[order]

    def lots(self, token):
        """The lot of each token's n-gram, and whether it is dealt by n-gram."""
        history = self.history[token]
        hot = self.history_count[token] * self.parts > self.uni.tokens
        if hot.any():
            of = token[hot]
            history[hot] = mixed(history[hot]) + self.number_of_word(of)
        return lot_of(mixed(history + np.uint64(1)), self.parts), hot

    def number_of_word(self, token):
        return self.word[self.at[token]]

    def climb(self, level: Level, answers: list[dict], scores: bool = True) -> None:
        """The next level's counts, numbers and, with ``scores``, probabilities of every token."""
        token, where, lot, hot = self.distinct()
        answers = sorted(answers, key=lambda r: r["part"])
        got = np.concatenate([unpacked(r["a"], np.int64) for r in answers]) if answers else np.zeros(0, np.int64)
        r, closed = got >> 1, (got & 1) > 0
        number = np.zeros(len(r), np.uint64)
        known_h, known_s, start = [level.dealt], [level.sums], 0
        for x in answers:
            n = int(np.frombuffer(x["a"], np.uint64, 1)[0])
            mine = np.flatnonzero(r[start : start + n] > 0) + start
            if x["c"]:
                number[mine] = (np.uint64(x["part"] >> 1) << np.uint64(PLACE)) + unrising(x["c"], np.uint64)
            if scores and x["b"]:
                h, s = pickle.loads(x["b"])
                known_h.append(unrising(h, np.uint64)), known_s.append(unsummary(s))
            start += n
        known_h, known_s = np.concatenate(known_h), np.concatenate(known_s)
        if scores:
            known_h, keep = np.unique(known_h, return_index=True)
            known_s = known_s[keep]
        history, total = self.history[token], self.history_count[token]
        if len(known_h):  # without scores those dealt by n-gram only, as the others' answers say whether they are closed
            place, ok = _found(known_h, history)
            closed |= hot & ok & (known_s[:, :K].sum(axis=1) == 0)[place]
        else:
            place, ok = np.zeros(len(history), np.int64), np.zeros(len(history), bool)
        divisor = total + closed
        if scores:
            lower = self.logp[token]
            p = level.d[np.minimum(r, K + 1)] * r / np.maximum(divisor, 1)
            back = np.flatnonzero((r == 0) & ok)
            p[r == 0] = lower[r == 0]
            if len(back):
                p[back] = weight(known_s[place[back]], total[back], level.d) * lower[back]
        has = where >= 0
        w = where[has]
        if scores:
            self.logp = self.logp.copy()
            self.logp[has] = p[w]
        self.base = np.ones(len(self.at), np.int64)
        self.base[has] = divisor[w]
        self.number, self.count = np.zeros(len(self.at), np.uint64), np.zeros(len(self.at), np.int64)
        self.number[has], self.count[has] = number[w], r[w]
        self.where, self.places = where, len(r)
        self.level += 1


def _rows(table) -> list[dict]:
    return table.select(["kind", "part", "a", "b", "c"]).to_pylist()


def _climbed(rows: list[dict], uni: Unigrams, levels: list[Level], parts: int) -> Chunk:
    c = Chunk(rows, uni, parts)
    for i, level in enumerate(levels, 2):
        c.climb(level, [r for r in rows if r["kind"] == i], scores=False)
    return c


def _by_chunk(own: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run`` (chunk, rows) for every chunk, its own row and its answers together; only answers move."""

    def both(key, mine, others):
        return run(key, _rows(mine) + _rows(others))

    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(both, schema)


def counted_ngrams(own: DataFrame, answers: DataFrame, uni: Unigrams, levels: list[Level], parts: int, last: bool, turn: int) -> DataFrame:
    """The level above ``levels``, in the lots of a turn. Answers (lot, counts, weights of histories, numbers unless it is the ``last``); TOTALS: counts of counts; DEALT: sums of histories dealt by n-gram."""
    at_level = len(levels) + 2
    below = levels[-1].d if levels else uni.d

    def ask(key, rows):
        c = _climbed(rows, uni, levels, parts)
        chunk = key[0].as_py()
        token, where, lot, hot = c.distinct(turn)
        n = np.bincount(where[c.train & (where >= 0)], minlength=len(token)).astype(np.uint32)
        h, w, lower, base = c.history[token], c.number_of_word(token), c.count[token], c.base[token]
        out = []
        cuts = np.searchsorted(lot * 2 + hot, np.arange(2 * parts + 1))
        for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:  # what the level below divides by is the history's own
                start = np.flatnonzero(np.concatenate(([True], h[x + 1 : y] != h[x : y - 1])))
                out.append((p % 2, chunk, p // 2, paired(h[x:y], w[x:y]), pickle.dumps((packed(n[x:y]), packed(lower[x:y]), packed(base[x:y][start] if levels else base[:0]))), None))
        return _table(out)

    def count(key, table):
        part = key[0].as_py()
        out, totals, begin_number = [], np.zeros(K + 2, np.int64), 0
        for hot in (0, 1):
            asked = []
            for r in (dict(zip(("kind", "chunk", "a", "b"), x)) for x in zip(*(table.column(x).to_pylist() for x in ("kind", "chunk", "a", "b")))):
                if r["kind"] == hot:
                    n, lower, base = (unpacked(x, t) for x, t in zip(pickle.loads(r["b"]), (np.uint32, np.int64, np.int64)))
                    h, w, heads, start = unpaired(r["a"])
                    base = np.repeat(base, np.diff(start, append=len(h))) if levels else np.full(len(h), max(uni.tokens, 1))
                    asked.append((r["chunk"], heads, np.diff(start, append=len(h)), w, n, lower, base))
            if not asked:
                continue
            heads, many, w, n, lower, base = (np.concatenate([x[i] for x in asked]) for i in range(1, 7))
            asked = [(x[0], len(x[3])) for x in asked]
            _, first, hi = firsts(*dense_numbers(heads, parts))
            names, hi = heads[first], np.repeat(hi, many)
            words, _, wi = firsts(*dense_numbers(w, parts))
            del w
            keys, first, at = firsts(hi.astype(np.uint64) * np.uint64(len(words)) + wi.astype(np.uint64), (len(names) * len(words)).bit_length())
            hi = hi.astype(np.int32)
            del wi
            total = np.bincount(at, n.astype(float)).astype(np.int64)
            del n
            known = total > 0
            r = total[known]
            of = (keys[known] // np.uint64(len(words))).astype(np.int64)  # place of its history in ``names``
            if levels:
                low = lower[first][known]
                p = below[np.minimum(low, K + 1)] * low / base[first][known]
            else:
                p = uni.p(lower[first][known])
            totals += np.bincount(np.minimum(r, K + 2), minlength=K + 3)[: K + 2]
            sums = np.zeros((len(names), K + 2))  # n_1..n_K, the sum of higher counts, the mass of the followers a level below
            for i in range(K):
                sums[:, i] = np.bincount(of[r == i + 1], minlength=len(names))
            sums[:, K] = np.bincount(of[r > K], r[r > K].astype(float), minlength=len(names))
            sums[:, K + 1] = np.bincount(of, p, minlength=len(names))
            if hot:
                out += [(DEALT, int(x.astype(np.int64)), part, s.tobytes(), None, None) for x, s in zip(names, sums)]
            seen = np.bincount(of, minlength=len(names)) > 0
            closed = (seen & (sums[:, :K].sum(axis=1) == 0) & (not hot)).astype(np.int64)  # followers that are all frequent leave no mass by themselves
            number = np.cumsum(known) - 1 + begin_number
            begin_number += int(known.sum())
            begin = 0
            for chunk, many in asked:
                mine = at[begin : begin + many]
                place = hi[begin : begin + many]
                begin += many
                weights = None
                if not hot:
                    unseen = np.flatnonzero(np.bincount(place[(total[mine] == 0) & seen[place]]))
                    weights = pickle.dumps((rising(names[unseen]), summary(sums[unseen]))) if len(unseen) else None
                numbers = None if last else rising(number[mine[known[mine]]].astype(np.uint64))
                out.append((at_level, chunk, part * 2 + hot, packed(total[mine] * 2 + closed[place]), weights, numbers))
        out.append((TOTALS, None, part, totals.tobytes(), None, None))
        return _table(out)

    return _by_chunk(own, answers, ask, ROWS).groupBy("part").applyInArrow(count, ROWS)


def weight(sums: np.ndarray, count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """alpha(h) from the history's sums (rows) and count: the mass its followers leave over what the level below gives to all other words."""
    used = (sums[:, :K] * (d[1 : K + 1] * np.arange(1, K + 1))).sum(axis=1) + sums[:, K]
    closed = sums[:, :K].sum(axis=1) == 0
    left = np.where(closed, 1 / (count + 1), 1 - used / np.maximum(count, 1))
    return left / np.maximum(1 - sums[:, K + 1], 1e-12)


def scored(own: DataFrame, answers: DataFrame, uni: Unigrams, levels: list[Level], parts: int) -> DataFrame:
    def run(_, rows):
        import pyarrow as pa

        c = Chunk(rows, uni, parts)
        word_count = c.count
        for i, level in enumerate(levels, 2):
            c.climb(level, [r for r in rows if r["kind"] == i])
        per_doc = lambda x: np.add.reduceat(x, c.first)
        base_score = np.log10((word_count + 1) / (uni.tokens + uni.words + 1))
        ids = pa.array(c.docs["id"], pa.int64(), mask=c.docs["no_id"] > 0)
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(c.docs["train"] == 0),
                "n_tokens": pa.array(c.docs["tokens"]),
                "n_known": pa.array(per_doc((word_count > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(c.docs), uni.tokens, np.int64)),
                "base_score": pa.array(per_doc(base_score)),
                "score": pa.array(per_doc(np.log10(c.logp))),
            }
        )

    return _by_chunk(own, answers, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). ``order``: words of the longest n-gram, 1 or more.

    A null text is empty and has one token, its end; texts of any length are scored whole. A null id is not held out. Repeated rows count, and are scored, each for itself. Without training documents
    every word is unknown. Ties need no rule. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    parts = parts_of(docs) * FINER
    chunks = written(chunked(docs, parts), "chunks")
    own = bucketed(chunks.select(F.lit(OWN).alias("kind"), "chunk", F.lit(-1).alias("part"), F.col("docs").alias("a"), F.col("tokens").alias("b"), F.lit(None).cast("binary").alias("c")), "tokens", "chunk")
    unigrams = written(counted_words(chunks, parts), "unigrams")
    dropped(chunks)
    totals = summed(unigrams, K + 5)
    uni = Unigrams(*(int(x) for x in totals[:3]), totals[3 : 3 + K + 2])
    answers, levels = unigrams.where("kind = 1"), []
    for level in range(2, order + 1):
        turns = [written(counted_ngrams(own, answers, uni, list(levels), parts, level == order, turn), f"level-{level}") for turn in range(TURNS)]
        table = reduce(DataFrame.unionByName, turns)
        levels.append(Level(discounts(summed(table, K + 2)), *dealt_sums(table)))
        answers = answers.unionByName(table.where(F.col("kind") == level))
    return scored(own, answers, uni, levels, parts)
