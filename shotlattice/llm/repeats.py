"""Removal of long repeated byte strings with a run-length compressed Burrows-Wheeler index.

Every window of ``window`` bytes is assigned an anchor, the ``gram``-byte string in it with the least hash, so equal windows have equal anchors. Consecutive windows with one
anchor make a run; its context is the bytes that its windows cover.

1. Runs are counted by anchor and hash of the context. Each task first counts the runs of all it has read and sends one run of each context, so an anchor or a passage that
   every document has comes to the next step once a task. A context found twice is repeated as a whole; that settles what exact and long copies hold, without their bytes.
2. A context found once whose anchor has other contexts may share a part of its windows with them. Those contexts (one of each kind) are gathered by
   anchor, and an index is built over them: suffix order, Burrows-Wheeler transform, its runs, the suffixes at run ends and their longest common prefixes. Inside
   a run the common prefix of neighbours grows by one with each step to the left in the text, so the samples at run ends give every position's longest match
   in one pass; windows whose match is ``window`` bytes or more are repeated.
3. An anchor with more than ``HOT`` kinds of contexts would make an index of unbounded size. Its contexts' windows are dealt out by their own hashes instead: step 1 with a gram as long
   as the window. That is exact and has no open rest.
4. Texts meet their repeated windows by an equi join on two independent 64-bit hashes of the text and its length.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import buffers, dropped, mixed, parts_of, powers, slices, written

#: Bytes of a string that is removed, and of one that is marked.
WINDOW, MARK = 400, 200
CHUNK = 1 << 20
#: Text bytes of a task whose runs are counted before they are sent.
HELD = 32 << 20
#: Kinds of contexts that one index may hold of an anchor.
HOT = 4096
KEY = [("k1", "<i8"), ("k2", "<i8")]
RUN = np.dtype([("fp", "<u8"), ("ctx", "<u8"), *KEY, ("start", "<u4"), ("span", "u1"), ("many", "u1")])
#: Windows start .. start + span of a text. dup: all repeated; need: 1 a partner for others, 2 in question, 3 to be counted by windows.
ASKED = np.dtype([("fp", "<u8"), *KEY, ("start", "<u4"), ("span", "u1"), ("need", "u1"), ("dup", "u1")])


def gram_of(window: int) -> int:
    """The usual gram: 100 bytes less than the window, half of it at least."""
    return window - min(100, window // 2)


def runs(data: np.ndarray, cuts: np.ndarray, window: int = WINDOW, gram: int | None = None, ranges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """RUN rows (without keys) of the texts data[cuts[i]:cuts[i + 1]] and the text of each; ``start`` counts from the text's first byte.

    ``ranges``: per text the pairs (first, last) of window starts that are looked at; all if absent.
    """
    gram = gram or gram_of(window)
    spread = window - gram + 1
    n = len(data)
    valid = np.zeros(n, bool)
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if b - a >= window:
            if ranges is None:
                valid[a : b - window + 1] = True
            else:
                for x, y in ranges[i].tolist():
                    valid[a + x : a + y + 1] = True
    at = np.flatnonzero(valid)
    if not len(at):
        return np.zeros(0, RUN), np.zeros(0, np.int64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])  # these only bring windows together; what is removed rests on the contexts' digests
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1  # least key in each window of ``spread`` places, by doubling; of equal hashes the leftmost
    while width * 2 <= spread:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < spread:
        key = np.minimum(key[: len(key) - (spread - width)], key[spread - width :])
    anchor = (key[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    first, last = at[new], at[np.concatenate((new[1:] - 1, [len(at) - 1]))]
    a = anchor[new]
    out = np.zeros(len(new), RUN)
    doc = np.searchsorted(cuts, first, "right") - 1
    out["fp"], out["start"], out["span"] = grams[a], first - cuts[doc], last - first
    flat = np.ascontiguousarray(data).data
    digests = b"".join(hashlib.blake2b(flat[x:y], digest_size=8).digest() for x, y in zip(first.tolist(), (last + window).tolist()))
    # a context is its bytes and where its anchor stands in them; its length follows from the span
    out["ctx"] = mixed(np.frombuffer(digests, np.uint64) + mixed(((a - first).astype(np.uint64) << np.uint64(32)) + out["span"].astype(np.uint64)))
    return out, doc


def index_matches(contexts: list[bytes]) -> list[np.ndarray]:
    """For each position of each string, the longest match with any other place of the strings, by the run-length index."""
    m = len(contexts)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    text = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int64) + m
    text[ends] = np.arange(m)  # every end has a symbol of its own: no match crosses it
    ranks, width = [text], 1
    rank = text
    while width <= int(sizes.max()):
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        new = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(new[1:] != new[:-1])))
        width *= 2
        ranks.append(rank.astype(np.int32))
        if int(rank[order[-1]]) == n - 1:
            break
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    bwt = text[suffix - 1]
    heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # first rows of runs, but for row 0
    i, j = suffix[heads - 1].copy(), suffix[heads].copy()  # the samples: last row of a run, first row of the next
    tail, head = i.copy(), j.copy()
    common = np.zeros(len(heads), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        r = ranks[level]
        ok = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[ok] = r[i[ok]] == r[j[ok]]
        common[same] += step
        i, j = i + step * same, j + step * same
    match = np.zeros(n, np.int64)
    for sample in (head, tail):
        at = np.full(n, -1, np.int64)
        value = np.zeros(n, np.int64)
        at[sample], value[sample] = sample, common
        first = suffix[0] if sample is head else suffix[-1]
        at[first], value[first] = first, 0
        at = np.maximum.accumulate(at)
        has = at >= 0
        found = np.zeros(n, np.int64)
        found[has] = value[at[has]] - (np.flatnonzero(has) - at[has])
        match = np.maximum(match, found)
    return [match[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]


def _sorted_runs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """RUN rows by anchor, context and text; where an anchor, a context, a run of one text begins."""
    e = e[np.lexsort((e["start"], e["k2"], e["k1"], e["ctx"], e["fp"]))]
    head = np.ones(len(e), bool)
    differ = lambda *names: np.logical_or.reduce([e[n][1:] != e[n][:-1] for n in names])
    new_fp, new_ctx, once = head.copy(), head.copy(), head
    if len(e) > 1:
        new_fp[1:] = differ("fp")
        new_ctx[1:] = new_fp[1:] | differ("ctx")
        once[1:] = new_ctx[1:] | differ("k1", "k2", "start")
    return e, new_fp, new_ctx, once


def _asked(e: np.ndarray, need=0, dup=0) -> np.ndarray:
    out = np.zeros(len(e), ASKED)
    for name in ("fp", "k1", "k2", "start", "span"):
        out[name] = e[name]
    out["need"], out["dup"] = need, dup
    return out


def _by_part(rows: np.ndarray, name: str, parts: int, kind: int) -> list[tuple]:
    part = (rows[name].view(np.uint64) % np.uint64(parts)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    return [(p, kind, rows[order[x:y]].tobytes()) for p, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]


def _batch(out: list[tuple]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "blob"])


def _keyed(rows: DataFrame, window: int, gram: int, parts: int) -> DataFrame:
    """(k1, k2, dups, opens, hots): per text the windows that are repeated, the contexts in question, and the windows to be counted themselves.

    ``rows``: text, k1, k2, and where there is such a column ``ranges`` (window starts to look at).
    """
    ranged = "ranges" in rows.columns

    def gather(batches):
        held, size = [], 0

        def sent():
            e, _, new_ctx, once = _sorted_runs(np.concatenate(held))
            held.clear()
            ctx = np.cumsum(new_ctx) - 1
            copies = np.bincount(ctx, 1 + e["many"].astype(np.int64))[ctx]
            first = e[new_ctx]
            first["many"] = copies[new_ctx] > 1
            return _batch(_by_part(first, "fp", parts, 0) + _by_part(_asked(e[once & ~new_ctx], dup=1), "k1", parts, 1))

        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            key = np.zeros(batch.num_rows, np.dtype(KEY))
            key["k1"], key["k2"] = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            within = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in batch.column("ranges").to_pylist()] if ranged else None
            for a, b in slices(offsets, CHUNK):
                keys, first, count = np.unique(key[a:b], return_index=True, return_counts=True)
                if len(keys) == b - a:  # no copies in the chunk: its bytes as they are
                    keys = key[a:b]
                    found, doc = runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, gram, within and within[a:b])
                else:
                    texts = [data[offsets[a + f] : offsets[a + f + 1]] for f in first]
                    found, doc = runs(np.concatenate(texts), np.cumsum([0, *map(len, texts)]), window, gram, within and [within[a + f] for f in first])
                found["k1"], found["k2"], found["many"] = keys["k1"][doc], keys["k2"][doc], (count > 1)[doc]
                held.append(found)
                size += int(offsets[b] - offsets[a])
                if size >= HELD:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    def count(key, table):
        import pyarrow as pa

        part, kinds, blobs = key[0].as_py(), table.column("kind").to_pylist(), table.column("blob").to_pylist()
        out = [(part, 1, b) for k, b in zip(kinds, blobs) if k == 1]
        mine = [np.frombuffer(b, RUN) for k, b in zip(kinds, blobs) if k == 0]
        if mine:
            e, new_fp, new_ctx, once = _sorted_runs(np.concatenate(mine))
            ctx, fp = np.cumsum(new_ctx) - 1, np.cumsum(new_fp) - 1
            dup = (np.bincount(ctx, 1 + e["many"].astype(np.int64)) > 1)[ctx]
            kinds_of = np.bincount(fp, new_ctx)[fp]
            open_, hot = new_ctx & (kinds_of > 1), new_ctx & (kinds_of > HOT)
            keep = (once & dup) | open_
            asked = _asked(e[keep], np.where(hot, 3, np.where(open_, np.where(dup, 1, 2), 0))[keep], dup[keep])
            out += _by_part(asked, "k1", parts, 1)
        return pa.table(_batch(out).columns, ["part", "kind", "blob"])

    def by_text(_, table):
        import pyarrow as pa

        asked = np.concatenate([np.frombuffer(b, ASKED) for b in table.column("blob").to_pylist()])
        asked = asked[np.lexsort((asked["start"], asked["k2"], asked["k1"]))]
        first = np.flatnonzero(np.concatenate(([True], (asked["k1"][1:] != asked["k1"][:-1]) | (asked["k2"][1:] != asked["k2"][:-1]))))
        cols = [[], [], []]
        for x, y in zip(first.tolist(), [*first[1:].tolist(), len(asked)]):
            mine = asked[x:y]
            span = np.stack((mine["start"].astype(np.int64), mine["start"].astype(np.int64) + mine["span"]), 1)
            open_ = (mine["need"] == 1) | (mine["need"] == 2)
            for c, v in zip(cols, (span[mine["dup"] > 0], mine[open_], span[mine["need"] == 3])):
                c.append(v.tobytes() or None)
        return pa.table([pa.array(asked["k1"][first]), pa.array(asked["k2"][first]), *[pa.array(c, pa.binary()) for c in cols]], ["k1", "k2", "dups", "opens", "hots"])

    schema = "part int, kind int, blob binary"
    found = rows.mapInArrow(gather, schema).groupBy("part").applyInArrow(count, schema)
    return found.groupBy("part").applyInArrow(by_text, "k1 long, k2 long, dups binary, opens binary, hots binary")


def _searched(texts: DataFrame, window: int, parts: int) -> DataFrame:
    """(k1, k2, more): windows in question that the index finds elsewhere, of ``texts`` (text, opens, k1, k2); of copies that a task has one is enough."""

    def cut(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            out: dict[int, list] = {}
            for text, opens, *key in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in ("opens", "k1", "k2"))):
                if tuple(key) in seen:  # a copy
                    continue
                seen.add(tuple(key))
                body = text.as_buffer()
                asked = np.frombuffer(opens, ASKED)
                part = (asked["fp"] % np.uint64(parts)).tolist()
                for p, start, span, row in zip(part, asked["start"].tolist(), asked["span"].tolist(), asked):
                    out.setdefault(p, []).append((row.tobytes(), bytes(body[start : start + span + window])))
            blobs = [(p, b"".join(r for r, _ in v), b"".join(c for _, c in v)) for p, v in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary()), pa.array([b[2] for b in blobs], pa.binary())], ["part", "asked", "bytes"])

    def search(_, table):
        import pyarrow as pa

        groups: dict[bytes, list] = {}
        for asked, body in zip(table.column("asked").to_pylist(), table.column("bytes").to_pylist()):
            asked = np.frombuffer(asked, ASKED)
            at = np.concatenate(([0], np.cumsum(asked["span"].astype(np.int64) + window))).tolist()
            for row, x, y in zip(asked, at, at[1:]):
                groups.setdefault(body[x:y], []).append(row)
        found: list[tuple] = []
        order = sorted(groups, key=lambda c: (int(groups[c][0]["fp"]), c))
        fps = [int(groups[c][0]["fp"]) for c in order]
        at = 0
        while at < len(order):  # whole anchors at a time, about 2 MB of contexts; one anchor has HOT of them at most
            past, total = at, 0
            while past < len(order) and (total < 2 << 20 or fps[past] == fps[past - 1]):
                total += len(order[past])
                past += 1
            some = order[at:past]
            for c, match in zip(some, index_matches(some)):
                need = [r for r in groups[c] if r["need"] == 2]
                if need:
                    hit = match[: len(c) - window + 1] >= window
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                    for r in need:
                        found += [(int(r["k1"]), int(r["k2"]), int(r["start"]) + x, int(r["start"]) + y - 1) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())]
            at = past
        cols = list(zip(*found)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["k1", "k2", "start", "last"])

    cuts = texts.select("text", "opens", "k1", "k2").mapInArrow(cut, "part int, asked binary, bytes binary")
    found = cuts.groupBy("part").applyInArrow(search, "k1 long, k2 long, start long, last long")
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "last")).alias("more"))


def keys_of(text: Column) -> list[Column]:
    """Two hashes of a text that know nothing of one another; the second knows its length."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.octet_length(text), F.lit(0x51ED270B), text).alias("k2")]


def _united(batches):
    """Windows of all three kinds as merged ranges."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for dups, hot, more in zip(batch.column("dups").to_pylist(), batch.column("hot").to_pylist(), batch.column("more")):
            w = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in (dups, hot) if x]
            if more.is_valid:
                w.append(np.array([(m["start"], m["last"]) for m in more.as_py()], np.int64).reshape(-1, 2))
            w = np.concatenate(w) if w else np.zeros((0, 2), np.int64)
            w = w[np.lexsort((w[:, 1], w[:, 0]))]
            if len(w):
                past = np.maximum.accumulate(w[:, 1])
                new = np.flatnonzero(np.concatenate(([True], w[1:, 0] > past[:-1] + 1)))
                w = np.stack((w[new, 0], past[np.concatenate((new[1:] - 1, [len(w) - 1]))]), 1)
            out.append(w.tobytes() or None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["k1", "k2", "windows"])


def repeated_windows(rows: DataFrame, window: int, gram: int | None = None) -> DataFrame:
    """(k1, k2, windows), a written table: of each text that has any, the starts of windows that are found elsewhere too, as ascending ranges (first, last) of 64-bit numbers.

    ``rows``: text, k1, k2, and maybe ``ranges`` as in ``_keyed``. Joins that texts take part in have no aggregation on them, so that Spark can split the copies of one text.
    """
    gram = gram or gram_of(window)
    parts = parts_of(rows)
    keyed = written(_keyed(rows, window, gram, parts), "asked")
    texts = rows.join(keyed.where("opens is not null").select("k1", "k2", "opens"), ["k1", "k2"])
    more = written(_searched(texts, window, parts), "more")
    hot = keyed.where("hots is not null").select("k1", "k2", F.col("hots").alias("ranges"))
    if hot.isEmpty():
        own = keyed.withColumn("hot", F.lit(None).cast("binary"))
    else:  # a context of a text with copies is repeated anyway; of others one row is asked for
        counted = rows.select("text", "k1", "k2").join(hot, ["k1", "k2"])
        counted = _keyed(counted, window, window, parts).select("k1", "k2", F.col("dups").alias("hot"))
        own = keyed.join(counted, ["k1", "k2"], "left")
    own = own.join(more, ["k1", "k2"], "left").select("k1", "k2", "dups", "hot", "more")
    out = written(own.mapInArrow(_united, "k1 long, k2 long, windows binary").where("windows is not null"), "windows")
    dropped(keyed, more)
    return out


def covered(n: int, windows: np.ndarray, window: int) -> np.ndarray:
    """Which of a text's ``n`` bytes lie in the windows whose starts are the ranges ``windows``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, windows[:, 0], 1)
    np.add.at(change, windows[:, 1] + window, -1)
    return np.cumsum(change[:-1]) > 0


def kept_bytes(body: bytes, windows: np.ndarray, window: int = WINDOW) -> tuple[bytes, int, int]:
    """Text without the bytes of ``windows`` (ranges of window starts), bytes removed and maximal removed runs."""
    if not len(windows):
        return body, 0, 0
    gone = covered(len(body), windows, window)
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(body, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def unrepeated(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), as_text: bool = False, window: int = WINDOW, mark: int | None = None) -> DataFrame:
    """One row per document: the columns ``keep``, n_bytes, n_removed, n_spans, kept (binary; with ``as_text`` a string without the halves of characters cut in two), n_marked.

    Every byte covered by a string of ``window`` bytes that starts anywhere else too is removed, at all of its places. ``n_marked`` counts the bytes covered by such strings of ``mark`` bytes
    (at most ``window``), which stay; without ``mark`` it is n_removed. With both, the shorter strings are found first, and the longer ones only where the shorter ones are.
    A null text is empty; texts under ``mark`` bytes stay whole; texts of any length are taken whole; repeated rows are
    repeats of one another. An empty table gives an empty result. Columns named in ``keep`` pass through whatever their names and nulls; others are not read.
    """
    named = {f"own{i}": c for i, c in enumerate(keep)}
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(k) for k, c in named.items()]).select("*", *keys_of(F.col("text")))
    if mark is None or mark >= window:
        found = repeated_windows(rows.select("text", "k1", "k2"), window).withColumn("marks", F.lit(None).cast("binary"))
    else:
        marks = repeated_windows(rows.select("text", "k1", "k2"), mark)

        def longer(batches):
            import pyarrow as pa

            for batch in batches:
                w = [np.frombuffer(b, np.int64).reshape(-1, 2) - (0, window - mark) for b in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[x[:, 1] >= x[:, 0]].tobytes() or None for x in w], pa.binary())], ["k1", "k2", "ranges"])

        within = marks.mapInArrow(longer, "k1 long, k2 long, ranges binary").where("ranges is not null")
        some = rows.select("text", "k1", "k2").join(within, ["k1", "k2"])
        some = written(some, "texts")  # texts with repeats that may be long enough
        longs = repeated_windows(some, window)
        dropped(some)
        # written, so that both sides of the next join come from an exchange and copies of one text can be split
        found = written(marks.select("k1", "k2", F.col("windows").alias("marks")).join(longs, ["k1", "k2"], "left"), "found")
        dropped(marks, longs)
    both = rows.join(found, ["k1", "k2"], "left").select("text", "windows", "marks", *named)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, windows, marks in zip(batch.column("text"), batch.column("windows").to_pylist(), batch.column("marks").to_pylist()):
                body = text.as_buffer().to_pybytes()
                left, removed, spans = kept_bytes(body, np.frombuffer(windows or b"", np.int64).reshape(-1, 2), window)
                marked = int(covered(len(body), np.frombuffer(marks, np.int64).reshape(-1, 2), mark).sum()) if marks else removed
                out.append((len(body), removed, spans, left.decode("utf-8", "ignore") if as_text else left, marked))
            cols = list(zip(*out)) or [[]] * 5
            own = [batch.column(k) for k in named]
            made = [pa.array(c, pa.int64() if i != 3 else pa.string() if as_text else pa.binary()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*own, *made], [*named, "n_bytes", "n_removed", "n_spans", "kept", "n_marked"])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in both.schema if f.name in named)
    out = both.mapInArrow(cut, f"{schema}n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}, n_marked long")
    return out.select(*[F.col(k).alias(c) for k, c in named.items()], "n_bytes", "n_removed", "n_spans", "kept", "n_marked")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_marked")


def brute_force(texts: list[bytes], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, sha256 of the rest) of each text, window by window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] = seen.get(t[i : i + window], 0) + 1
    out = []
    for t in texts:
        at = [(i, i) for i in range(len(t) - window + 1) if seen[t[i : i + window]] > 1]
        left, removed, spans = kept_bytes(t, np.array(at, np.int64).reshape(-1, 2), window)
        out.append((removed, spans, hashlib.sha256(left).hexdigest()))
    return out
