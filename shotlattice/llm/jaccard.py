"""N-gram Jaccard join through prefix trees.

1. Documents with equal sets of word shingles are one class.
2. A set can only be in a link if enough of its n-grams are in another class too. Every n-gram whose hash is in the lower half is counted by classes; a class
   stays a candidate if so many of its counted n-grams are shared that a partner may hold the share that a link takes. This drops no link.
3. The candidates' sets, each in the global order (by the number of sets that have an n-gram, then by hash), are joined in prefix trees: sets with a common
   start share nodes and the overlap counted on them; a subtree is left as soon as its sizes or what is left of both sets cannot reach the required overlap, or all of its sets are in the component already.
   First the blocks are the sets with a common n-gram among their first ones by hash; that finds nearly all components. Then every n-gram of the sets' prefixes,
   the rarest first (two sets in a link have a common n-gram there), whose sets are still in different components makes a block, so no link between components is lost.
4. Components over all links found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, buffers, dropped, hashed_words, mixed, parts_of, shingle_hashes, slices, written
from .graph import Sets, components

WIDTH = 5
PERCENT = 80
#: First n-grams by which the first blocks are made, and the most sets of such a block. Neither bears on the result: the second blocks are exact.
FIRST, BLOCK = 2, 512
CHUNK = 4 << 20


class Node:
    __slots__ = ("seg", "kids", "ends", "least", "most", "longest", "depth", "members")

    def __init__(self, seg, depth):
        self.seg, self.depth = seg, depth
        self.kids, self.ends, self.members = {}, [], []
        self.least, self.most, self.longest = 1 << 62, 0, 0


def trie_links(sets: list[np.ndarray], known: Sets, percent: int = PERCENT, sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join components of ``known`` (updated): pairs (i, j) of ascending sets with Jaccard similarity of at least ``percent`` / 100.

    ``sizes`` are those of the whole sets where members that no other set has were left out. Of the links between two components one is returned, as
    ``known`` holds the rest together.
    """
    if len(sets) < 2:
        return []
    lengths = [len(s) for s in sets]
    sizes = sizes or lengths
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.cumsum([0, *lengths])
    sets = [local[a:b] for a, b in zip(cuts, cuts[1:])]
    mark = np.zeros(int(local.max(initial=-1)) + 1, bool)
    root = Node(local[:0], 0)
    out: list[tuple[int, int]] = []
    both = 100 + percent

    def settled(node: Node, own: int) -> bool:
        m = node.members
        if len(m) > 1:
            m = node.members = list({known.root(i) for i in m}) if len(m) <= 64 else m
        return len(m) == 1 and known.root(m[0]) == own

    for x in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        s, n, length = sets[x], sizes[x], lengths[x]
        mark[s] = True
        stack = [(root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.most * 100 < percent * n or (node.members and settled(node, known.root(x))):
                continue
            rest = length
            if len(node.seg):
                overlap += int(np.count_nonzero(mark[node.seg]))
                rest = length - int(np.searchsorted(s, node.seg[-1], "right"))
            if both * (overlap + min(rest, node.longest - node.depth)) < percent * (n + node.least):
                continue
            for y in node.ends:
                if both * overlap >= percent * (n + sizes[y]) and known.join(x, y):
                    out.append((x, y))
            near = int(s[length - rest]) if rest else -1
            for first, kid in node.kids.items():
                if first != near:
                    stack.append((kid, overlap))
            if near in node.kids:
                stack.append((node.kids[near], overlap))  # the set's own way first: once linked, the rest of the component is left out
        mark[s] = False
        node, at = root, 0
        while True:
            node.least, node.most, node.longest = min(node.least, n), max(node.most, n), max(node.longest, length)
            if not node.members or known.root(node.members[-1]) != known.root(x):
                node.members.append(x)
            if at == length:
                node.ends.append(x)
                break
            kid = node.kids.get(int(s[at]))
            if kid is None:
                leaf = Node(s[at:], length)
                leaf.least, leaf.most, leaf.longest = n, n, length
                leaf.members, leaf.ends = [x], [x]
                node.kids[int(s[at])] = leaf
                break
            m = min(len(kid.seg), length - at)
            differ = np.flatnonzero(kid.seg[:m] != s[at : at + m])
            common = int(differ[0]) if len(differ) else m
            if common < len(kid.seg):
                upper = Node(kid.seg[:common], kid.depth - len(kid.seg) + common)
                upper.least, upper.most, upper.longest, upper.members = kid.least, kid.most, kid.longest, list(kid.members)
                upper.kids[int(kid.seg[common])] = kid
                kid.seg = kid.seg[common:]
                node.kids[int(s[at])] = upper
                kid = upper
            node, at = kid, at + common
    return out


def doc_sets(offsets: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows) of each row's distinct shingles, ascending in a row, and two 64-bit keys of each row's set (0, 0 for the empty set)."""
    n = len(offsets) - 1
    words, of = hashed_words(offsets, data)
    h, r = shingle_hashes(words, of, width, n)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
        h, r = h[new], r[new]
    starts = np.searchsorted(r, np.arange(n + 1))
    add = lambda x: np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
    a, b = add(mixed(h ^ np.uint64(0x243F6A8885A308D3))), add(mixed(h + np.uint64(0x13198A2E03707344)))
    return h, r, a[starts[1:]] - a[starts[:-1]], b[starts[1:]] - b[starts[:-1]]


INFO = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("n", "<i8"), ("half", "<i8"), ("id", "<i8"), ("no_id", "<i8"), ("text", "<i8")])
_LOW = np.uint64(1) << np.uint64(63)


#: Text bytes, and classes, of a task that are counted before anything is sent; an owner of this number stands for several.
HELD, SEVERAL = 8 << 20, 0xFFFF


def _first_of_class(info: np.ndarray) -> np.ndarray:
    """The first row of each class: the smallest id that is not null, then the smallest text hash."""
    info = info[np.lexsort((info["text"], info["id"], info["no_id"], info["k2"], info["k1"]))]
    if len(info):
        info = info[np.concatenate(([True], (info["k1"][1:] != info["k1"][:-1]) | (info["k2"][1:] != info["k2"][:-1])))]
    return info


def _counted(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(part, kind, blob): kind 1 describes documents, kind 2 the first document of each class in a task, kind 0 holds for classes how many counted n-grams are shared.

    A task counts what it has read first. An n-gram that several of its classes have is known to be shared and goes on once, as does a class: neither copies nor an n-gram of
    all documents make a large group. A class that has copies in several tasks may have an n-gram counted for each, which only makes it a candidate more easily.
    """
    parts = parts_of(rows)

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        state = {"spread": TaskContext.get().partitionId(), "size": 0, "classes": 0}
        firsts, tokens, owners = [], [], []

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["part", "kind", "blob"])

        def sent():
            info = _first_of_class(np.concatenate(firsts))
            part = (info["k1"] % np.uint64(parts)).astype(np.int64)
            out = [(p, 2, info[part == p].tobytes()) for p in np.unique(part).tolist()]
            t = np.concatenate(tokens)
            if len(t):
                keys, number = np.unique(np.concatenate([k for k, _ in owners]), return_inverse=True)
                before = np.cumsum([0, *(len(k) for k, _ in owners)])
                own = np.concatenate([number[b + o] for b, (_, o) in zip(before, owners)])
                # 48 bits of the hash and 16 of the class: a shorter hash can only make an n-gram look shared
                packed = np.unique(((t >> np.uint64(16)) << np.uint64(16)) | own.astype(np.uint64))
                t = packed >> np.uint64(16)
                same = t[1:] == t[:-1]
                several = np.concatenate((same, [False])) | np.concatenate(([False], same))
                n = np.bincount((packed[several] & np.uint64(SEVERAL)).astype(np.int64), minlength=len(keys))
                part = (keys % np.uint64(parts)).astype(np.int64)
                out += [(p, 3, keys[m].tobytes() + n[m].astype(np.uint64).tobytes()) for p in np.unique(part[n > 0]).tolist() for m in [(part == p) & (n > 0)]]
                once = np.concatenate(([True], ~same))  # of several the first stands for all
                packed = np.where(several, packed | np.uint64(SEVERAL), packed)[once]
                lots = [((1 << 63) * p // parts) >> 16 << 16 for p in range(parts + 1)]
                cuts = np.searchsorted(packed, np.array([min(x, (1 << 64) - 1) for x in lots], np.uint64))
                cuts[-1] = len(packed)
                out += [(p, 0, np.uint64(len(keys)).tobytes() + keys.tobytes() + packed[x:y].tobytes()) for p, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            firsts.clear(), tokens.clear(), owners.clear()
            state["size"] = state["classes"] = 0
            return batch_of(out)

        for batch in batches:
            offsets, data = buffers(batch.column("text"))
            ids, hashes = batch.column("doc_id"), batch.column("hash").to_numpy()
            no_id = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for x, y in slices(offsets, CHUNK):
                for a in range(x, y, SEVERAL // 2):
                    b = min(y, a + SEVERAL // 2)
                    h, r, k1, k2 = doc_sets(offsets[a : b + 1], data, width)
                    n = np.bincount(r, minlength=b - a)
                    low = h < _LOW
                    info = np.zeros(b - a, INFO)
                    for name, v in (("k1", k1), ("k2", k2), ("n", n), ("half", np.bincount(r[low], minlength=b - a)), ("id", ids[a:b]), ("no_id", no_id[a:b]), ("text", hashes[a:b])):
                        info[name] = v
                    state["spread"] += 1
                    yield batch_of([(state["spread"] % parts, 1, info.tobytes())])
                    if state["classes"] + b - a >= SEVERAL:
                        yield sent()
                    first = _first_of_class(info[n > 0])
                    keys, of = np.unique(k1, return_inverse=True)
                    firsts.append(first), tokens.append(h[low]), owners.append((keys, of[r[low]].astype(np.int32)))
                    state["classes"] += len(first)
                    state["size"] += int(offsets[b] - offsets[a])
                    if state["size"] >= HELD:
                        yield sent()
        if firsts:
            yield sent()

    def count(key, table):
        import pyarrow as pa

        blobs = table.column("blob").to_pylist()
        kinds = table.column("kind").to_pylist()
        out = [(key[0].as_py(), k % 3, b) for b, k in zip(blobs, kinds) if k]
        tokens, owners, several = [], [], []
        for b, k in zip(blobs, kinds):
            if k == 0:
                x = np.frombuffer(b, np.uint64)
                keys, packed = x[1 : 1 + int(x[0])], x[1 + int(x[0]) :]
                own = (packed & np.uint64(SEVERAL)).astype(np.int64)
                tokens.append(packed >> np.uint64(16)), several.append(own == SEVERAL)
                owners.append(keys[np.where(own == SEVERAL, 0, own)])
        if tokens:
            t, o, m = np.concatenate(tokens), np.concatenate(owners), np.concatenate(several)
            del tokens, owners, several
            order = np.lexsort((o, m, t))
            t, o, m = t[order], o[order], m[order]
            first = np.concatenate(([True], (t[1:] != t[:-1]) | (o[1:] != o[:-1]) | (m[1:] != m[:-1])))  # an n-gram once for each class
            t, o, m = t[first], o[first], m[first]
            same = t[1:] == t[:-1]
            shared = (np.concatenate((same, [False])) | np.concatenate(([False], same))) & ~m
            owner, n = np.unique(o[shared], return_counts=True)
            part = (owner % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part).tolist():
                mine = part == p
                out.append((p, 0, owner[mine].tobytes() + n[mine].astype(np.uint64).tobytes()))
        return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "kind": pa.array([o[1] for o in out], pa.int32()), "blob": pa.array([o[2] for o in out], pa.binary())})

    schema = "part int, kind int, blob binary"
    return rows.mapInArrow(gather, schema).groupBy("part").applyInArrow(count, schema)


def _classes(counted: DataFrame, percent: int) -> DataFrame:
    """One row per class of equal sets: k1, k2, n, the first row of it (id, text hash) and whether it may be in a link."""

    def settle(key, table):
        import pyarrow as pa

        blobs, kinds = table.column("blob").to_pylist(), table.column("kind").to_pylist()
        info = _first_of_class(np.concatenate([np.frombuffer(b, INFO) for b, k in zip(blobs, kinds) if k == 2] or [np.zeros(0, INFO)]))
        owners = [np.frombuffer(b, np.uint64).reshape(2, -1) for b, k in zip(blobs, kinds) if k == 0]
        found = np.zeros(len(info), np.int64)
        if owners and len(info):
            keys, at = np.unique(np.concatenate([o[0] for o in owners]), return_inverse=True)
            total = np.bincount(at, np.concatenate([o[1] for o in owners]).astype(float)).astype(np.int64)
            place = np.minimum(np.searchsorted(keys, info["k1"]), len(keys) - 1)
            found = np.where(keys[place] == info["k1"], total[place], 0)
        need = -(-percent * info["n"] // 100)  # a partner holds at least so many of the set
        able = found >= info["half"] - (info["n"] - need)
        cols = {c: pa.array(info[c].view(np.int64) if c[0] == "k" else info[c], pa.int64()) for c in ("k1", "k2", "n", "text")}
        ids = pa.array(info["id"], pa.int64(), mask=info["no_id"] > 0)
        return pa.table({"k1": cols["k1"], "k2": cols["k2"], "n": cols["n"], "first": ids, "text_hash": cols["text"], "candidate": pa.array(able)})

    return counted.where("kind <> 1").groupBy("part").applyInArrow(settle, "k1 long, k2 long, n long, first long, text_hash long, candidate boolean")


#: A fixed bitmap of candidates' text hashes, 4 MB: it only saves reading others; whether a set is a candidate's is decided by a join.
BITS, SEGMENT = 25, 19


def _bitmap(classes: DataFrame) -> np.ndarray:
    def mark(batches):
        import pyarrow as pa

        found = np.zeros(1 << BITS, bool)
        for batch in batches:
            found[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - BITS)] = True
        parts = [(i, np.packbits(x).tobytes()) for i, x in enumerate(found.reshape(-1, 1 << SEGMENT)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["segment", "bits"])

    def either(key, table):
        import pyarrow as pa

        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = classes.where("candidate").select("text_hash").mapInArrow(mark, "segment int, bits binary").groupBy("segment").applyInArrow(either, "segment int, bits binary")
    out = np.zeros(1 << BITS - 3, np.uint8)
    for r in rows.collect():  # at most 4 MB, whatever the corpus
        out[r.segment << SEGMENT - 3 : (r.segment + 1) << SEGMENT - 3] = np.frombuffer(r.bits, np.uint8)
    return out


def _chunks(rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Sets of the candidate classes, many to a row: chunk, k1, k2, cuts, tokens (64-bit hashes, set by set)."""
    bitmap = rows.sparkSession.sparkContext.broadcast(_bitmap(classes))

    def make(batches):
        import pyarrow as pa

        bits = bitmap.value
        for batch in batches:
            at = batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - BITS)
            own = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
            offsets, data = buffers(batch.column("text").filter(pa.array(own > 0)))
            ids = batch.column("doc_id").filter(pa.array(own > 0))
            for a, b in slices(offsets, CHUNK):
                h, r, k1, k2 = doc_sets(offsets[a : b + 1], data, width)
                cuts = np.searchsorted(r, np.arange(b - a + 1))
                blobs = [h[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), ids[a:b], pa.array(blobs, pa.binary())], ["k1", "k2", "doc_id", "tokens"])

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number, k, t, held = TaskContext.get().partitionId() << 24, [], [], 0

        def row():
            cuts = np.cumsum([0, *(len(x) // 8 for x in t)]).astype(np.int64)
            k1, k2 = (np.array([x[i] for x in k], np.int64).tobytes() for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((number, pa.int64()), (k1, pa.binary()), (k2, pa.binary()), (cuts.tobytes(), pa.binary()), (b"".join(t), pa.binary()))], ["chunk", "k1", "k2", "cuts", "tokens"])

        for batch in batches:
            for a, b, tokens in zip(*(batch.column(i).to_pylist() for i in range(3))):
                k.append((a, b)), t.append(tokens)
                held += len(tokens)
                if held >= CHUNK or len(t) == 1 << 16:
                    yield row()
                    number, held = number + 1, 0
                    k.clear(), t.clear()
        if t:
            yield row()

    made = rows.select("text", "hash", "doc_id").mapInArrow(make, "k1 long, k2 long, doc_id long, tokens binary")
    own = classes.where("candidate").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "first")
    # a class's copies stay behind: only its first row's set goes on
    made = made.join(own, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    made = made.dropDuplicates(["k1", "k2"]).select("k1", "k2", "tokens")
    return made.mapInArrow(gather, "chunk long, k1 binary, k2 binary, cuts binary, tokens binary")


#: How many sets an n-gram is in, by class: below 2, 4, 8, 16, 64, 256, 1024, and more.
STEPS = (2, 4, 8, 16, 64, 256, 1024)
ALONE = np.uint64(1) << np.uint64(61)


def _packed(tokens: bytes, cuts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(48 bits of hash, 16 of row) ascending, and in that order hashes and rows; and the number of sets."""
    h, cuts = np.frombuffer(tokens, np.uint64), np.frombuffer(cuts, np.int64)
    rows = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    packed = ((h >> np.uint64(16)) << np.uint64(16)) | rows.astype(np.uint64)
    order = np.argsort(packed, kind="stable")
    return packed[order], h[order], rows[order], cuts


def _ordered(chunks: DataFrame) -> DataFrame:
    """(cid, k1, k2, n, tokens): each set in the global order, the n-grams of the fewest sets first; a token is 3 bits of that class and 61 of the hash.

    The n-grams that no other set has would come first of all and are left out; ``n`` is the size of the whole set. The class is the same wherever an n-gram stands, so this is one order for all sets.
    """
    parts = parts_of(chunks)
    lots = np.array([((1 << 64) * p // parts) >> 16 << 16 for p in range(parts)], np.uint64)

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for chunk, cuts, tokens in zip(*(batch.column(c).to_pylist() for c in ("chunk", "cuts", "tokens"))):
                packed = _packed(tokens, cuts)[0]
                at = [*np.searchsorted(packed, lots).tolist(), len(packed)]
                out += [(p, chunk, packed[x:y].tobytes()) for p, (x, y) in enumerate(zip(at, at[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["part", "chunk", "blob"])

    def answer(key, table):
        import pyarrow as pa

        asked = [np.frombuffer(b, np.uint64) >> np.uint64(16) for b in table.column("blob").to_pylist()]
        _, at, n = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        found = np.searchsorted(STEPS, n, "right").astype(np.uint8)[at]
        cuts = np.cumsum([0, *map(len, asked)])
        blobs = [pa.compress(found[x:y].tobytes(), codec="zstd", asbytes=True) for x, y in zip(cuts, cuts[1:])]
        sizes = np.diff(cuts)
        none = pa.nulls(len(blobs), pa.binary())
        return pa.table({"chunk": table.column("chunk"), "part": pa.array([key[0].as_py()] * len(blobs), pa.int32()), "n": pa.array(sizes, pa.int64()), "tokens": pa.array(blobs, pa.binary()), "k1": none, "k2": none, "cuts": none})

    def order(key, table):
        import pyarrow as pa

        rows = table.to_pylist()
        own = next(r for r in rows if r["part"] < 0)
        classes = [np.frombuffer(pa.decompress(r["tokens"], decompressed_size=r["n"], codec="zstd", asbytes=True), np.uint8) for r in sorted(rows, key=lambda r: r["part"]) if r["part"] >= 0]
        _, h, of, cuts = _packed(own["tokens"], own["cuts"])
        t = (np.concatenate(classes).astype(np.uint64) << np.uint64(61)) | (h >> np.uint64(3)) if classes else h
        t, of = (x[keep] for keep in [t >= ALONE] for x in (t, of))
        order = np.lexsort((t, of))
        t, at = t[order], np.searchsorted(of[order], np.arange(len(cuts)))
        k1, k2 = (np.frombuffer(own[k], np.int64) for k in ("k1", "k2"))
        cid = (key[0].as_py() << 16) + np.arange(len(k1), dtype=np.int64)
        return pa.table({"cid": cid, "k1": k1, "k2": k2, "n": np.diff(cuts), "tokens": pa.array([t[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())})

    asked = chunks.mapInArrow(ask, "part int, chunk long, blob binary")
    answers = asked.groupBy("part").applyInArrow(answer, "chunk long, part int, n long, tokens binary, k1 binary, k2 binary, cuts binary")
    own = chunks.select("chunk", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("n"), "tokens", "k1", "k2", "cuts")
    return answers.unionByName(own).groupBy("chunk").applyInArrow(order, "cid long, k1 long, k2 long, n long, tokens binary")


def _keys(sets: DataFrame, percent: int, first: int | None) -> DataFrame:
    """(key, cid, n, place): the ``first`` n-grams by hash of each set, or those of its prefix, with their places in the whole ordered set."""

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            cid, n, keys, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), [], []
            for blob, size in zip(batch.column(2).to_pylist(), n.tolist()):
                t = np.frombuffer(blob, np.uint64)
                before = size - len(t)
                at = np.argsort(t & (ALONE - np.uint64(1)))[:first] if first else np.arange(min(len(t), max(0, size - -(-percent * size // 100) + 1 - before)))
                keys.append(t[at]), places.append(at + before)
            many = [len(t) for t in keys]
            cols = [np.concatenate(keys).view(np.int64) if keys else n[:0], np.repeat(cid, many), np.repeat(n, many), np.concatenate(places) if places else n[:0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "cid", "n", "place"])

    return sets.select("cid", "n", "tokens").mapInArrow(take, "key long, cid long, n long, place long")


def _possible(prefixes: DataFrame, percent: int) -> DataFrame:
    """Of (key, cid, comp, n, place) the rows that a set of another component could be linked to over their key, by sizes and what is left of both sets.

    A key's rows are dealt into tiles of two lots of ``BLOCK`` rows or fewer, so no task holds more of them; the rows of a tile come out once.
    """
    lots = parts_of(prefixes) * 4

    def test(_, table):
        import pyarrow as pa

        key, sub, n, comp, place = (table.column(c).to_numpy() for c in ("key", "sub", "n", "comp", "place"))
        order = np.lexsort((sub, key))
        cuts = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (sub[order][1:] != sub[order][:-1]), [True])))
        ok = np.zeros(len(key), bool)
        for x, y in zip(cuts, cuts[1:]):
            i = order[x:y]
            size, left, own = n[i], n[i] - place[i], comp[i]
            # all before the places may differ: the overlap is at most what is left of either
            ok[i] = ((own[:, None] != own) & ((100 + percent) * np.minimum(left[:, None], left) >= percent * (size[:, None] + size))).any(axis=1)
        return table.select(["key", "sub", "cid", "comp"]).filter(pa.array(ok))

    return _tiles(prefixes).withColumn("lot", F.pmod(F.xxhash64("key", "sub"), F.lit(lots))).groupBy("lot").applyInArrow(test, "key long, sub long, cid long, comp long")


def _tiles(rows: DataFrame) -> DataFrame:
    """Rows of keys that stand in more than one component, with the number ``sub`` of a tile: each pair of a key's rows meets in a tile."""
    split = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select("key", "m")
    dealt = rows.join(split, "key").withColumn("deal", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("deal")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    sub = (F.least("own", "other") * F.col("deal") + F.greatest("own", "other")).cast("long")
    return dealt.withColumn("sub", sub).drop("deal", "own", "other", "m")


def _joined(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within blocks; columns lot, key, sub, cid, comp, n, tokens. In the trees the n-grams of the most sets come first: they are shared."""

    def join(_, table):
        import pyarrow as pa

        key, sub, cid, comp, n = (table.column(c).to_numpy() for c in ("key", "sub", "cid", "comp", "n"))
        tokens = table.column("tokens")
        order = np.lexsort((cid, sub, key))
        cuts = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (sub[order][1:] != sub[order][:-1]), [True])))
        a, b = [], []
        for x, y in zip(cuts, cuts[1:]):
            mine = order[x:y]
            known, seen = Sets(len(mine)), {}
            for i, c in enumerate(comp[mine].tolist()):
                known.join(seen.setdefault(c, i), i)
            sets = [np.frombuffer(tokens[int(m)].as_py(), np.uint64) for m in mine]
            sets = [~t[::-1] for t in sets]
            for i, j in trie_links(sets, known, percent, n[mine].tolist()):
                a.append(cid[mine[i]]), b.append(cid[mine[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return blocks.groupBy("lot").applyInArrow(join, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, k1, k2 (the class of equal sets; 0, 0 for the empty set), text_hash.

    A text without words, or null, has an empty set and links with nothing. Rows with a null id take part; ``component_id`` is the smallest id that is not null,
    and null if there is none. Repeated rows link with one another. Texts of any length are taken whole, in parts where their sets
    are long. Ties need no rule: links are exact, and a component's id is a minimum. An empty table gives an empty result. Other columns are not read.
    """
    lots = parts_of(docs) * 4
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    counted = written(_counted(rows, width, percent), "counted")
    classes = written(_classes(counted, percent), "classes")
    chunks = written(_chunks(rows, classes, width), "chunks")
    sets = written(_ordered(chunks), "sets")
    dropped(chunks)

    keys = written(_keys(sets, percent, FIRST), "keys")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = keys.join(often, "key").withColumn("sub", F.pmod(F.xxhash64("cid", "key"), F.ceil(F.col("m") / F.lit(BLOCK)))).drop("n", "place")
    blocks = blocks.join(sets.select("cid", "n", "tokens"), "cid").select(F.pmod(F.xxhash64("key", "sub"), F.lit(lots)).alias("lot"), "key", "sub", "cid", F.col("cid").alias("comp"), "n", "tokens")
    links = written(_joined(blocks, percent), "links")
    comps = written(components(links), "components")

    prefixes = _keys(sets, percent, None).join(comps, F.col("cid") == F.col("node"), "left").select("key", "cid", "n", "place", F.coalesce("component", "cid").alias("comp"))
    prefixes = written(prefixes, "prefixes")
    tiles = written(_possible(prefixes, percent), "tiles")
    tiles = tiles.join(sets.select("cid", "n", "tokens"), "cid").select(F.pmod(F.xxhash64("key", "sub"), F.lit(lots)).alias("lot"), "key", "sub", "cid", "comp", "n", "tokens")
    more = written(_joined(tiles, percent), "links")
    if more.isEmpty():
        last = comps
    else:
        last = written(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    ranked = sets.select("cid", "k1", "k2").join(last, F.col("cid") == F.col("node")).select("k1", "k2", "component")
    ranked = ranked.join(classes.select("k1", "k2", "first"), ["k1", "k2"])
    least = ranked.groupBy("component").agg(F.min("first").alias("least"))
    of_class = ranked.join(least, "component").select("k1", "k2", "least")
    of_class = written(classes.select("k1", "k2", "first").join(of_class, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("least", "first").alias("component_id")), "component-ids")

    def described(batches):
        import pyarrow as pa

        for batch in batches:
            info = np.concatenate([np.frombuffer(b, INFO) for b in batch.column(0).to_pylist()] or [np.zeros(0, INFO)])
            ids = pa.array(info["id"], pa.int64(), mask=info["no_id"] > 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(info["n"]), pa.array(info["k1"].view(np.int64)), pa.array(info["k2"].view(np.int64)), pa.array(info["text"])], ["doc_id", "n_shingles", "k1", "k2", "text_hash"])

    listed = counted.where("kind = 1").select("blob").mapInArrow(described, "doc_id long, n_shingles long, k1 long, k2 long, text_hash long")
    out = listed.join(of_class, ["k1", "k2"], "left")
    dropped(keys, prefixes, sets)
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "k1", "k2", "text_hash")


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their components: the smallest id of each, one row of it; and every row without words.

    A component whose ids are all null keeps one row of each class of equal sets.
    """
    found = jaccard_components(docs, width, percent).where("n_shingles > 0")
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("k1")).alias("k1"), F.when(F.col("component_id").isNull(), F.col("k2")).alias("k2")]
    first = found.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    first = first.select("first.doc_id", "first.text_hash")
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = written(first.join(rows, first.doc_id.eqNullSafe(rows.doc_id) & (first.text_hash == rows.text_hash)).select(first.doc_id, first.text_hash, "n"), "first")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash_"), F.rlike(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE}]")).alias("words_"))
    same = keyed.id_.eqNullSafe(first.doc_id) & (keyed.hash_ == first.text_hash)
    once = keyed.where("words_").join(first.where("n = 1"), same, "left_semi").select("row.*")
    repeated = keyed.where("words_").join(first.where("n > 1"), same, "left_semi").dropDuplicates(["id_", "hash_"]).select("row.*")
    return once.unionByName(keyed.where("not words_").select("row.*")).unionByName(repeated)
