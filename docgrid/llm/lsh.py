"""Near-duplicate linking: band keys dealt to buckets, pairs with near sketches, exact verification, union-find."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, freed, frugal, saved, spread_join

#: Multipliers and shifts of a 64-bit finaliser (fixed values).
MIX_A, MIX_B, MIX_C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A pseudorandom 64-bit value for each value."""
    x = x + MIX_C
    x = (x ^ (x >> S30)) * MIX_A
    x = (x ^ (x >> S27)) * MIX_B
    return x ^ (x >> S31)


#: Texts of one key that are paired with each other at once; more are split by their sketches, up to SPLIT of them, or linked to one of them first.
SMALL, SPLIT = 16, 2048
#: Entries that a task sorts before it hands them on, and texts of one key among them from which on only one of them is handed on.
CHUNK, HOT = 1 << 18, 64
#: Bytes of input for one bucket of entries, and how many buckets there may be.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 2 << 20, 8, 1 << 20
#: Members and characters of a block; a task compares two blocks.
BLOCK, BLOCK_CHARS = 512, 4_000_000
#: Characters of texts that are shingled at once; a longer text is taken alone.
SLICE_CHARS = 400_000
#: Bits of a sketch; the lowest bit of its word says that the text stands for others of its key.
SKETCH_BITS = 63
#: One text under one key, within a bucket.
ENTRY = np.dtype([("key", "<u4"), ("id", "<i8"), ("sketch", "<u8")])
#: One text b of a key with many, a being the text it may be near, or b itself, and b's sketch.
MEMBER = np.dtype([("key", "<i8"), ("a", "<i8"), ("b", "<i8"), ("sketch", "<i8")])
U = np.uint64


def farthest(least: float, miss: float = 1e-3) -> int:
    """Bits in which two sketches may differ: a pair of similarity `least` differs in more with probability `miss` at most."""
    p, within, d = (1 - least) / 2, 0.0, -1
    while within < 1 - miss:
        d += 1
        within += comb(SKETCH_BITS, d) * p**d * (1 - p) ** (SKETCH_BITS - d)
    return d


def sketches(bits: np.ndarray) -> np.ndarray:
    """The sketch of each row of SKETCH_BITS zeros and ones, one from each register of a signature."""
    word = np.zeros(len(bits), dtype=U)
    for i in range(SKETCH_BITS):
        word |= bits[:, i].astype(U) << U(i + 1)
    return word


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y) >> U(1))


class Dealer:
    """Entries of a task's texts, sorted by bucket and key in chunks."""

    def __init__(self, buckets: int, far: int):
        self.buckets, self.far = buckets, far
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.turn = TaskContext.get().partitionId() if TaskContext.get() else 0

    def add(self, ids: np.ndarray, keys: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """ids: int64; keys: a row of uint64 band keys for each; sketch: uint64."""
        self.parts.append((ids, keys, sketch))
        self.size += keys.size
        if self.size >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, entries, members) for each bucket that has some."""
        if not self.size:
            return
        ids, keys, sketch = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        ids, at = np.unique(ids, return_index=True)
        keys, sketch = keys[at], sketch[at]
        bands = keys.shape[1]
        flat = keys.ravel()
        place = ((flat >> U(32)) % U(self.buckets) << U(32)) | (flat & U(0xFFFFFFFF))
        order = np.argsort(place)
        place, text = place[order], order // bands
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        size = np.diff(np.append(first, len(place)))
        stay = np.ones(len(place), dtype=bool)
        flag = np.zeros(len(place), dtype=U)
        many = []
        for g in np.flatnonzero(size > HOT):
            run = slice(first[g] + 1, first[g] + size[g])
            text[first[g] : first[g] + size[g]].sort()  # texts are numbered by their ids: the smallest one goes on
            head = text[first[g]]
            stay[run], flag[first[g]] = False, 1
            m = np.empty(size[g] - 1, dtype=MEMBER)
            m["key"], m["b"] = _whole(place[first[g]]), ids[text[run]]
            m["a"] = np.where(_apart(sketch[text[run]], sketch[head]) <= self.far, ids[head], m["b"])
            m["sketch"] = sketch[text[run]].view(np.int64)
            many.append(m.tobytes())
        place, text, flag = place[stay], text[stay], flag[stay]
        out = np.empty(len(place), dtype=ENTRY)
        out["key"], out["id"], out["sketch"] = (place & U(0xFFFFFFFF)).astype(np.uint32), ids[text], sketch[text] | flag
        bucket = (place >> U(32)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(place)]):
            yield int(bucket[a]), out[a:b].tobytes(), b""
        if many:
            self.turn += 1
            yield self.turn % self.buckets, b"", b"".join(many)


def _whole(place: np.ndarray) -> np.ndarray:
    """The key's name outside its bucket."""
    return mixed(np.atleast_1d(place)).view(np.int64)


def paired(bucket: int, e: np.ndarray, far: int) -> np.ndarray:
    """MEMBER rows of a bucket's entries: pairs (key 0) whose sketches are near, and the members of keys with many texts."""
    order = np.argsort(e["key"])  # most keys have one entry, which matters only if it stands for others
    key = e["key"][order]
    same = key[1:] == key[:-1]
    e = e[order[np.concatenate((same, [False])) | np.concatenate(([False], same)) | (e["sketch"][order] & U(1)).astype(bool)]]
    if not len(e):
        return np.empty(0, dtype=MEMBER)
    e = e[np.lexsort((e["id"], e["key"]))]
    same = np.concatenate(([False], (e["key"][1:] == e["key"][:-1]) & (e["id"][1:] == e["id"][:-1])))
    hot = np.unique(e["key"][(e["sketch"] & U(1)).astype(bool)])
    e = e[~same]
    first = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1])))
    size = np.diff(np.append(first, len(e)))
    flagged = np.isin(e["key"][first], hot)
    out = []
    few = np.repeat((size > 1) & (size <= SMALL) & ~flagged, size)
    ids, sketch, key = e["id"][few], e["sketch"][few], e["key"][few]
    for s in range(1, SMALL):
        both = np.flatnonzero(key[s:] == key[:-s])
        if not len(both):
            break
        both = both[_apart(sketch[both], sketch[both + s]) <= far]
        out.append(_rows(0, ids[both], ids[both + s]))
    for g in np.flatnonzero((size > SMALL) | flagged):
        run = slice(first[g], first[g] + size[g])
        ids, sketch = e["id"][run], e["sketch"][run]
        name = U(bucket) << U(32) | U(e["key"][first[g]])
        if flagged[g] or size[g] > SPLIT:
            out.append(_star(name, ids, sketch, far))
            continue
        near = _apart(sketch[:, None], sketch[None, :]) <= far
        label = np.arange(len(ids))
        while True:  # texts whose sketches are near, directly or by way of others
            low = np.where(near, label[None, :], len(ids)).min(axis=1)
            if (low == label).all():
                break
            label = low
        for head in np.flatnonzero(np.bincount(label, minlength=len(ids)) > 1):
            own = np.flatnonzero(label == head)
            if len(own) > SMALL:
                out.append(_star(name ^ mixed(np.array([head], dtype=U))[0], ids[own], sketch[own], far))
            else:
                i, j = np.nonzero(np.triu(near[np.ix_(own, own)], 1))
                out.append(_rows(0, ids[own[i]], ids[own[j]]))
    return np.concatenate(out) if out else np.empty(0, dtype=MEMBER)


def _rows(key: int, a: np.ndarray, b: np.ndarray, sketch: np.ndarray | None = None) -> np.ndarray:
    out = np.empty(len(a), dtype=MEMBER)
    out["key"], out["a"], out["b"], out["sketch"] = key, a, b, 0 if sketch is None else sketch.view(np.int64)
    return out


def _star(name: np.uint64, ids: np.ndarray, sketch: np.ndarray, far: int) -> np.ndarray:
    """Members of a key with many texts, those whose sketches are near the first one's as pairs with it."""
    return _rows(_whole(name)[0], np.where(_apart(sketch, sketch[0]) <= far, ids[0], ids), ids, np.ascontiguousarray(sketch))


#: What a batch of rows gives: ids, band keys and sketches, and rows to be passed on as they are.
Signed = tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame | None]


def candidates(rows: DataFrame, signed: Callable[[pd.DataFrame], Iterator[Signed]], least: float, aside: str = "") -> DataFrame:
    """``key, a, b, sketch``: pairs (a, b) of ids to be verified (key 0), and with a key, members b of keys with many texts.

    Entries travel in blobs, one for each chunk and bucket, and what meets in a
    bucket is sorted there; texts that meet under a key are paired if their
    sketches are near enough for a similarity of `least`.  Of HOT or more texts
    of one key in a chunk, one goes on for all, so a bucket holds no key a task
    has many of.  aside: schema of rows of whole numbers that `signed` gives besides,
    which come out with nulls for the other columns; so one pass over the texts serves for both.
    """
    found = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(max(found // BUCKET_BYTES, LEAST_BUCKETS), MOST_BUCKETS) if found < 1 << 60 else 1024
    far = farthest(least)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealer = Dealer(buckets, far)
        table = lambda made: pd.DataFrame(made, columns=["bucket", "entries", "members"]).assign(aside=b"")
        for b in batches:
            others = []
            for *part, other in signed(b):
                if other is not None and len(other):
                    others.append(other)
                yield table(dealer.add(*part))
            if others:
                dealer.turn += 1
                yield table([(dealer.turn % buckets, b"", b"")]).assign(aside=pickle.dumps(pd.concat(others)))
        yield table(dealer.flush())

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        freed()
        own = paired(int(g["bucket"].iloc[0]), np.frombuffer(b"".join(g["entries"]), dtype=ENTRY), far)
        every = np.concatenate((own, np.frombuffer(b"".join(g["members"]), dtype=MEMBER)))
        made = pd.DataFrame({c: every[c] for c in MEMBER.names})
        if not aside:
            return made
        parts = [made, *(pickle.loads(x) for x in g["aside"] if x)]  # nullable whole numbers throughout: floats would round ids
        return pd.concat([pd.DataFrame({c: p[c].astype("Int64") if c in p else pd.array([pd.NA] * len(p), dtype="Int64") for c in names}) for p in parts])

    schema = "key long, a long, b long, sketch long" + (f", {aside}" if aside else "")
    names = [c.split()[0] for c in schema.split(",")]
    dealt = rows.mapInPandas(frugal(deal), "bucket int, entries binary, members binary, aside binary")
    return dealt.groupBy("bucket").applyInPandas(meet, schema)


def linked(
    found: DataFrame,
    texts: Callable[[DataFrame, int], DataFrame],
    bags: Callable[[list[str]], Segments],
    counted: bool,
    least: float,
    hold: bool = False,
) -> DataFrame:
    """``node, component`` of the texts that have a near duplicate.

    found: what :func:`candidates` gives, as a table.  texts: ``id, text`` of the ids asked
    for, once each, and maybe of a few others; it gets the ids, with repeats, and
    about how many they are.  bags: shingles of texts, compared as multisets if
    counted, near from a Jaccard similarity of `least`.  hold: texts are short, so
    all that are needed are kept as a table, and blocks are sent texts, not their
    shingles.

    Pairs are verified.  Of a key with many texts each was paired with one of
    them only, which brings the members of dense groups into few components;
    where such a key's members are in different components afterwards, they are
    looked at again: few by pairs, more in pairs of blocks, whose shingles are
    compared in one task that returns a spanning forest of the links it finds.
    So no key is held in one place, no group is multiplied out into pairs, and
    no component misses a link that its keys hold.
    """
    pairs = saved(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    members = found.where("key <> 0").groupBy("key", F.col("b").alias("id")).agg(F.min("sketch").alias("sketch"))
    none = members.isEmpty()
    if hold:
        ids = both_ends(pairs).unionByName(members.select("id"))
        kept = saved(texts(ids, ids.count()), "texts")
        texts = lambda ids, n: kept.join(ids.distinct(), "id", "left_semi")
    links = saved(_verified(pairs, texts, bags, counted, least), "links")
    comp = components(links)
    dropped(pairs, links)
    if none:
        return comp
    known = members.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = saved(known, "members")
    mix = known.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key", "n")
    open_ = saved(spread_join(known, mix, "key", mix, known.count()), "open")
    some = open_.where(F.col("n") <= SMALL)
    x = some.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("sketch").alias("sa"))
    y = some.select("key", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("sketch").alias("sb"))
    near = F.bit_count(F.shiftrightunsigned(F.col("sa").bitwiseXOR(F.col("sb")), 1)) <= farthest(least)
    rest = saved(x.join(y, "key").where("a < b and ca <> cb").where(near).select("a", "b").distinct(), "pairs")
    more = saved(_verified(rest, texts, bags, counted, least).unionByName(_in_blocks(open_.where(F.col("n") > SMALL), texts, bags, counted, least, hold)), "links")
    if not more.isEmpty():
        first, comp = comp, components(comp.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
        dropped(first)
    dropped(known, open_, rest, more, *([kept] if hold else []))
    return comp


def _verified(pairs: DataFrame, texts: Callable, bags: Callable, counted: bool, least: float) -> DataFrame:
    """Pairs (a, b) whose texts are near."""
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    known = texts(both_ends(pairs), 2 * n)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices((batch["left"].str.len() + batch["right"].str.len()).to_numpy()):
                b = batch.iloc[part]
                yield b.loc[similar(b["left"].tolist(), b["right"].tolist(), bags, counted, least), ["a", "b"]]

    per = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n"))
    # by b first: rows then come by a, so that a text of many pairs is shingled once a batch
    both = spread_join(pairs, known.select(F.col("id").alias("b"), F.col("text").alias("right")), "b", per("b"), n)
    both = spread_join(both, known.select(F.col("id").alias("a"), F.col("text").alias("left")), "a", per("a"), n, by=["b"])
    return both.select("a", "b", "left", "right").mapInPandas(frugal(verify), "a long, b long")


def slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of texts of SLICE_CHARS characters at most, or of one longer text."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > SLICE_CHARS:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def both_ends(pairs: DataFrame) -> DataFrame:
    """``id``: the ends of pairs (a, b), with repeats."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"))


def similar(left: list[str], right: list[str], bags: Callable, counted: bool, least: float) -> np.ndarray:
    """Which pairs of texts have a Jaccard similarity of `least` or more."""
    place: dict[str, int] = {}
    a = [place.setdefault(t, len(place)) for t in left]
    b = [place.setdefault(t, len(place)) for t in right]
    own = bags(list(place))
    return np.array([own.overlap(i, j, counted) >= least for i, j in zip(a, b)], dtype=bool)


def _dealt(members: DataFrame, sized: DataFrame, count: int) -> DataFrame:
    """members with their ``block`` and, once for each block ``o`` of their key that they meet; sized: members with the size of their text.

    Members of a key's largest component needn't meet each other: they have
    blocks of their own, after the others', and meet those only.
    """
    per = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    per = per.groupBy("key").agg(F.max(F.struct("n", "component", "chars")).alias("most"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    blocks = lambda n, chars: F.ceil(F.greatest(n / BLOCK, chars / BLOCK_CHARS)).cast("int")
    rest = blocks(F.col("n") - F.col("most.n"), F.col("chars") - F.col("most.chars"))
    per = per.select("key", "n", F.col("most.component").alias("main"), blocks(F.col("most.n"), F.col("most.chars")).alias("mains"), rest.alias("rest"))
    dealt = spread_join(members.drop("n"), per.drop("n"), "key", per.select("key", "n"), count)
    own, place = F.col("component") == F.col("main"), F.xxhash64("id")
    dealt = dealt.withColumn("block", F.when(own, F.col("rest") + F.pmod(place, "mains")).otherwise(F.pmod(place, "rest")).cast("int"))
    return dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(own, F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)))


def _in_blocks(members: DataFrame, texts: Callable, bags: Callable, counted: bool, least: float, short: bool) -> DataFrame:
    """Links (a, b) that join the components of keys (key, id, sketch, component, n), all members of a key compared; short texts are shingled where they are compared."""
    far = farthest(least)
    count = members.count()
    if not count:
        return members.select(F.col("id").alias("a"), F.col("id").alias("b"))

    def profiles(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part in slices(b["text"].str.len().to_numpy()):
            own = bags(b["text"].iloc[part].tolist())
            yield pd.DataFrame({"id": b["id"].iloc[part], "size": b["size"].iloc[part], "bag": [own.packed(i, counted) for i in range(part.stop - part.start)]})

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from profiles(b)

    known = texts(members.select("id"), count).withColumn("size", F.length("text"))
    known = known if short else saved(known.mapInPandas(frugal(profile), "id long, size int, bag binary"), "bags")
    sized = members.join(known.select("id", "size"), "id")
    dealt = _dealt(members, sized, count)
    dealt = dealt.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "sketch", "component").join(known, "id")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        freed()
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        heads, place = np.unique(b["component"].to_numpy(), return_inverse=True)
        # pairs within a component don't matter, so the largest one's members are compared with the others only
        fewer = np.flatnonzero(place != np.bincount(place).argmax())
        sketch = b["sketch"].to_numpy().view(np.uint64)
        may = (_apart(sketch[fewer, None], sketch[None, :]) <= far) & (place[fewer, None] != place[None, :])
        mine = b["block"].to_numpy() == b["i"].iloc[0]
        if b["i"].iloc[0] != b["j"].iloc[0]:
            may &= mine[fewer, None] != mine[None, :]
        if not may.any():
            return none
        left, right = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        used = np.union1d(fewer[left], right)
        may = may[np.ix_(left, right)]
        left, right = np.searchsorted(used, fewer[left]), np.searchsorted(used, right)
        b, place = b.iloc[used], place[used]
        ids = b["id"].to_numpy()
        lists = [np.frombuffer(x, dtype="<u8") for x in (pd.concat(profiles(b)) if short else b)["bag"]]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        owner = np.repeat(np.arange(len(lists)), size)
        _, term, n = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = n[term] > 1
        column = np.cumsum(n > 1) - 1
        owner, term = owner[shared], column[term[shared]]
        both = np.zeros(may.shape, dtype=np.float32)
        order = np.argsort(term, kind="stable")
        owner, term = owner[order], term[order]
        for start in range(0, int((n > 1).sum()), 4096):
            lo, hi = np.searchsorted(term, [start, start + 4096])
            part = np.zeros((len(lists), 4096), dtype=np.float32)
            part[owner[lo:hi], term[lo:hi] - start] = 1
            both += part[left] @ part[right].T
        total = size[left, None] + size[None, right] - both
        p, q = np.nonzero((both >= least * total) & may)
        p, q = left[p], right[q]
        root = list(range(len(heads)))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        out = []
        for i, j in zip(p.tolist(), q.tolist()):
            u, v = find(place[i]), find(place[j])
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


class Segments:
    """Sorted values of several texts, end to end: value, count, and where each text's part begins."""

    def __init__(self, owner: np.ndarray, value: np.ndarray, n: int):
        """owner: the text of each value, rising; value: 64-bit, of which the upper 40 bits tell values of a text apart."""
        if n > 1 << 24:
            raise ValueError("too many texts at once")
        key = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.value = key[new] & np.uint64((1 << 40) - 1)
        self.owner = (key[new] >> np.uint64(40)).astype(np.int64)
        self.count = np.diff(np.append(new, len(key)))
        self.start = np.searchsorted(self.owner, np.arange(n + 1))

    def overlap(self, i: int, j: int, counted: bool) -> float:
        """Jaccard similarity of two texts, of multisets if counted; 0 where both are empty."""
        a, b = slice(self.start[i], self.start[i + 1]), slice(self.start[j], self.start[j + 1])
        x, y = self.value[a], self.value[b]
        if not len(x):
            return 0.0
        at = np.searchsorted(x, y)
        at[at == len(x)] = 0
        hit = x[at] == y
        if counted:
            ca, cb = self.count[a], self.count[b]
            both, total = int(np.minimum(ca[at[hit]], cb[hit]).sum()), int(ca.sum() + cb.sum())
        else:
            both, total = int(np.count_nonzero(hit)), len(x) + len(y)
        return both / (total - both) if total else 0.0

    def packed(self, i: int, counted: bool) -> bytes:
        """A text's values as bytes; of multisets, each further occurrence of a value is a value of its own."""
        at = slice(self.start[i], self.start[i + 1])
        value = self.value[at]
        if counted and len(value) and self.count[at].max() > 1:
            n = self.count[at]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            value = np.repeat(value, n)
            value = np.where(nth > 0, mixed(value ^ mixed(nth.astype(np.uint64))), value)
        return value.astype("<u8").tobytes()
