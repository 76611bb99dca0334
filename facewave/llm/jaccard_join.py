"""Exact Jaccard self-join of shingle sets in a metric space (operator 5).

Jaccard distance is a metric, but almost all documents lie at distance one from each other, where the triangle
inequality parts nothing. The join therefore begins with regions of sets that share shingles and goes on in them by distances.

1. Regions by shared shingles. In a fixed order of all shingles - rare ones first by hash, then those in ``often`` texts or more -
   two sets within the distance must share a shingle among the first ``n - ceil(t n) + 1`` of each. Rare shingles have short lists:
   all pairs in them are counted, and a pair stays only if its shared shingles leave room for the overlap it needs; what such pairs connect is a region.
   Frequent shingles have long lists: each elects a pivot (the member with the smallest hash, so near copies elect the same
   one), and all that share a pivot form its region. No pairs are made there, and the lists themselves are never brought together: a
   smallest hash is found part by part, then every set looks its pivots up. A list that is long although its shingle is not
   among the frequent ones (of which there are at most ``frequent_limit``) elects its pivot where it lies.
2. Voronoi cells. A region of more than ``leaf_rows`` sets or ``leaf_shingles`` shingles elects up to ``PIVOTS`` pivots, and the exact distance of each
   of its sets from them is worked out in bounded groups. A set goes to the cell of its nearest pivot, if that is within ``FAR``, else to the region's outer
   part. Boundary sets are replicated: with ``r`` the distance of a link, y meets the cell of pivot p only if d(y, p) is at most ``d1 + 2 r`` (d1 its
   distance from its own pivot) and at most ``r`` above the cell's radius. Sets within ``r`` of a pivot are linked with it and need no
   comparison with one another, so copies of one text cost one link each; pivots that share such a set are one component. Cells (and the outer part) that are
   still large are regions again, joined in the same way; a cell that no longer shrinks, or a region whose cells would hold ``WIDE`` times its sets, is dealt to tasks
   in pairs of blocks.
3. In a small region, one pivot's distances give the triangle windows: y is compared only with those x for which ``|d(x, p) - d(y, p)| <= r``, and that
   share a shingle with it among the rarest of both in the region.

Equal sets are one set throughout (told by a 64-bit hash), so exact copies cost nothing after the first pass. Shingles are dealt by part and 32 bits
of their hash; where two of one set fall together they count as one, and the bounds allow for that. Links join sets into components by grouped minima over edges.

Defined results: a text of fewer than five words is one shingle; null text or text without words has an empty set, links with
nothing and is its own component; a null id takes no part and has no component; repeated rows are copies; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from facewave.llm._shared import as_they_are, by_place, connected, parts_by_bytes, small, stored
from facewave.llm._text import U, mix, shingle_sets, tidy

#: Similarity as a fraction. Two sets link when DEN * shared >= NUM * union.
NUM, DEN = 3, 4
#: Distance of a link, and the largest distance of a set from the pivot of its cell.
REACH, FAR = 1 - NUM / DEN, 0.7
#: Pivots of a large region at most; what a set is to a region: one of its own, or drawn in from beside it.
PIVOTS, OWN, DRAWN = 64, 0, 1
#: How many times the sets of a region its cells may hold in all.
WIDE = 3
SLACK = 1e-9


def set_id(s: np.ndarray) -> int:
    """One 64-bit number for a set, whatever the order; signed, as Spark's longs are."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s).sum(dtype=U, keepdims=True) + U(len(s))).view(np.int64)[0])


def prefix_size(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1


def _keys(s: np.ndarray, parts: int) -> np.ndarray:
    """The sorted keys of a set: of each shingle its part (high) and 32 bits (low)."""
    return np.unique((((s >> U(32)) * U(parts)) & U(0xFFFFFFFF00000000)) | (s & U(0xFFFFFFFF)))


def _by_part(keys: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places) of each part in ``keys[order]``, which is sorted."""
    part = (keys[order] >> U(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(keys[at[0]] >> U(32)), at


def frequent(docs: DataFrame, text: str, parts: int, often: int, limit: int, flush: int = 1 << 20) -> np.ndarray:
    """Sorted keys of the shingles that ``often`` texts or more hold, counted in each task before they move. At most ``limit`` of them, the most frequent,
    whatever the input: the order of shingles may be any, and what is left out only makes longer lists."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for p, at in _by_part(keys, np.arange(len(keys))):
                low, more = keys[at].astype(np.uint32), n[at] > 1
                rows.append((p, low[~more].tobytes(), low[more].tobytes(), n[at][more].astype(np.uint32).tobytes()))
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["part", "once", "keys", "n"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                if len(s) and (i := set_id(s)) not in seen:
                    seen.add(i)
                    held.append(_keys(s, parts))
                    size += len(s)
                if size >= flush:
                    yield out()
                    held, size, seen = [], 0, set()
        if held:
            yield out()

    def count(table: pa.Table) -> pa.Table:
        once, keys, n = (np.concatenate([np.frombuffer(k.as_buffer(), np.uint32) for k in table[c]]) for c in ("once", "keys", "n"))
        keys, n = np.concatenate([once, keys]), np.concatenate([np.ones(len(once), np.int64), n.astype(np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[edges], np.add.reduceat(n, edges)
        high = table["part"][0].as_py() << 32
        return pa.table([pa.array(keys[n >= often].astype(np.int64) + high), pa.array(n[n >= often])], ["key", "n"])

    dealt = docs.select(text).mapInArrow(tidy(spread), "part int, once binary, keys binary, n binary")
    found = stored(dealt.groupBy("part").applyInArrow(count, "key long, n long"), "frequent")
    total = found.count()
    if total > limit:
        level = F.floor(F.log2("n") * 8)  # some hundreds of levels at most
        least = left = 0
        for r in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
            left += r["count"]
            if left > limit:
                least = r["level"] + 1
                break
        found = found.where(level >= least)
    return np.sort(found.select("key").toArrow()["key"].to_numpy().astype(U))


def signatures(docs: DataFrame, key: str, text: str, parts: int, heavy: np.ndarray) -> DataFrame:
    """(key, n, sid, rare, keys) of each text: size and number of its set, how many rare shingles its prefix has, and the prefix."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(heavy)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(heavy & U(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            n, sid, rare, keys = [], [], [], []
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                sid.append(set_id(s) if len(s) else None)
                k = _keys(s, parts)
                p = prefix_size(len(s)) if len(s) else 0
                common = maybe[(k & U(0xFFFFF)).astype(np.int64)]
                at = np.flatnonzero(common)
                if len(at):
                    place = np.minimum(np.searchsorted(heavy, k[at]), len(heavy) - 1)
                    common[at] = heavy[place] == k[at]
                first = k[~common][:p]
                rare.append(len(first))
                keys.append(np.concatenate([first, k[common][: p - len(first)]]).tobytes())
            ids = batch.column(0)
            known = ids.is_valid().to_pylist()
            sid = [x if ok else None for x, ok in zip(sid, known, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(rare, pa.int64()), pa.array(keys, pa.binary())], [key, "n", "sid", "rare", "keys"])

    return docs.select(key, text).mapInArrow(tidy(work), f"`{key}` {kind}, n long, sid long, rare long, keys binary")


def _pairs_of_lists(lists: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within each of the short lists ``lists[begin : begin + size]``."""
    a, b = [], []
    for size in np.unique(sizes):
        rows = lists[begins[sizes == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        a.append(rows[:, i].ravel())
        b.append(rows[:, j].ravel())
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _distinct_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """(sid, number of rare keys, keys) of the sets of a batch, each once."""
    seen: set[int] = set()
    for sid, rare, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if sid is not None and sid not in seen:
            seen.add(sid)
            yield sid, rare, np.frombuffer(keys, U)


def pairs_in_lists(signed: DataFrame, often: int, flush: int = 1 << 19) -> DataFrame:
    """(rare, a, b, shared) from the lists of rare shingles: pairs of sets with the number of shingles that they share in lists
    of fewer than ``often``, and (not rare) a pivot and a member of each longer list."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate([k for _, k in held])
            sids = np.repeat(np.array([s for s, _ in held], np.int64), [len(k) for _, k in held])
            rows = [(p, keys[at].astype(np.uint32).tobytes(), sids[at].tobytes()) for p, at in _by_part(keys, np.argsort(keys, kind="stable"))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "sids"])

        for batch in batches:
            for sid, rare, keys in _distinct_rows(batch):
                if rare:
                    held.append((sid, keys[:rare]))
                    size += rare
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint32) for k in table["keys"]])
        sids = np.concatenate([np.frombuffer(s.as_buffer(), np.int64) for s in table["sids"]])
        order = np.lexsort((sids, keys))
        keys, sids = keys[order], sids[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
        keys, sids = keys[new], sids[new]
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(begins, len(keys)))
        short, long = (sizes > 1) & (sizes < often), sizes >= often
        a, b = _pairs_of_lists(sids, begins[short], sizes[short])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
        shared = np.diff(np.append(at, len(a)))
        rows = [(a[at], b[at], shared)]
        for begin, size in zip(begins[long].tolist(), sizes[long].tolist(), strict=True):
            members = sids[begin : begin + size]
            pivot = members[mix(members.view(U)).view(np.int64).argmin()]
            rows.append((np.full(size, pivot), members, np.zeros(size, np.int64)))
        rare = np.arange(sum(len(x) for x, *_ in rows)) < len(at)
        return pa.table([pa.array(rare), *(pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True))], ["rare", "a", "b", "shared"])

    dealt = signed.select("sid", "rare", "keys").mapInArrow(tidy(spread), "part int, keys binary, sids binary")
    return dealt.groupBy("part").applyInArrow(meet, "rare boolean, a long, b long, shared long")


def pivot_members(signed: DataFrame, flush: int = 1 << 19) -> DataFrame:
    """(pivot, sid) for the frequent shingles: each shingle's pivot and, for each set, the pivots of its shingles. There are at
    most as many pivots as frequent shingles, so all of them go to every task."""
    rows = signed.where("octet_length(keys) > 8 * rare").select("sid", "rare", "keys")

    def elect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys = np.concatenate([k for _, k in held])
            sids = np.repeat(np.array([s for s, _ in held], np.int64), [len(k) for _, k in held])
            hashes = mix(sids.view(U)).view(np.int64)
            order = np.lexsort((hashes, keys))
            keys, sids, hashes = keys[order], sids[order], hashes[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            last = np.append(first[1:], len(keys)) - 1
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[first].view(np.int64), sids[first], hashes[first], hashes[last])], ["key", "sid", "low", "high"])

        for batch in batches:
            for sid, rare, keys in _distinct_rows(batch):
                held.append((sid, keys[rare:]))
                size += len(keys) - rare
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    elected = rows.mapInArrow(tidy(elect), "key long, sid long, low long, high long").groupBy("key").agg(F.min_by("sid", "low").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"))
    got = elected.where("low < high").select("key", "pivot").toArrow()  # lists of one set need no region
    keys = got["key"].to_numpy().astype(U)
    order = np.argsort(keys)
    shared = signed.sparkSession.sparkContext.broadcast((keys[order], got["pivot"].to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pivots = shared.value
        for batch in batches if len(known) else ():
            own, of = [], []
            for sid, rare, keys in _distinct_rows(batch):
                at = np.minimum(np.searchsorted(known, keys[rare:]), len(known) - 1)
                found = np.unique(pivots[at[known[at] == keys[rare:]]])
                own.append(found)
                of.append(np.full(len(found), sid))
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(of))], ["pivot", "sid"])

    return rows.mapInArrow(tidy(look_up), "pivot long, sid long")


def candidates(signed: DataFrame, often: int) -> DataFrame:
    """(rare, a, b, shared): pairs of sets with the number of rare prefix shingles they share, and (not rare) pairs of a
    pivot and a member of its region."""
    members = pivot_members(signed).select(F.lit(False).alias("rare"), F.col("pivot").alias("a"), F.col("sid").alias("b"), F.lit(0).cast("long").alias("shared"))
    return pairs_in_lists(signed, often).union(members).groupBy("rare", "a", "b").agg(F.sum("shared").alias("shared"))


def _index(sets: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives a set's overlap with each of ``sets``."""
    size = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def overlap(s: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
        n = high - low
        return np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))

    return overlap


def _near(shared: np.ndarray, n, m) -> np.ndarray:
    """DEN * shared >= NUM * union."""
    return (NUM + DEN) * shared >= NUM * (n + m)


def _partners(sets: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """A function that gives those places that a set can be linked with: in the order of how many sets of the region hold a shingle, two linked sets share one among
    their first."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, many[token], owner))
    token, owner = token[order], owner[order]
    first = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size) < np.repeat([prefix_size(int(n)) for n in size], size)
    held = first & (many[token] > 1)
    token, owner = token[held], owner[held]
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    order = np.argsort(token, kind="stable")
    by_token, holder = token[order], owner[order]

    def partners(i: int) -> np.ndarray:
        own = token[cut[i] : cut[i + 1]]
        low, high = np.searchsorted(by_token, own, "left"), np.searchsorted(by_token, own, "right")
        n = high - low
        out = np.zeros(len(sets), bool)
        out[holder[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return out

    return partners


def region_links(sids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, drawn: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all linked sets of a small region, one for each join. Sets with one label are known to be of one component, and two drawn sets
    meet elsewhere. The pivot is the first set."""
    size = np.array([len(s) for s in sets])
    overlap, partners = _index(sets), _partners(sets)
    label = np.unique(labels, return_inverse=True)[1]
    out: list[tuple[int, int]] = []

    def join(i: int, linked: np.ndarray) -> None:
        for x in np.unique(label[linked]):
            if x != label[i]:
                other = linked[label[linked] == x][0]
                out.append((int(sids[i]), int(sids[other])))
                label[label == x] = label[i]

    shared = overlap(sets[0])
    join(0, np.flatnonzero(_near(shared, size, size[0])))
    distance = 1 - shared / (size + size[0] - shared)
    for y in np.argsort(distance, kind="stable"):
        window = np.abs(distance - distance[y]) <= REACH + SLACK
        window &= (label != label[y]) & (NUM * np.maximum(size, size[y]) <= DEN * np.minimum(size, size[y]))
        if drawn[y]:
            window &= ~drawn
        if not window.any():
            continue
        at = np.flatnonzero(window & partners(y))
        if len(at) > 16:
            join(y, at[_near(overlap(sets[y])[at], size[at], size[y])])
        elif len(at):
            common = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x in at])
            join(y, at[_near(common, size[at], size[y])])
    return out


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), U) for s in table["shingles"]]


def links_in(members: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """(a, b) of the small regions (region, sid, role, label), each in one task."""

    def link(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table["sid"].to_numpy(), return_index=True)[1]))  # where a set is drawn in twice, once is enough
        links = region_links(table["sid"].to_numpy(), _sets_of(table), table["label"].to_numpy(), table["role"].to_numpy() == DRAWN) if len(table) > 1 else []
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return members.join(sets, "sid").groupBy(*by).applyInArrow(link, "a long, b long")


def links_in_blocks(members: DataFrame, sets: DataFrame, block_rows: int) -> DataFrame:
    """The same for regions that cells do not part: every block of a region meets every other."""
    blocks = small(stored(members.groupBy("region").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return links_in(members.join(blocks, "region").withColumn("at", F.explode(meets)).select("region", "sid", "role", "label", "at.i", "at.j"), sets, ["region", "i", "j"])


def cells(members: DataFrame, sets: DataFrame, level: int, group_rows: int = 1024, group_shingles: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """One step of large regions (region, sid, role, label, n): the links with their pivots, and the members of their cells and outer parts,
    with the number of the region's sets as ``before``."""
    sized = members.groupBy("region").agg(F.count("*").alias("before"), F.ceil(F.greatest(F.count("*") / group_rows, F.sum("n") / group_shingles)).cast("int").alias("groups"))
    sized = small(stored(sized, "sized"))  # one row for every large region
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("sid", F.lit(level)), "sid"))
    pivots = members.where(F.col("role") == OWN).select("region", "sid", rank.alias("j")).where(F.col("j") <= PIVOTS)
    pivots = stored(pivots.join(sets, "sid"), "pivots")
    left = members.join(sized, "region").join(sets, "sid").withColumn("group", F.pmod(F.xxhash64("sid"), F.col("groups")).cast("int"))
    right = pivots.join(sized, "region").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("region", "group", "j", "shingles")

    def measure(group: pa.Table, pivots: pa.Table) -> pa.Table:
        at, ds, near = [], [], []
        if len(group) and len(pivots):
            j, of = pivots["j"].to_numpy(), _sets_of(pivots)
            m, overlap = np.array([len(s) for s in of]), _index(of)
            for s in _sets_of(group):
                shared = overlap(s)
                d = 1 - shared / (len(s) + m - shared)
                # those farther than this are no cell of the set, nor can they draw it in
                some = np.flatnonzero((d <= min(d.min() + 2 * REACH, FAR + REACH) + SLACK) | (d == d.min()))
                some = some[np.lexsort((j[some], d[some]))]
                some = some[: None if d[some[0]] <= FAR + REACH else 1]
                at.append(j[some].tolist())
                ds.append(d[some].tolist())
                near.append(j[_near(shared, len(s), m)].tolist())
        group = group.select(["region", "sid", "role", "label", "n", "before"]) if at else group.select(["region", "sid", "role", "label", "n", "before"]).slice(0, 0)
        for name, values, kind in (("at", at, pa.int32()), ("d", ds, pa.float64()), ("near", near, pa.int32())):
            group = group.append_column(name, pa.array(values, pa.list_(kind)))
        return group

    schema = "region string, sid long, role int, label long, n long, before long, at array<int>, d array<double>, near array<int>"
    measured = stored(left.groupBy("region", "group").cogroup(right.groupBy("region", "group")).applyInArrow(measure, schema), "measured")
    pivots = pivots.select("region", "j", F.col("sid").alias("pivot"))

    # pivots with a set within reach of both are one component; there are at most PIVOTS squared such pairs in a region
    pairs = measured.where("size(near) > 1").select("region", F.explode(F.slice("near", 2, PIVOTS)).alias("j"), F.col("near")[0].alias("i")).distinct()
    pairs = pivots.select("region", F.col("j").alias("i"), "j", "pivot").unionByName(pairs.withColumn("pivot", F.lit(None).cast("long")))

    def unite(table: pa.Table) -> pa.Table:
        label = {j: p for j, p in zip(table["j"].to_pylist(), table["pivot"].to_pylist(), strict=True) if p is not None}
        for i, j in zip(table["i"].to_pylist(), table["j"].to_pylist(), strict=True):
            if label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {x: new if p == old else p for x, p in label.items()}
        return pa.table([pa.array([table["region"][0].as_py()] * len(label), pa.string()), pa.array([*label], pa.int32()), pa.array([*label.values()], pa.int64())], ["region", "j", "one"])

    one = small(stored(pairs.groupBy("region").applyInArrow(unite, "region string, j int, one long"), "one"))
    links = measured.select("region", "sid", F.explode("near").alias("j")).join(small(pivots), ["region", "j"]).select(F.col("sid").alias("a"), F.col("pivot").alias("b")).where("a <> b")

    # a set within reach of its nearest pivot is of that pivot's component
    first = measured.withColumn("j", F.col("at")[0]).withColumn("d1", F.col("d")[0]).join(one, ["region", "j"])
    first = first.withColumn("label", F.when(F.size("near") > 0, F.col("one")).otherwise(F.col("label"))).drop("one").withColumnRenamed("j", "own")
    spread = first.select("region", "sid", "role", "label", "n", "before", "own", "d1", F.explode(F.arrays_zip("at", "d")).alias("x")).select("*", F.col("x.at").alias("j"), F.col("x.d").alias("d")).drop("x").join(one, ["region", "j"])
    mine = (F.col("role") == OWN) & (F.col("j") == F.col("own")) & (F.col("d1") <= FAR)
    with_pivot = F.col("label") == F.col("one")
    spread = stored(spread.withColumn("mine", mine).withColumn("with_pivot", with_pivot), "spread")
    radius = spread.where("mine").groupBy("region", "j").agg(F.max("d").alias("radius"), F.max(F.when(~F.col("with_pivot"), F.col("d"))).alias("rim"))
    drawn = ~F.col("mine") & (F.col("d") <= F.when(F.col("with_pivot"), F.col("rim")).otherwise(F.col("radius")) + REACH + SLACK)
    inside = spread.join(small(stored(radius, "radius")), ["region", "j"]).where(F.col("mine") | drawn)
    # of the sets that are linked with the pivot, those stay that any other set of the cell may reach
    others = inside.where(~F.col("with_pivot")).groupBy("region", "j").agg(F.min("d").alias("nearest"))
    inside = inside.join(small(stored(others, "others")), ["region", "j"]).where(~F.col("with_pivot") | (F.col("d") + REACH + SLACK >= F.col("nearest")))
    inside = inside.select("region", F.concat_ws("/", "region", "j").alias("cell"), "sid", F.when(F.col("mine"), OWN).otherwise(DRAWN).alias("role"), "label", "n", "before")
    outer = first.where(F.when(F.col("role") == OWN, F.col("d1") > FAR).otherwise(F.col("d1") > FAR - REACH - SLACK))
    inside = stored(inside.union(outer.select("region", F.concat(F.col("region"), F.lit("/o")).alias("cell"), "sid", "role", "label", "n", "before")), "inside")
    # where most sets are drawn into many cells, distances part nothing: such a region goes on whole, to be dealt in blocks
    wide = inside.groupBy("region").agg(F.count("*").alias("rows"), F.max("before").alias("before")).where(F.col("rows") > WIDE * F.col("before")).select("region")
    wide = small(stored(wide, "wide"))
    whole = first.join(wide, "region", "left_semi").select("region", "sid", "role", "label", "n", F.lit(0).cast("long").alias("before"))
    return links, inside.join(wide, "region", "left_anti").select(F.col("cell").alias("region"), "sid", "role", "label", "n", "before").union(whole)


def join_regions(regions: DataFrame, sets: DataFrame, leaf_rows: int, leaf_shingles: int, block_rows: int = 1024) -> DataFrame:
    """(a, b): links that connect all linked sets of the regions (region, sid, n). ``sets`` has (sid, shingles)."""
    members = regions.select("region", "sid", F.lit(OWN).alias("role"), F.col("sid").alias("label"), F.col("n").cast("long").alias("n"), F.lit(None).cast("long").alias("before"))
    links, level = [], 0
    while True:
        about = members.groupBy("region").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.max("before").alias("was"), F.min("role").alias("least"), F.min("label").alias("low"), F.max("label").alias("high"))
        about = about.where((F.col("least") == OWN) & (F.col("low") < F.col("high")))  # the others have no pair to compare
        large = (F.col("rows") > 2) & ((F.col("rows") > leaf_rows) | (F.col("shingles") > leaf_shingles))
        kind = F.when(~large, 0).when(F.col("rows") > 0.8 * F.coalesce("was", F.lit(1 << 62)), 2).otherwise(1)
        about = stored(about.select("region", kind.alias("kind")), "about")
        kinds = {r["kind"]: r["count"] for r in about.groupBy("kind").count().collect()}
        of = lambda k: members.join(small(about.where(F.col("kind") == k)), "region").select("region", "sid", "role", "label", "n")  # noqa: B023, E731
        if 0 in kinds:
            links.append(links_in(of(0), sets, ["region"]))
        if 2 in kinds:
            links.append(links_in_blocks(of(2), sets, block_rows))
        if 1 not in kinds:
            return reduce(DataFrame.union, links) if links else members.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
        level += 1
        found, inside = cells(of(1), sets, level)
        links.append(found)
        members = stored(inside, "members")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", often: int = 16, frequent_limit: int = 1_000_000, leaf_rows: int = 512, leaf_shingles: int = 1 << 19, part_bytes: int = 4 << 20, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    return _components(docs, key, text, often, frequent_limit, leaf_rows, leaf_shingles, part_bytes, broadcast_rows).select(key, "n_shingles", "component_id")


def _components(docs: DataFrame, key: str, text: str, often: int = 16, frequent_limit: int = 1_000_000, leaf_rows: int = 512, leaf_shingles: int = 1 << 19, part_bytes: int = 4 << 20, broadcast_rows: int = 2_000_000) -> DataFrame:
    """The same with the number of each row's set (sid; null for an empty set or a null key)."""
    parts = parts_by_bytes(docs, text, part_bytes)
    kind = docs.schema[key].dataType.simpleString()
    signed = stored(signatures(docs, key, text, parts, frequent(docs, text, parts, often, frequent_limit)), "signed")
    sets = stored(signed.where("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.min(key).alias("rep")), "sets")

    found = stored(candidates(signed, often), "candidates")
    brief = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n_{x}"), (F.col("n") - F.col("rare")).alias(f"rest_{x}"))
    fit = f"{DEN} * least(n_a, n_b) >= {NUM} * greatest(n_a, n_b) and {NUM + DEN} * (shared + greatest(rest_a, rest_b)) >= {NUM} * (n_a + n_b)"
    pairs = found.where("rare").join(brief("a"), "a").join(brief("b"), "b").where(fit).select("a", "b")
    paired = connected(pairs).select(F.concat(F.lit("0:"), "root").alias("region"), F.col("node").alias("sid"))
    regions = stored(paired.union(found.where("not rare").select(F.concat(F.lit("1:"), "a"), "b")).join(sets.select("sid", "n"), "sid"), "regions")

    wanted = stored(regions.select("sid").distinct().join(sets.select("sid", F.col("rep").alias(key)), "sid"), "wanted")
    few = wanted.count() <= broadcast_rows
    chosen = docs.select(key, text).join(F.broadcast(wanted) if few else wanted, key)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(1).to_pylist()
            rows = [(i, s.tobytes()) for row, s in shingle_sets(batch.column(0)) if len(s) and (i := set_id(s)) == want[row]]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())], ["sid", "shingles"])

    whole = chosen.select(text, "sid").mapInArrow(tidy(shingles), "sid long, shingles binary")
    joined = connected(join_regions(regions, stored(whole.dropDuplicates(["sid"]), "whole"), leaf_rows, leaf_shingles))
    labels = sets.join(joined.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    low = labels.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = labels.join(low, "root").select("sid", "component_id")
    out = signed.select(key, F.col("n").alias("n_shingles"), "sid").join(labels, "sid", "left")
    return out.select(key, "n_shingles", F.when(F.col("n_shingles") == 0, F.col(key)).otherwise(F.col("component_id")).cast(kind).alias("component_id"), "sid")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """The documents with one row of each component: that with the smallest id. It is rows that go, not ids: where rows share an id, each is judged by its own
    text, and of rows alike in both one stays. Rows with a null id or an empty set stay."""
    found = stored(_components(docs, key, text, **more), "found")
    repeated = stored(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "repeated")
    gone = stored(found.where(F.col("component_id") != F.col(key)).select(key).distinct(), "gone")
    if repeated.isEmpty():
        return docs.join(small(gone), key, "left_anti").select(as_they_are(docs))
    repeated = small(repeated)
    once = docs.join(repeated, key, "left_anti").join(small(gone), key, "left_anti").select(as_they_are(docs))
    place, sid_name = docs.columns.index(text), "__sid"
    while sid_name in docs.columns:
        sid_name += "_"
    first = found.where("sid is not null").groupBy("component_id").agg(F.min(F.struct(F.col(key).alias("k"), "sid")).alias("x"))
    first = stored(first.select(F.col("x.k").alias(key), F.col("x.sid").alias(sid_name)).join(repeated, key, "left_semi"), "first")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid = [set_id(s) if len(s) else None for _, s in shingle_sets(batch.column(place))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sid, pa.int64())], schema.names)

    schema = StructType([*docs.schema.fields, StructField(sid_name, LongType())])
    rows = by_place(docs.join(repeated, key, "left_semi").select(as_they_are(docs))).mapInArrow(tidy(number), schema)
    one = rows.join(small(first), [key, sid_name], "left_semi").dropDuplicates([key, sid_name])
    return once.union(one.select(as_they_are(docs))).union(rows.where(F.col(sid_name).isNull()).select(as_they_are(docs)))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
