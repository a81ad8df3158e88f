"""Verified links between the sets that share a bucket of a locality-sensitive split.

A set is an array of distinct hashes, sorted. Two sets are linked when their
Jaccard similarity is ``least`` or more. Buckets are compared exactly: what comes
out of a bucket joins all its members that a chain of links inside it joins, with
fewer links than members, and no pair leaves a bucket unverified.

In a bucket:

Before that, ``hopeful()`` leaves out the members of a bucket that have no partner there by a
small signature (one-permutation minima of ``BINS`` bins, a bit each), so that the sets of few are shuffled.

1. Members of which less than ``least`` of the hashes are held by any other member
   have no link there and are out, again and again until none is.
2. A member without a link becomes a pivot and is compared with all members, until
   every member is a pivot or linked to one.
3. What is left are pairs of two members that are linked to different pivots and not
   yet joined. By the triangle inequality of the Jaccard distance such a pair can
   only be linked where each is within twice the distance of the other's pivot; these
   are compared.

A bucket of more than ``share`` members is first dealt out in parts that hold its
first member in common, which joins each part's members; ``cells()`` then brings
together all pairs of members that are still apart, by the groups so far: members of
the bucket's largest group meet the others, and the others one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.components import components
from tandem.llm.hashing import mix, release
from tandem.llm.storage import stored

EPSILON = 1e-9
#: Bins of a signature, and how many standard deviations a linked pair's signatures may lie from their mean.
BINS, DEVIATIONS = 128, 5
#: Members up to which a bucket is compared pair by pair.
FEW = 8
#: Bits of the table of a bucket's members and hashes; a larger one is searched by its rarest hashes instead.
TABLE_BITS = 1 << 28


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Equal hashes of 32 bits get equal numbers from 0 on."""
    keys = np.sort(hashes.astype(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64))
    value = keys >> np.uint64(32)
    out = np.zeros(len(hashes), np.int64)
    out[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)[1:]] = np.cumsum(value[1:] != value[:-1])
    return out


def _few(sets: list[np.ndarray], groups: list[int], least: float) -> list[tuple[int, int]]:
    """As Bucket.linked(), pair by pair."""
    out, groups = [], list(groups)
    for i in range(1, len(sets)):
        for j in range(i):
            if groups[i] != groups[j] and _alike([sets[i], sets[j]], least):
                out.append((j, i))
                groups = [groups[j] if g == groups[i] else g for g in groups]
    return out


class Bucket:
    """The sets of one bucket and the groups that they are in so far."""

    def __init__(self, sets: list[np.ndarray], groups: np.ndarray, least: float, table_bits: int = TABLE_BITS):
        self.least, self.low = least, 2 * least - 1
        self.group = np.unique(groups, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.size = np.array([len(s) for s in sets])
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        ids = _numbered(np.concatenate(sets))
        live = self.size > 0
        while True:
            times = np.bincount(ids[live[self.owner]], minlength=int(ids.max(initial=-1)) + 1)
            held = times[ids] > 1
            good = live & (np.bincount(self.owner, held, len(sets)) >= least * self.size - EPSILON)
            if good.sum() == live.sum():
                break
            live = good
        self.live = np.flatnonzero(live)
        held &= live[self.owner]
        names = np.cumsum(times > 1) - 1
        self.owner, self.ids, self.names = self.owner[held], names[ids[held]], int((times > 1).sum())
        self.begin = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        self.bits = self.postings = None
        if len(self.live) > 1:
            if len(sets) * self.names <= table_bits:
                self._table()
            else:
                self.times = np.bincount(self.ids, minlength=self.names)
                self.postings = self.owner[np.argsort(self.ids, kind="stable")]
                self.ends = np.cumsum(self.times)

    def _table(self) -> None:
        n, width = len(self.size), -(-self.names // 64) * 64
        self.bits = np.zeros((n, width // 64), np.uint64)
        step = max(1, (1 << 24) // max(width, 1))
        for a in range(0, n, step):
            part = slice(self.begin[a], self.begin[min(a + step, n)])
            flags = np.zeros((min(step, n - a), width), np.uint8)
            flags[self.owner[part] - a, self.ids[part]] = 1
            self.bits[a : a + step] = np.packbits(flags, axis=1, bitorder="little").view(np.uint64)

    def likeness(self, one: int, others: np.ndarray) -> np.ndarray:
        """Exact similarity of a member to others; 0 may stand for less than ``low``."""
        if self.bits is not None:
            shared = np.bitwise_count(self.bits[others] & self.bits[one]).sum(1, dtype=np.int64)
        else:
            # who shares low of one's hashes shares one of any of them but so many
            own = self.ids[self.begin[one] : self.begin[one + 1]]
            rare = own[np.argsort(self.times[own], kind="stable")]
            alone = self.size[one] - len(own)  # hashes that no other member has come first
            rare = rare[: max(0, self.size[one] - int(np.ceil(self.low * self.size[one] - EPSILON)) + 1 - alone)]
            hit = np.zeros(len(self.size), bool)
            for x in rare:
                hit[self.postings[self.ends[x] - self.times[x] : self.ends[x]]] = True
            near = np.flatnonzero(hit[others])
            flags = np.zeros(self.names, bool)
            flags[own] = True
            shared = np.zeros(len(others), np.int64)
            for k in near:
                member = others[k]
                shared[k] = flags[self.ids[self.begin[member] : self.begin[member + 1]]].sum()
        return shared / (self.size[others] + self.size[one] - shared)

    def join(self, one: int, others: np.ndarray) -> None:
        """Links of one to others, as far as they join groups."""
        groups, at = np.unique(self.group[others], return_index=True)
        new = groups != self.group[one]
        if new.any():
            self.links += [(one, int(x)) for x in others[at[new]]]
            self.group[np.isin(self.group, groups[new])] = self.group[one]

    def linked(self) -> list[tuple[int, int]]:
        """Pairs of members that are linked and join all groups that links in this bucket join."""
        live = self.live
        if len(live) < 2:
            return []
        open_, by = np.zeros(len(self.size), bool), np.full(len(self.size), -1)
        open_[live] = True  # no pivot yet
        pivots: list[tuple[int, np.ndarray]] = []
        sizes = np.bincount(self.group[live])
        for one in live[np.argsort(sizes[self.group[live]], kind="stable")].tolist():
            if by[one] >= 0:
                continue
            waiting = self.group[live[open_[live]]]
            if (waiting == waiting[0]).all():  # only pairs of one group are left: pivots have been compared with all
                return self.links
            like = self.likeness(one, live)
            open_[one] = False
            hits = live[(like >= self.least - EPSILON) & (live != one)]
            by[hits[by[hits] < 0]] = one
            pivots.append((one, live[like >= self.low - EPSILON].astype(np.int32)))
            self.join(one, hits)
        done = ~open_
        for one, ring in pivots:
            mine = live[by[live] == one]
            mine = mine[open_[mine]]
            done[mine] = True
            ring = ring[~done[ring]]
            ring = ring[self.group[ring] != self.group[one]]
            few, many = (mine, ring) if len(mine) <= len(ring) else (ring, mine)
            for x in few.tolist():
                rest = many[self.group[many] != self.group[x]]
                if len(rest):
                    self.join(x, rest[self.likeness(x, rest) >= self.least - EPSILON])
        return self.links


    def degrees(self, side: np.ndarray) -> np.ndarray:
        """Of each member the number of members that it is linked to; of members with a side, those of the other side alone."""
        out = np.zeros(len(self.size), np.int64)
        for one in self.live.tolist() if len(self.live) > 1 else ():
            others = self.live[(side[self.live] != side[one]) | ((side[self.live] < 0) & (self.live != one))]
            out[one] = (self.likeness(one, others) >= self.least - EPSILON).sum()
        return out


def _alike(held: list[np.ndarray], least: float) -> bool:
    """Whether two sets are linked."""
    small, large = sorted(map(len, held))
    if small < least * large - EPSILON:
        return False
    both = np.concatenate(held)
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared > 0 and shared >= least * (len(both) - shared) - EPSILON


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Five numbers for each set: which bins hold a hash, a bit of the smallest in each, and the set's size."""
    n = len(begin) - 1
    owner = np.repeat(np.arange(n) * BINS, np.diff(begin))
    h = mix(sets.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    low = np.full(n * BINS, 1 << 62, np.uint64)
    np.minimum.at(low, owner + (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
    flags = np.stack([low != 1 << 62, (low & np.uint64(1) == 1) & (low != 1 << 62)]).reshape(2, n, BINS)
    held, bits = np.packbits(flags, axis=2).view(np.uint64)
    return np.concatenate([held, bits, np.diff(begin).astype(np.uint64)[:, None]], 1)


def hopeful_members(sign: np.ndarray, groups: np.ndarray, least: float) -> np.ndarray:
    """Whether each member of a bucket may be linked to one of another group.

    Of the bins that either set fills, the share of which the minima differ has
    the mean 1 - least at the threshold; bins in which the signatures differ are
    among them.
    """
    held, bits, size = sign[:, :2], sign[:, 2:4], sign[:, 4].astype(np.float64)
    good = np.zeros(len(sign), bool)
    for one in range(len(sign)):
        if not good[one]:
            other = groups != groups[one]
            other &= (size >= least * size[one] - EPSILON) & (size * least <= size[one] + EPSILON)
            at = np.flatnonzero(other)
            filled = np.bitwise_count(held[at] | held[one]).sum(1, dtype=np.int64)
            differ = np.bitwise_count((held[at] ^ held[one]) | ((bits[at] ^ bits[one]) & held[at] & held[one])).sum(1, dtype=np.int64)
            at = at[differ <= (1 - least) * filled + DEVIATIONS * np.sqrt(least * (1 - least) * filled)]
            if len(at):
                good[at] = good[one] = True
    return good


def _by_bucket(sets: Callable[[pa.RecordBatch], list[np.ndarray]], column: str, work: Callable, names: list[str]):
    """For mapInArrow, over rows (bucket, item, column, ...) sorted by bucket: what work(items, values, sets, bucket) gives for each bucket, columns of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        last = None

        def closed() -> list[np.ndarray]:
            items, values = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            held = [s for w in waiting for s in w[2]]
            waiting.clear()
            return [work(items, values, held, last)] if len(items) > 1 else []

        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            columns = np.concatenate([np.zeros((0, len(names)), np.int64), *found]).T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, items, values = (batch.column(c).to_numpy() for c in ("bucket", "item", column))
            held, found = sets(batch), []
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if waiting and bucket[a] != last:
                    found += closed()
                waiting.append((items[a:b], values[a:b], held[a:b]))
                last = bucket[a]
            yield out(found)
        if waiting:
            yield out(closed())
        release()

    return run


def hopeful(rows: DataFrame, least: float) -> DataFrame:
    """The rows (bucket, item, label) of rows (bucket, item, label, sign) that may be linked to one of another group in their bucket."""

    def sign(batch):
        return list(np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint64).reshape(batch.num_rows, -1))

    def work(items, labels, held, bucket):
        good = hopeful_members(np.array(held), labels, least)
        return np.stack([np.full(good.sum(), bucket), items[good], labels[good]], 1)

    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_by_bucket(sign, "label", work, ["bucket", "item", "label"]), "bucket long, item long, label long")


def compared(rows: DataFrame, sets: Callable, least: float) -> DataFrame:
    """The links (a, b) that the buckets of rows (bucket, item, label, ...) give; label: the group that an item is in so far.

    sets: for a batch of rows the set of each.
    """

    def work(items, labels, held, _):
        pairs = _few(held, labels.tolist(), least) if len(items) <= FEW else Bucket(held, labels, least).linked()
        return np.sort(items[np.array(pairs, np.int64).reshape(-1, 2)], axis=1)

    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(_by_bucket(sets, "label", work, ["a", "b"]), "a long, b long").distinct()


def degrees(groups: DataFrame, with_sets: Callable[[DataFrame], DataFrame], sets: Callable, least: float, share: int) -> DataFrame:
    """(item, n): the number of links of each item of groups (item, component) to others of its component, each pair of parts of a component in one cell.

    with_sets: adds to rows what sets() makes their items' sets of.
    """
    counts = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    half = max(1, share // 2)
    rows = groups.join(counts, "component").withColumn("number", F.when(F.col("n") > share, F.ceil(F.col("n") / half)).otherwise(1).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("item"), "number").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("number") - 1)))
    cell = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(cell.alias("bucket"), "item", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).cast("long").alias("side"))

    def work(items, side, held, _):
        if len(items) == 2:
            n = np.full(2, _alike(held, least) and (side[0] < 0 or side[0] != side[1]))
        else:
            n = Bucket(held, items, least).degrees(side)
        return np.stack([items, n.astype(np.int64)], 1)

    rows = with_sets(rows).repartition("bucket").sortWithinPartitions("bucket")
    found = rows.mapInArrow(_by_bucket(sets, "side", work, ["item", "n"]), "item long, n long")
    return found.groupBy("item").agg(F.sum("n").alias("n"))


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (bucket, item, label) of buckets with members of different groups."""
    apart = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return rows.join(stored(apart.select("bucket"), "mixed"), "bucket", "left_semi")


def labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (bucket, item) with each item's group of groups (node, component) as label."""
    rows = rows.join(groups.withColumnRenamed("node", "item"), "item", "left")
    return rows.select("bucket", "item", F.coalesce("component", "item").alias("label"))


def joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """The groups (node, component) after these links (a, b)."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if groups is not None:
        edges = edges.union(groups.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    return stored(components(edges), "groups")


def parts(rows: DataFrame, share: int) -> DataFrame:
    """(bucket, item) of rows (bucket, item, n, pivot): buckets of more than share members dealt out in parts that all hold the pivot."""
    number = F.ceil(F.col("n") / share).cast("int")
    own = F.pmod(F.xxhash64("item", "bucket"), number).cast("int")
    salt = F.when(F.col("item") == F.col("pivot"), F.sequence(F.lit(0), number - 1)).otherwise(F.array(own))
    large = rows.filter(F.col("n") > share).withColumn("salt", F.explode(salt))
    small = rows.filter(F.col("n") <= share).select("bucket", "item")
    return small.union(large.select(F.xxhash64("bucket", "salt").alias("bucket"), "item"))


def cells(rows: DataFrame, share: int) -> DataFrame:
    """(bucket, item, label) of rows (bucket, item, label): a cell for each two parts whose members are in different groups.

    Buckets of one group give none. The largest group of a bucket is dealt out
    apart from the others, so that a few strays in a bucket of any size cost a
    copy of each stray for each part, and no copy of the rest.
    """
    counts = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("bucket").agg(F.max_by("label", "n").alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    half = max(1, share // 2)
    most = stored(
        most.filter("n_main < n").select("bucket", "main", F.ceil(F.col("n_main") / half).cast("int").alias("p"), F.ceil((F.col("n") - F.col("n_main")) / half).cast("int").alias("q")), "mixed"
    )
    rows = rows.join(most, "bucket")
    main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("item", "bucket"), F.when(main, F.col("p")).otherwise(F.col("q"))).cast("int")
    rows = rows.withColumn("own", own)
    pair = lambda kind, a, b: F.xxhash64("bucket", F.lit(kind), a, b)
    to_main = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: pair("main", F.col("own"), j))
    to_rest = F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda i: pair("main", i, F.col("own")))
    rest = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: pair("rest", F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
    # where all others fit in one part they meet beside the main group already
    others = F.when(F.col("q") > 1, F.concat(to_rest, rest)).otherwise(to_rest)
    return rows.select(F.explode(F.when(main, to_main).otherwise(others)).alias("bucket"), "item", "label")
