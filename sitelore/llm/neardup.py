"""MinHash near-duplicates with an LSH forest.

1. Every text becomes the set of its distinct 5-word shingles, a fingerprint of that set
   and a MinHash signature. Texts of one fingerprint are one node from here on,
   so a group of copies of any size is one row.
2. The forest: ``ORDERS`` sorted orders of the signature, each with its values in another sequence. A region is
   a run of nodes whose neighbours have a common prefix of ``DEPTH`` values or more. Rows are range-partitioned by
   (order and first values, values behind them), so a large region spreads over tasks by deeper prefixes.
   A region is as deep as its size asks for: one of up to ``REGION`` rows is compared whole. In a larger one the first
   ``REGION`` rows are compared with each other, then the common prefixes of neighbours tell where the region splits: what
   shares the deeper prefix of the last row goes on with the rows to come. A run that
   has the greatest depth, ``DEEPEST`` values, and is still too long becomes one candidate family as a whole, without comparing. So two nodes that
   share DEEPEST values of an order always meet in it, however large the region is and wherever tasks split it.
   Compared are estimates from whole signatures; what goes on is a spanning forest of each cluster, never its pairs.
3. A second pass goes over the border between each two tasks that share a region, with the rows that share a prefix with the one at the border, as deep as leaves a
   sixteenth of ``REGION`` on either side.
4. Components of these loose links, by estimate, are candidate families. Each family's texts meet once, and their full
   shingle sets decide: 100 * intersection >= 75 * union. A text is compared with all of
   its family unless it is already in the family's largest cluster, which loses no link between
   clusters: one end of it is always outside the largest.
5. A family over ``FAMILY`` members is dealt out in parts, each with the same few hub texts. The members that the
   hubs leave outside the largest cluster are dealt out in groups of that size, and each group then meets each part. So no task holds more than about two
   parts, whatever the family.

Two texts at the threshold share a region in at least one order with probability
1 - (1 - 0.75 ** DEPTH) ** ORDERS = 0.99999, and 0.997 where all their regions are as deep as can be.

Cases: null and empty texts and texts of white space have an empty set and are linked with nothing;
their component is their own id. Repeated rows of one id are one node. A row with a null id belongs to the component of
the rows with an equal set that have an id, and to none if there are none; it links no others, and its
row has kept = false. Ids are whole numbers. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import broadcast_if_small, cut, runs, slices, small_batches
from .components import components

VALUES, DEPTH, DEEPEST, ORDERS = 64, 3, 5, 21
#: Share of signature values that must agree for a loose link: over five standard errors below 0.75.
LOOSE = 30
REGION = 4096
EXTRA = DEEPEST - DEPTH
FAMILY, FAMILY_SHINGLES, HUBS = 512, 4_000_000, 12

_A = grams.stream(VALUES, 77) | grams.U(1)
_B = grams.stream(VALUES, 78)


def minhash(x: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the smallest value of each hash function over a set."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(x), 512):
        np.minimum(low, (x[lo : lo + 512, None] * _A + _B).min(0), out=low)
    return (low >> grams.U(32)).astype(np.uint32)


SIGNED = "id long, n_shingles long, f1 long, f2 long, signature binary"


def signatures(docs: DataFrame, n: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for start, texts in slices(batch, "__text", 1_000_000):
                size, f1, f2, sig = [], [], [], []
                for x in grams.shingle_sets(texts, n):
                    size.append(len(x))
                    if len(x):
                        f1.append(int(x.sum()) & (2**64 - 1))
                        f2.append(int(grams.mix(x ^ grams.U(0x5BD1E995)).sum()) & (2**64 - 1))
                        sig.append(minhash(x).tobytes())
                    else:
                        f1.append(0), f2.append(0), sig.append(None)
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), pa.array(sig, pa.binary())], names=["id", "n_shingles", "f1", "f2", "signature"])

    return small_batches(docs).select(F.col(id).cast("long").alias("id"), F.col(text).alias("__text")).mapInArrow(run, SIGNED)


def _sequences() -> np.ndarray:
    """For each order the sequence of signature values: first values that no other order begins with, then the others, mixed."""
    out = []
    for k in range(ORDERS):
        first = np.arange(k * DEPTH, (k + 1) * DEPTH) % VALUES
        others = np.setdiff1d(np.arange(VALUES), first)
        out.append(np.concatenate([first, others[np.argsort(grams.stream(len(others), 500 + k))]]))
    return np.array(out)


def _orders(batches):
    """For each node and order: a key of the order's first values, the low bytes of the others."""
    turn = _sequences()
    width = VALUES - DEPTH
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            n = part.num_rows
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(n, VALUES)
            turned = sig[:, turn]  # nodes, orders, values
            key = np.broadcast_to(np.arange(1, ORDERS + 1, dtype=np.uint64), (n, ORDERS)).copy()
            for k in range(DEPTH):
                key = grams.mix(key ^ turned[:, :, k]) + grams.U(k)
            rest = np.ascontiguousarray((turned[:, :, DEPTH:] & 0xFF).astype(np.uint8)).reshape(n * ORDERS, width)
            binary = pa.Array.from_buffers(pa.binary(), n * ORDERS, [None, pa.py_buffer(np.arange(0, (n * ORDERS + 1) * width, width, dtype=np.int32)), pa.py_buffer(rest)])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), binary, pa.array(np.repeat(part.column(0).to_numpy(), ORDERS))], names=["region", "rest", "id"])


def _estimated(rest: np.ndarray) -> list[int]:
    """Cluster number of each row of a region: rows whose estimate reaches LOOSE are together."""
    need = LOOSE - DEPTH
    if len(rest) == 2:
        return [0, 0] if int((rest[0] == rest[1]).sum()) >= need else [0, 1]
    return clusters(len(rest), lambda i: np.flatnonzero((rest == rest[i]).sum(1) >= need))


def clusters(n: int, linked) -> list[int]:
    """Clusters of n things, each named by its first; ``linked(i)`` gives all things that i has a link to.

    Asked for are only things outside the largest cluster so far, until all that are left are in it.
    """
    own = np.arange(n)
    asked = np.zeros(n, bool)
    i = 0
    while True:
        asked[i] = True
        met = np.unique(own[linked(i)])
        met = met[met != own[i]]
        if len(met):
            low = min(int(met[0]), int(own[i]))
            own[np.isin(own, met) | (own == own[i])] = low
        count = np.bincount(own, minlength=n)
        rest = np.flatnonzero(~asked & (own != count.argmax()))
        if not len(rest):
            return own.tolist()
        # the largest of the other clusters first: its members probably have a link to the largest
        i = int(rest[0])


class _Regions:
    """Takes the sorted rows of one task, region by region, and collects links and the rows at the task's edges.

    Held are the rows of the region so far that rows to come could reach, at most ``limit``. A row is (id, rest, whole);
    ``whole`` marks one that stands for a run of greatest depth, which is one family without comparing.
    """

    def __init__(self, limit: int, task: int):
        self.limit, self.border, self.task = limit, max(1, limit // 16), task
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        #: Rows at the border before the task and behind it: region, number of the task behind the border, rows.
        self.edges: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.region: int | None = None
        self.first = True  # still in the task's first region
        self.headed = False  # whether the beginning of the first region is among the edges
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.links.append((a, b))

    def take(self, region: int, ids: np.ndarray, rest: np.ndarray, whole: np.ndarray) -> None:
        if region != self.region:
            self.close()
            self.region = region
        at = 0
        while at < len(ids):
            if self.rows >= self.limit:
                self.deepen()
            end = min(len(ids), at + self.limit - self.rows)
            self.held.append((ids[at:end], rest[at:end], whole[at:end]))
            self.rows += end - at
            at = end

    def compare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Links the clusters of the rows held, and with a row that stands for a run all rows of that run."""
        ids, rest, whole = (np.concatenate(x) for x in zip(*self.held))
        self.within(ids, rest)
        for i in np.flatnonzero(whole):
            run = (rest[:, :EXTRA] == rest[i, :EXTRA]).all(1)
            self.link(np.full(int(run.sum()), ids[i]), ids[run])
        return ids, rest, whole

    def within(self, ids: np.ndarray, rest: np.ndarray) -> None:
        if len(ids) > 1:
            own = np.array(_estimated(rest))
            other = np.flatnonzero(own != np.arange(len(own)))
            self.link(ids[own[other]], ids[other])

    def part(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], last: bool, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of a region's rows that share a prefix with the first or the last one, as deep as leaves ``room`` of them.

        Where the greatest depth leaves more, they are one family without comparing, for which one row stands.
        """
        ids, rest, whole = rows
        common = np.logical_and.accumulate(rest[1:, :EXTRA] == rest[:-1, :EXTRA], axis=1).sum(1)
        lo, hi = 0, len(ids)
        for depth in range(EXTRA + 1):
            borders = [0, *(np.flatnonzero(common < depth) + 1).tolist(), len(ids)]
            lo, hi = (borders[-2], len(ids)) if last else (0, borders[1])
            if hi - lo <= room:
                return ids[lo:hi], rest[lo:hi], whole[lo:hi]
        self.link(np.full(hi - lo, ids[lo]), ids[lo:hi])
        return ids[lo : lo + 1], rest[lo : lo + 1], np.ones(1, bool)

    def deepen(self) -> None:
        """Compares the rows held and keeps the region's last part, as deep as makes it short enough."""
        rows = self.compare()
        if self.first and not self.headed:
            self.edges.append((self.region, self.task, *self.part(rows, False, self.border)))
            self.headed = True
        kept = self.part(rows, True, max(1, self.limit // 2))
        self.held, self.rows = [kept], len(kept[0])

    def close(self, end: bool = False) -> None:
        """The region is over, or the task."""
        if self.region is None:
            return
        ids, rest, whole = rows = self.compare()
        if end and self.first and (rest[:, :EXTRA] == rest[0, :EXTRA]).all():
            # the task is within one run, which goes on before and behind it: one family without comparing
            self.link(np.full(len(ids), ids[0]), ids)
            rows = ids[:1], rest[:1], np.ones(1, bool)
        if self.first and not self.headed:
            self.edges.append((self.region, self.task, *self.part(rows, False, self.border)))
        if end:
            self.edges.append((self.region, self.task + 1, *self.part(rows, True, self.border)))
        self.first, self.region, self.held, self.rows = False, None, [], 0

    def batch(self, batch: pa.RecordBatch) -> None:
        """Takes a batch; regions inside of it are complete, so they are compared at once, and single rows skipped."""
        keys, ids = batch.column("region").to_numpy(), batch.column("id").to_numpy()
        binary = batch.column("rest").cast(pa.binary())
        at = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(keys) + 1]
        rest = np.frombuffer(binary.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(len(keys), VALUES - DEPTH)
        whole = np.asarray(batch.column("whole")) if "whole" in batch.schema.names else np.zeros(len(keys), bool)
        borders = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        lo, size = borders[:-1], np.diff(borders)
        inner = np.ones(len(lo), bool)
        inner[[0, -1]] = False
        plain = inner & (size <= self.limit) & (np.add.reduceat(whole, lo) == 0)

        def put(k: int) -> None:
            a, b = lo[k], lo[k] + size[k]
            # copies: what is held must not keep the whole batch
            self.take(int(keys[a]), ids[a:b].copy(), rest[a:b].copy(), whole[a:b].copy())

        put(0)
        pairs = lo[plain & (size == 2)]
        near = pairs[(rest[pairs] == rest[pairs + 1]).sum(1) >= LOOSE - DEPTH]
        self.link(ids[near], ids[near + 1])
        for k in np.flatnonzero(plain & (size > 2)):
            self.within(ids[lo[k] : lo[k] + size[k]], rest[lo[k] : lo[k] + size[k]])
        for k in np.flatnonzero(inner & ~plain):
            put(k)
        if len(lo) > 1:
            put(len(lo) - 1)


LOOSE_ROWS = "a long, b long, region long, border long, rest binary, whole boolean"


def _neighbours(limit: int, task: int | None = None):
    """Streams the sorted regions of a task: LOOSE_ROWS, a link where b is set, else a row at one of the task's borders."""

    def drain(r: _Regions):
        a, b = (np.concatenate([x[k] for x in r.links] or [np.zeros(0, np.int64)]) for k in (0, 1))
        other = a != b
        a, b = a[other], b[other]
        r.links = []
        names = [x.split()[0] for x in LOOSE_ROWS.split(", ")]
        none = lambda n, *kinds: [pa.nulls(n, k) for k in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none(len(a), pa.int64(), pa.int64(), pa.binary(), pa.bool_())], names=names)
        for region, border, ids, rest, whole in r.edges:
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *none(n, pa.int64()), pa.array(np.full(n, region), pa.int64()), pa.array(np.full(n, border), pa.int64()), pa.array([x.tobytes() for x in rest], pa.binary()), pa.array(whole)], names=names)
        r.edges = []

    def run(batches):
        context = TaskContext.get()
        r = _Regions(limit, task if task is not None else context.partitionId() if context else 0)
        for batch in batches:
            if batch.num_rows:
                r.batch(batch)
                yield from drain(r)
        r.close(end=True)
        yield from drain(r)

    return run


def loose_links(nodes: DataFrame, limit: int = REGION) -> DataFrame:
    """(a, b) spanning links of the clusters of all regions; ``nodes`` has id and signature."""
    rows = nodes.select("id", "signature").mapInArrow(_orders, "region long, rest binary, id long")
    dealt = rows.repartitionByRange("region", "rest").sortWithinPartitions("region", "rest", "id")
    found = cut(dealt.mapInArrow(_neighbours(limit), LOOSE_ROWS))
    shared = found.where("b is null").select(F.xxhash64("region", "border").alias("region"), "rest", F.col("a").alias("id"), "whole").repartition("region").sortWithinPartitions("region", "rest", "id")
    return found.where("b is not null").select("a", "b").union(shared.mapInArrow(_neighbours(limit), LOOSE_ROWS).where("b is not null").select("a", "b"))


def _exact(n: int, percent: int):
    """Clusters of each part of a family by full sets: (id, to) links to each cluster's first member.

    With rows marked ``asked``, those are compared with the rows that aren't.
    """

    def run(batches):
        for _, table in runs(batches, "part"):
            ids, texts, asked = table.column("id").to_pylist(), table.column("__text").to_pylist(), table.column("asked").to_pylist()
            sets, at = [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < 1_000_000:
                    size += len(texts[end] or "")
                    end += 1
                sets.extend(grams.shingle_sets([t or "" for t in texts[at:end]], n))
                at = end
            del texts
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            ok = np.flatnonzero(size > 0)
            if len(ok) < 2:
                continue
            vocabulary, code = np.unique(np.concatenate([sets[i] for i in ok]), return_inverse=True)
            del sets
            size = size[ok]
            begin = np.cumsum(size) - size
            mark = np.zeros(len(vocabulary), bool)

            def linked(i, begin=begin, size=size, code=code, mark=mark):
                own = code[begin[i] : begin[i] + size[i]]
                mark[own] = True
                both = np.add.reduceat(mark[code], begin, dtype=np.int64)
                mark[own] = False
                return np.flatnonzero(100 * both >= percent * (size + size[i] - both))

            names = [ids[i] for i in ok]
            if any(asked):
                links = [(names[i], names[j]) for i in np.flatnonzero(np.array(asked)[ok]) for j in linked(int(i)) if names[j] != names[i]]
            else:
                links = [(names[i], names[c]) for i, c in enumerate(clusters(len(ok), linked)) if c != i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def _met(rows: DataFrame, n: int, percent: int) -> DataFrame:
    return rows.select("part", "id", "__text", "asked").repartition("part").sortWithinPartitions("part", "id").mapInArrow(_exact(n, percent), "a long, b long")


def _share(members: Column, shingles: Column, family: int, family_shingles: int) -> Column:
    """Number of parts that so many members with so many shingles are dealt into."""
    return F.greatest(F.ceil(members / F.lit(family)), F.ceil(shingles / F.lit(family_shingles)))


def _every(parts: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), parts - 1)


def near_groups(docs: DataFrame, *, id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, region: int = REGION, family: int = FAMILY, family_shingles: int = FAMILY_SHINGLES, finish: int = 1_000_000) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, n, id, text))
    nodes = cut(signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("id"), F.first("signature").alias("signature")))
    named = nodes.where("id is not null")
    families = components(loose_links(named, region), finish=finish)
    # a family's size decides whether it is dealt out; sizes are sums on the map side
    sized = families.join(named.select(F.col("id").alias("node"), "n_shingles"), "node")
    sums = sized.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    sums = sums.withColumn("parts", _share(F.col("members"), F.col("shingles"), family, family_shingles)).drop("shingles")
    members = cut(sized.join(sums, "component").select(F.col("node").alias("id"), "component", "n_shingles", "members", "parts"))
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("__text"))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    hub = (F.col("parts") > 1) & (F.pmod(F.xxhash64("id", F.lit(3)), F.col("members")) < HUBS)
    # texts that are in no family need not move
    met = texts.join(broadcast_if_small(members, 500_000), "id")
    parts = met.withColumn("p", F.explode(F.when(hub, _every(F.col("parts"))).otherwise(F.array(own)))).withColumns({"part": F.xxhash64("component", "p"), "asked": F.lit(False)})
    links = cut(_met(parts, n, percent))
    large = members.where("parts > 1")
    if not large.isEmpty():
        links = links.union(_rest(texts, large, links, n, percent, family, family_shingles, finish))
    exact = components(links, finish=finish)
    lowest = named.select("f1", "f2", "n_shingles", "id").join(exact.select(F.col("node").alias("id"), "component"), "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component"))
    out = signed.drop("signature").join(lowest, ["f1", "f2", "n_shingles"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _rest(texts: DataFrame, large: DataFrame, links: DataFrame, n: int, percent: int, family: int, family_shingles: int, finish: int) -> DataFrame:
    """Links of the members of large families that the parts leave outside the family's largest cluster.

    These members are dealt into groups as large as a part; each group meets each part of its family in a task of its own.
    """
    known = components(links, finish=finish).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    dealt = large.join(known, "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    counts = dealt.groupBy("component", "cluster").agg(F.count(F.lit(1)).alias("rows"))
    largest = counts.groupBy("component").agg(F.max(F.struct("rows", "cluster")).alias("top")).select("component", F.col("top.cluster").alias("largest"))
    dealt = cut(dealt.join(largest, "component").select("id", "component", "parts", "n_shingles", (F.col("cluster") != F.col("largest")).alias("out")))
    groups = dealt.where("out").groupBy("component").agg(_share(F.count(F.lit(1)), F.sum("n_shingles"), family, family_shingles).alias("groups"))
    dealt = cut(dealt.join(groups, "component").select("id", "component", "parts", "groups", "out"))
    rows = texts.join(broadcast_if_small(dealt, 500_000), "id")
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    group = F.pmod(F.xxhash64("id", F.lit(5)), F.col("groups"))
    # each text in its own part, once for each group; those outside in their group, once for each part
    at = F.transform(_every(F.col("groups")), lambda g: F.struct(own.alias("p"), g.alias("g"), F.lit(False).alias("asked")))
    asks = F.transform(_every(F.col("parts")), lambda p: F.struct(p.alias("p"), group.alias("g"), F.lit(True).alias("asked")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("out"), F.concat(at, asks)).otherwise(at)))
    return _met(rows.select("id", "__text", F.xxhash64("component", "to.p", "to.g").alias("part"), "to.asked"), n, percent)


def drop_near(docs: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; the columns stay as they are."""
    dropped = cut(near_groups(docs, id=id, **options).where(~F.col("kept")).select(F.col(id).alias("__dropped")))
    return docs.join(broadcast_if_small(dropped), F.col(f"`{id}`") == F.col("__dropped"), "left_anti")
