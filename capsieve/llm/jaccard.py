"""Exact Jaccard join of n-gram sets by PartEnum signatures, and the groups that its links form.

Sets are put in bands of size: linked sets are in one band or in neighbouring ones, so each set takes part in the
instance of its own band and in that of the next. An instance bounds the symmetric difference of linked sets by k. It
deals the feature domain over partitions, more than k / 2 of them holding features of the set, so at least one such
partition differs in one feature or none. Each partition is dealt over three cells; one difference spares two of them,
and the enumerated pairs of cells give the signatures. Linked sets so share a signature that isn't empty.

A set that is linked with another shares most of its features with it. A count-min sketch of all features, which never
takes a repeated one for single, tells which sets may do so; the others need no signatures.

Sets that share signatures form clusters. Inside a cluster, sets are compared: a parity sketch bounds the difference
from below, and what it can't rule out is counted exactly, unless both sets are known to be connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsieve.llm import countmin
from capsieve.llm.wordhash import A, B, C, components, mix, pack, pack_sorted, runs, together, unpack, unpack_sorted, word_hashes
from capsieve.session import materialize

#: Partitions of an instance beyond the number needed, in percent: some hold no feature of a set.
SPARE = 15
#: Sets of a cluster that meet in one task, two such chunks at most.
CHUNK = 1024
#: Rows up to which the table of clustered documents is broadcast (some 200 bytes each, with the names of its tasks); a larger
#: one is joined by shuffle, where only documents of its ids go to, if those are so few that they can be broadcast (64 bytes each).
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 500_000
#: Words of a parity sketch.
SKETCH = 32


class Rule:
    """Linked: 100 * intersection >= percent * union. Bands and bounds that follow from it."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent
        tops = [1]
        while tops[-1] < 1 << 40:
            tops.append((tops[-1] + 1) * 100 // percent)
        self.tops = np.array(tops)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, n)

    def difference(self, total: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of linked sets with so many features in all."""
        return (100 - self.percent) * total // (100 + self.percent)

    def linked(self, common: int, total: int) -> bool:
        return 100 * common >= self.percent * (total - common)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Ascending hashes of the distinct word shingles of each text, A-Z lower-cased; of fewer words, one of them all."""
    data = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    for a, b in together(data):
        borders, (h,) = word_hashes(data[a:b])
        grams = runs(h, width)
        for i, j in zip(borders[:-1], borders[1:]):
            if j - i >= width:
                yield np.unique(grams[i : j - width + 1])
            elif j > i:
                yield mix(runs(h[i:j], int(j - i)) + np.uint64(int(j - i) * int(B) % (1 << 64)))
            else:
                yield h[:0]


def grouped(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Features of all sets, some millions at a time."""
    held, size = [], 0
    for s in shingle_sets(texts, width):
        held.append(s)
        size += len(s)
        if size > 1_000_000:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def signatures(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets, and the number of the set that each belongs to."""
    size = np.array([len(s) for s in sets], np.int64)
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for ahead in (0, 1):
        instance = rule.band(size) + ahead
        k = rule.difference(2 * rule.tops[instance])
        need = k // 2 + 1
        parts = (need * (100 + SPARE) + 99) // 100
        active = np.flatnonzero((k > 0) & (size > 0))
        turn = 0
        while len(active):  # a set goes on to the next dealing until enough partitions hold two cells of it
            n, p = size[active], parts[active]
            x = np.concatenate([sets[i] for i in active])
            who = np.repeat(np.arange(len(active)), n)
            seed = mix(instance[active].astype(np.uint64) * A + np.uint64((turn + 1) * int(C) % (1 << 64)))
            z = mix(x ^ seed[who])
            place = ((z >> np.uint64(33)) * p.astype(np.uint64)[who]) >> np.uint64(31)
            base = np.concatenate([[0], np.cumsum(p)[:-1]])
            cell = ((base[who] + place.astype(np.int64)) * 3 + (z % np.uint64(3)).astype(np.int64)).astype(np.int64)
            total = int(p.sum())
            sums = np.zeros(3 * total, np.uint64)
            np.add.at(sums, cell, mix(z + B))
            held = (np.bincount(cell, minlength=3 * total) > 0).reshape(total, 3)
            sums = sums.reshape(total, 3)
            of = np.repeat(np.arange(len(active)), p)
            name = mix(seed[of] + (np.arange(total) - base[of]).astype(np.uint64) * A)
            for left, right in ((0, 1), (0, 2), (1, 2)):
                full = held[:, left] | held[:, right]
                out.append(mix((sums[full, left] + sums[full, right]) ^ (name[full] + np.uint64(left * 3 + right))))
                owner.append(active[of[full]])
            good = np.add.reduceat((held.sum(1) >= 2).astype(np.int64), base)
            active, turn = active[good < need[active]], turn + 1
    return np.concatenate(out), np.concatenate(owner)


def blocks(rows: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and sets, batch by batch; rows without id or words left out."""
    for batch in rows:
        sets = list(shingle_sets(batch["text"].tolist(), width))
        keep = [i for i, (d, s) in enumerate(zip(batch["doc_id"], sets)) if len(s) and not pd.isna(d)]
        yield batch["doc_id"].iloc[keep].to_numpy(np.int64), [sets[i] for i in keep]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and digest of the set (null for an empty one) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(batch["text"].tolist(), width))
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "digest": digest})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, digest binary")


def common(sets: list[np.ndarray], rule: Rule, bits: int, sketch: list) -> list[bool]:
    """Sets with a share of possibly repeated features that a link to another set needs."""
    size = np.array([len(s) for s in sets], np.int64)
    if not len(size):
        return []
    many = countmin.estimated(np.concatenate(sets), bits, sketch)
    known = np.add.reduceat(many.astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
    return (100 * known >= rule.percent * size).tolist()


def spread(docs: DataFrame, width: int, rule: Rule, shards: int, bits: int, sketch) -> DataFrame:
    """Packed signatures by shard, of sets with enough repeated features: of equal ones in a batch only the least id goes on; the links of the others to it
    travel beside. So a signature reaches its shard once for each batch, however many documents share it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, sets in blocks(batches, width):
            first: dict[bytes, int] = {}
            fit = common(sets, rule, bits, sketch)
            for i in np.argsort(ids, kind="stable"):
                if not fit[i]:
                    continue
                first.setdefault(sets[i].tobytes(), i)
            chosen = list(first.values())  # ascending ids
            own = ids[chosen]
            h, who = signatures([sets[i] for i in chosen], rule)
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            h, who = h[order], own[who[order]]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            least = np.minimum.reduceat(who, start)
            more = np.repeat(least, np.diff(start, append=len(h)))
            a, b = more[more != who], who[more != who]
            nodes, root = components(a, b)
            h = h[start]
            cuts = np.searchsorted((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
            out = [
                (s, False, pack_sorted(h[i:j] >> np.uint64(16)), pack(least[i:j]))
                for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:]))
                if j > i
            ]
            far = root != nodes
            if far.any():
                out.append((int(own[0]) % shards, True, pack(root[far]), pack(nodes[far])))
            yield pd.DataFrame(out, columns=["shard", "links", "keys", "ids"])

    return docs.mapInPandas(run, "shard int, links boolean, keys binary, ids binary")


def meet(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect all documents of a shard that share a signature, each to the least one."""
    keys, ids, a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
    for links, k, i in zip(rows["links"], rows["keys"], rows["ids"]):
        if links:
            a.append(unpack(k, "<i8"))
            b.append(unpack(i, "<i8"))
        else:
            keys.append(unpack_sorted(k, "<u8"))
            ids.append(unpack(i, "<i8"))
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(keys, kind="stable")
    keys, ids = keys[order], ids[order]
    same = keys[1:] == keys[:-1]
    nodes, root = components(np.concatenate([*a, ids[:-1][same]]), np.concatenate([*b, ids[1:][same]]))
    far = root != nodes
    return pd.DataFrame({"a": root[far], "b": nodes[far]})


def connected(edges: DataFrame) -> DataFrame:
    """Stars of the components of ``edges`` (a, b): one row (a, b) for each node but the least, ``a`` the least one.

    Alternating large and small stars: each round connects nodes to the least of their neighbours, until nothing
    changes; the number of rounds grows with the logarithm of the nodes.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    now = materialize(ordered.distinct())
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now
        before = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        now = materialize(small.where("a <> b").distinct())


def meetings(clusters: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, and the tasks (cluster, left, right, side) in which it meets others.

    A cluster of up to CHUNK sets is one chunk; a larger one is cut by band of size and hash into chunks of about so
    many. Chunks of one band meet each other, and those of the next band.
    """
    top = [int(t) for t in rule.tops]
    band = F.aggregate(F.array(*map(F.lit, top)), F.lit(0), lambda n, t: n + F.when(t < F.col("n_shingles"), 1).otherwise(0))
    clusters = clusters.withColumn("band", band)
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("all")).where("all > 1")
    each = clusters.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
    after = each.select("cluster", (F.col("band") - 1).alias("band"), F.col("parts").alias("next"))
    before = each.select("cluster", (F.col("band") + 1).alias("band"), F.col("parts").alias("previous"))
    placed = clusters.join(size, "cluster").join(each, ["cluster", "band"])
    placed = placed.join(after, ["cluster", "band"], "left").join(before, ["cluster", "band"], "left")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")

    def task(left, right, side: int):
        return F.struct(left.alias("left"), right.alias("right"), F.lit(side).alias("side"))

    def name(b, p):
        return F.concat_ws(".", b.cast("string"), p.cast("string"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    b, own = F.col("band"), name(F.col("band"), F.col("part"))
    placed = placed.withColumn("part", part)
    cut = F.concat(
        F.transform(F.sequence(F.col("part"), F.col("parts") - 1), lambda p: F.struct(own.alias("left"), name(b, p).alias("right"), F.lit(0).alias("side"))),
        F.transform(upto(F.col("part")), lambda p: F.struct(name(b, p).alias("left"), own.alias("right"), F.lit(1).alias("side"))),
        F.transform(upto(F.coalesce("next", F.lit(0))), lambda p: F.struct(own.alias("left"), name(b + 1, p).alias("right"), F.lit(0).alias("side"))),
        F.transform(upto(F.coalesce("previous", F.lit(0))), lambda p: F.struct(name(b - 1, p).alias("left"), own.alias("right"), F.lit(1).alias("side"))),
    )
    tasks = F.when(F.col("all") <= CHUNK, F.array(task(F.lit("all"), F.lit("all"), 0))).otherwise(cut)
    return placed.select("doc_id", "cluster", tasks.alias("tasks"))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Parity sketches: each feature flips one bit, so sets differ in at least as many features as sketches in bits."""
    out = np.zeros((len(sets), SKETCH), np.uint64)
    for i, s in enumerate(sets):
        odd = (np.bincount((s % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
        out[i] = np.packbits(odd).view(np.uint64)
    return out


def links(ids: list[int], sets: list[np.ndarray], side: list[int], cross: bool, rule: Rule) -> list[tuple[int, int]]:
    """A spanning set of the links among the sets, or between the two sides."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    ids, sets, side, size = [ids[i] for i in order], [sets[i] for i in order], np.array(side)[order], size[order]
    root = np.arange(len(ids))
    bits = sketches(sets) if len(ids) > 8 else None
    found = []
    for i in range(len(ids) - 1):
        # sizes ascend: the rest can be linked up to a size
        end = np.searchsorted(size, size[i] * 100 // rule.percent, "right")
        j = np.arange(i + 1, end)
        j = j[(root[j] != root[i]) & ((side[j] != side[i]) | (not cross))]
        if bits is not None and len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1)
            j = j[apart <= rule.difference(size[j] + size[i])]
        for k in j:
            if root[k] != root[i] and rule.linked(len(np.intersect1d(sets[i], sets[k], assume_unique=True)), int(size[i] + size[k])):
                found.append((ids[i], ids[k]))
                root[root == root[k]] = root[i]
    return found


def compare(rule: Rule):
    """Links of all tasks of a partition, whose rows come sorted by task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, sets, side, own = None, [], [], [], set()

        def done():
            found = links(ids, sets, side, at[1] != at[2], rule) if len(ids) > 1 else []
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        for batch in batches:
            for c, left, right, s, d, raw in zip(*(batch[x] for x in ("cluster", "left", "right", "side", "doc_id", "features"))):
                if at != (c, left, right):
                    if at is not None:
                        yield done()
                    at, ids, sets, side = (c, left, right), [], [], []
                if not ids or (side[-1], ids[-1]) != (s, d):
                    own = set()
                if raw not in own:  # an id may name several sets
                    own.add(raw)
                    ids.append(d)
                    sets.append(np.frombuffer(raw, np.uint64))
                    side.append(s)
        if at is not None:
            yield done()

    return run


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    A row's set are its distinct word shingles; two documents link when 100 * intersection >= percent * union of their
    sets. component_id is the least id that links lead to, the own one included. Null and empty texts have an empty
    set, 0 shingles, and link with nothing; so do rows without id, whose component is null. Rows that repeat an id
    count as one document with several sets. An empty table gives no rows; other columns aren't carried.

    Equal sets are represented by the least id before sets are compared. Sets are compared by 64-bit hashes.
    """
    rule = Rule(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    known = materialize(describe(rows, width))
    reps = materialize(known.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles")))
    length = countmin.length(rows)
    # Most features of a set must be repeated, so a sketch of half the usual size tells sets apart.
    bits, sketch = countmin.repeated(rows, length // 2, lambda texts: grouped(texts, width))
    edges = spread(rows, width, rule, countmin.shards(length), bits, sketch).groupBy("shard").applyInPandas(meet, "a long, b long")
    stars = connected(edges)
    countmin.forget(sketch)
    nodes = stars.select(F.col("a").alias("cluster"), F.col("b").alias("doc_id")).union(stars.select("a", "a").distinct())
    clusters = nodes.join(reps.select(F.col("rep").alias("doc_id"), "n_shingles").distinct(), "doc_id")
    tasks = materialize(meetings(clusters, rule))
    count = tasks.count()
    if BROADCAST_ROWS < count <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(tasks.select("doc_id")), "doc_id", "left_semi")
    held = rows.join(F.broadcast(tasks) if count <= BROADCAST_ROWS else tasks.hint("merge"), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for d, c, ts, s in zip(batch["doc_id"], batch["cluster"], batch["tasks"], shingle_sets(batch["text"].tolist(), width)):
                out += [(c, t["left"], t["right"], t["side"], d, s.tobytes()) for t in ts if len(s)]
            yield pd.DataFrame(out, columns=["cluster", "left", "right", "side", "doc_id", "features"])

    sent = held.mapInPandas(features, "cluster long, left string, right string, side int, doc_id long, features binary")
    sent = sent.repartition("cluster", "left", "right").sortWithinPartitions("cluster", "left", "right", "side", "doc_id")
    roots = connected(sent.mapInPandas(compare(rule), "a long, b long"))
    final = known.join(reps.select("digest", "rep"), "digest", "left").join(roots.select(F.col("b").alias("rep"), F.col("a").alias("root")), "rep", "left")
    return final.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))
