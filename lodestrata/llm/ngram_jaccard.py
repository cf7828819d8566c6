"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles (64-bit hashes).  Inside a group of documents that may be similar,
a query looks up the inverted lists of its shingles.  DivideSkip sets the longest lists aside, merges
the short ones by a heap, and probes the long ones by binary search for the documents that the merge
leaves; those that reach the required overlap are linked.

What may be similar is found exactly, in steps that each read less:
1. equal sets become one class, whose smallest id stands for it;
2. signatures (see signatures.py) of which similar sets share one; classes without a shared one go;
3. classes in which fewer shingles than any partner needs occur elsewhere go;
4. what is left forms clusters by shared signatures; those of more than one shard are formed again by
   pairs that share as many signatures as similar sets must (_refined), as single ones link by chance;
5. clusters are searched in shards of bounded size.

Scale: 2 and 3 are one exchange: each batch of texts sends its distinct keys, one a batch however
often it has them, so a passage that every document holds is one key a batch; keys are dealt into as
many parts as their number asks for.  Texts are shuffled once, sets never but for what step 3 leaves.
In a shard, a document that is linked to the hub needs no search of its own (a link that it would
find to one outside is found from there), so a group of near copies takes about one search a shard.
Only documents outside the largest component of a cluster ask in its other shards too, in groups of
bounded size; these rows are the documents outside times the cluster's shards.  What belongs to a cluster as a
whole is joined over SPREAD salts, so that a large one is many tasks' work.  Links leave a task as
spanning edges.  There is no cap on list lengths, candidates or partners.  Joins of tables that grow with
the documents are sort-merge joins at every size: no such table passes through the driver as a broadcast.

Defined cases: a null text counts as empty; a text without words has the empty set and links with
nothing; one with fewer words than a shingle has one element; documents with the same id are one
document; a null id links with nothing (component null); repeated rows repeat in the result; an empty
table gives no rows; other columns are ignored.  Jaccard similarity is exact but for collisions of
64-bit hashes inside one pair of documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, drop_stored, free_name, row_numbered, shards, stored
from .components import connected_components
from .embedding_dedup import _Forest
from .hashing import mix, shingle_sets
from .signatures import full_parts, signatures

#: Members, and elements, of one shard of a cluster.
SHARD_MEMBERS, SHARD_ELEMENTS = 1024, 2_000_000
#: Sets with one signature, up to which its pairs are counted one by one.
LIGHT = 256
#: Parts that the rows of one cluster are dealt into for a join by cluster.
SPREAD = 64
#: Elements of one part of an exchange of keys, about.
PART_ELEMENTS = 2_000_000


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _digest(elements: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64))
        b = mix(np.array([mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def set_index(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (digest of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in digests], pa.int64()), pa.array([b for _, b in digests], pa.int64())], ["doc_id", "n_shingles", "set_a", "set_b"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long")


_REQUEST = "p int, keys binary, places binary, owners binary"
_COUNTED = 1 << 31


def _requests(keys: np.ndarray, owners: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows to send for the keys of a batch: of every key one entry, marked where the batch itself
    has it from several owners, who are then counted at once in a row without keys."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[fresh], owners[fresh]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    start = np.flatnonzero(first)
    several = np.diff(np.append(start, len(keys))) > 1
    shared = np.repeat(several, np.diff(np.append(start, len(keys))))
    rows = []
    if shared.any():
        who, n = np.unique(owners[shared], return_counts=True)
        rows.append((int(who[0]) % parts, b"", n.astype(np.uint32).tobytes(), who.astype(np.int64).tobytes()))
    keys, owners = keys[start], owners[start]
    target = ((keys >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(target, kind="stable")
    for part in np.split(by, np.flatnonzero(np.diff(target[by])) + 1):
        if len(part):
            table, place = np.unique(owners[part], return_inverse=True)
            place = place.astype(np.uint32) | (several[part].astype(np.uint32) * np.uint32(_COUNTED))
            # six bytes tell the keys of one target apart well enough: a collision only keeps a document longer
            short = keys[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(target[part[0]]), np.ascontiguousarray(short).tobytes(), place.tobytes(), table.astype(np.int64).tobytes()))
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["p", "keys", "places", "owners"])


_COUNTS = "p int, owners binary, counts binary"


def _summed(owners: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    who, at = np.unique(np.concatenate(owners), return_inverse=True)
    return who, np.bincount(at, np.concatenate(counts), len(who)).astype(np.int64)


def _solve(group: list) -> tuple[np.ndarray, np.ndarray]:
    """(owners, how many of their keys in this group others have too)."""
    keys, owners, counted = (np.concatenate(x) for x in zip(*group))
    order = np.lexsort((owners, keys))
    keys, owners, counted = keys[order], owners[order], counted[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    other = np.concatenate([[0], np.cumsum((owners[1:] != owners[:-1]) & (keys[1:] == keys[:-1]))])
    several = (other[start + size - 1] - other[start] > 0) | np.logical_or.reduceat(counted, start)
    return np.unique(owners[np.repeat(several, size) & ~counted], return_counts=True)


def _count_shared(parts: int):
    """How many of its keys each owner shares, as far as one task sees; rows come sorted by p.

    Owners that go to the same task leave together, so rows grow with tasks and not with owners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, owners, counts = None, [], [], []

        def add(found: tuple) -> None:
            owners.append(found[0])
            counts.append(found[1])
            if len(owners) >= 16:
                owners[:], counts[:] = ([x] for x in _summed(owners, counts))

        for batch in batches:
            for p, keys, places, table in zip(*(c.to_pylist() for c in batch.columns)):
                table, marks = np.frombuffer(table, np.int64), np.frombuffer(places, np.uint32)
                if not keys:
                    add((table, marks))
                    continue
                if p != at and group:
                    add(_solve(group))
                    group = []
                at = p
                wide = np.zeros((len(marks), 8), np.uint8)
                wide[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
                group.append((wide.view("<u8").ravel(), table[marks & np.uint32(_COUNTED - 1)], marks >= _COUNTED))
        if group:
            add(_solve(group))
        if owners:
            who, n = _summed(owners, counts)
            target = (mix(who.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(target, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(target[by])) + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([int(target[part[0]])], pa.int32()), pa.array([who[part].tobytes()], pa.binary()), pa.array([n[part].tobytes()], pa.binary())], ["p", "owners", "counts"])

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, n) from what the tasks saw; rows come sorted by p."""

    def out(group: list) -> pa.RecordBatch:
        who, n = _summed(*zip(*group))
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n, pa.int64())], ["owner", "n"])

    at, group = None, []
    for batch in batches:
        for p, owners, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if p != at and group:
                yield out(group)
                group = []
            at = p
            group.append((np.frombuffer(owners, np.int64), np.frombuffer(counts, np.int64)))
    if group:
        yield out(group)


def _shared_counts(requests: DataFrame, parts: int) -> DataFrame:
    """(owner, n) of requests: how many of an owner's keys some other owner has too."""
    n = max(shards(requests.sparkSession), parts // 4)  # tasks; each takes its parts one by one
    seen = requests.repartition(n, "p").sortWithinPartitions("p").mapInArrow(_count_shared(2 * n), _COUNTS)
    return seen.repartition(n, "p").sortWithinPartitions("p").mapInArrow(_add_counts, "owner long, n long").filter("n > 0")


def _signature_requests(docs: DataFrame, size: int, threshold: float, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, np.ndarray] = {}
            for s in shingle_sets(batch.column(1), size):
                if len(s):
                    key = _digest(s)[0]
                    if key not in found:
                        found[key] = signatures(s, threshold)
            if found:
                owners = np.repeat(np.array(list(found), np.int64), [len(x) for x in found.values()])
                yield from _requests(np.concatenate(list(found.values())), owners, parts)

    return _texts(docs).mapInArrow(run, _REQUEST)


def _shingle_requests(texts: DataFrame, size: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            if any(map(len, sets)):
                yield from _requests(np.concatenate(sets), np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(s) for s in sets]), parts)

    return texts.select("rep", "text").mapInArrow(run, _REQUEST)


_SETS = "rep long, n long, full long, elements binary, signatures array<long>"


def _sets(texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The sets of texts, with their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            n = [len(s) for s in sets]
            marks = [signatures(s, num / den).view(np.int64).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([full_parts(s, num / den) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(marks, pa.list_(pa.int64()))], ["rep", "n", "full", "elements", "signatures"])

    return texts.select("rep", "text").mapInArrow(run, _SETS)


class InvertedIndex:
    """The inverted lists of some sets, and T-occurrence search in them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(s) for s in sets], np.int64)
        element = np.concatenate(sets)
        member = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((member, element))
        element, self.members = element[order], member[order]
        self.start = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
        self.elements = element[self.start]
        self.length = np.diff(np.append(self.start, len(element)))

    def search(self, query: np.ndarray) -> np.ndarray:
        """The members whose Jaccard similarity with the query reaches num / den."""
        at = np.minimum(np.searchsorted(self.elements, query), len(self.elements) - 1)
        at = at[self.elements[at] == query]
        # overlap >= t * union >= t * |query|
        least = -(-self.num * len(query) // self.den)
        if len(at) < least or not len(at):
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        longest = int(self.length[at[-1]])
        skip = min(int(least / (0.0085 * log2(longest + 1) + 1)), least - 1)
        lists = [self.members[self.start[i] : self.start[i] + self.length[i]] for i in at]
        short, long = lists[: len(lists) - skip], lists[len(lists) - skip :]
        found, counts = [], []
        last, n = -1, 0
        for m in heapq.merge(*(s.tolist() for s in short)):
            if m == last:
                n += 1
                continue
            if n >= least - skip and last >= 0:
                found.append(last)
                counts.append(n)
            last, n = m, 1
        if n >= least - skip and last >= 0:
            found.append(last)
            counts.append(n)
        found, counts = np.array(found, np.int64), np.array(counts, np.int64)
        for i, s in enumerate(long):
            if not len(found):
                break
            spot = np.minimum(np.searchsorted(s, found), len(s) - 1)
            counts += s[spot] == found
            enough = counts + (len(long) - i - 1) >= least
            found, counts = found[enough], counts[enough]
        union = len(query) + self.sizes[found] - counts
        return found[self.den * counts >= self.num * union]


_EDGES = "u long, v long"


def _search_shard(num: int, den: int, only_guests: bool):
    """Links of one shard: its members (guest = 0), and guests that only ask."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["guest"].to_pylist(), table["rep"].to_pylist(), table["elements"].to_pylist()), key=lambda r: r[:2])
        members = [(rep, np.frombuffer(e, np.uint64)) for guest, rep, e in rows if not guest]
        guests = [(rep, np.frombuffer(e, np.uint64)) for guest, rep, e in rows if guest]
        edges: list[tuple[int, int]] = []
        if members:
            index = InvertedIndex([s for _, s in members], num, den)
            forest = _Forest()
            asking = guests if only_guests else [*guests, *members]
            hub = asking[0][0] if asking else None
            for rep, s in asking:
                # whoever is linked to the hub need not ask: others find their links to it
                if not only_guests and rep != hub and forest.find(rep) == forest.find(hub):
                    continue
                for m in index.search(s).tolist():
                    if forest.join(rep, members[m][0]):
                        edges.append((rep, members[m][0]))
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})

    return run


def _for_clusters(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows left-joined with a table that has a row for each cluster of some size, over salts: the rows
    of one cluster are many tasks' work."""
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(SPREAD)).cast("int")).join(spread, ["cluster", "_salt"], "left").drop("_salt")


def _in_shards(n: str) -> Column:
    """Shards for the rows of a group, by their number and that of their elements."""
    return F.greatest(F.ceil(F.count("*") / SHARD_MEMBERS), F.ceil(F.sum(n) / SHARD_ELEMENTS)).cast("int")


def _clusters(near: DataFrame) -> DataFrame:
    return connected_components(near).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def _wide(clusters: DataFrame) -> DataFrame:
    return stored(clusters.groupBy("cluster").agg(_in_shards("n").alias("shards")).filter("shards > 1"), "wide")


def _refined(sets: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links such that similar ones of these members still meet in a cluster.

    The smaller set of a similar pair shares with the other all its full parts but those that their
    difference touches, which has (den - num) / (den + num) of both sizes at most.  Signatures of more
    than LIGHT sets link all that have them; a pair that shares none of these shares as many others as
    that.  Counting takes at most LIGHT / 2 numbers for each signature of a set, and no elements.
    """
    own = sets.select("rep", "n", "full", "signatures").join(members.select("rep").hint("merge"), "rep", "left_semi")
    lists = own.select("rep", "n", "full", F.explode("signatures").alias("element"))
    sizes = lists.groupBy("element").agg(F.min("rep").alias("hub"), F.count("*").alias("_sets")).filter("_sets > 1")
    marked = lists.join(sizes.hint("merge"), "element")
    heavy = marked.filter((F.col("_sets") > LIGHT) & (F.col("rep") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
    groups = marked.filter(F.col("_sets") <= LIGHT).groupBy("element").agg(F.array_sort(F.collect_list(F.struct("n", "rep", "full"))).alias("_all"))
    # of each set those that follow it, by size, and can reach the similarity by theirs
    each = groups.select(F.posexplode("_all").alias("_at", "_one"), "_all")
    later = F.filter(F.slice("_all", F.col("_at") + 2, F.size("_all")), lambda x: x["n"] * num <= F.col("_one.n") * den)
    sent = each.select(F.col("_one.rep").alias("u"), F.col("_one.n").alias("n"), F.col("_one.full").alias("full"), later.alias("_later")).filter(F.size("_later") > 0)
    sent = sent.select("u", "n", "full", F.transform("_later", lambda x: x["rep"]).alias("v"), F.transform("_later", lambda x: x["n"].cast("int")).alias("m"))
    pairs = sent.repartition("u").select("u", "n", "full", F.explode(F.arrays_zip("v", "m")).alias("_pair")).groupBy("u", "_pair.v", "_pair.m", "n", "full").agg(F.count("*").alias("shared"))
    enough = pairs.filter(F.col("shared") >= F.col("full") - F.expr(f"({den - num} * (n + m)) div {den + num}"))
    return heavy.union(enough.select("u", "v"))


def _links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links that connect whatever is connected by similarity."""
    lists = sets.select("rep", F.explode("signatures").alias("element"))
    hubs = lists.groupBy("element").agg(F.min("rep").alias("hub"), F.max("rep").alias("_last")).filter("hub <> _last").drop("_last")
    near = lists.join(hubs.hint("merge"), "element").filter("rep <> hub").select(F.col("hub").alias("u"), F.col("rep").alias("v")).distinct()
    light = stored(sets.select("rep", "n").join(_clusters(near).hint("merge"), "rep"), "clusters")
    wide = _wide(light)
    if not wide.isEmpty():
        # a table with a row for each wide cluster: a signature shared by chance chains many sets into few
        shards = _for_clusters(light, wide)
        members = stored(shards.filter("shards is not null").select("rep", "n"), "chained")
        again = members.join(_clusters(_refined(sets, members, num, den)).hint("merge"), "rep")
        before, light = (light, wide, members), stored(shards.filter("shards is null").select("rep", "n", "cluster").unionByName(again), "clusters")
        drop_stored(*before)
        wide = _wide(light)
    dealt = _for_clusters(light, wide).withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    home = stored(dealt.join(sets.select("rep", "elements").hint("merge"), "rep"), "members")
    asked = home.select("cluster", "shard", "rep", "elements", F.lit(0).alias("guest"))
    # the hub of a cluster asks in all of its shards
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    hub = home.filter("shards > 1 and rep = cluster").select("cluster", every.alias("to"), "rep", "elements", "shard").filter("`to` <> shard")
    first = asked.unionByName(hub.select("cluster", F.col("to").alias("shard"), "rep", "elements", F.lit(1).alias("guest")))
    first = stored(first.groupBy("cluster", "shard").applyInArrow(_search_shard(num, den, False), _EDGES), "links")
    if wide.isEmpty():
        return first
    # clusters of several shards: whoever is outside the largest component asks in other shards
    parts = connected_components(first).withColumnRenamed("node", "rep")
    placed = home.filter("shards > 1").select("rep", "n", "cluster", "shard", "shards").join(parts.hint("merge"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    largest = placed.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    outside = _for_clusters(placed, largest).filter("component <> largest")
    guests = stored(outside.select("cluster", every.alias("to"), "rep", F.col("n").alias("weight"), "shard").filter("`to` <> shard").drop("shard"), "guests")
    wide_home = home.filter("shards > 1")
    groups = guests.groupBy("cluster", "to").agg(_in_shards("weight").alias("groups"))
    every_group = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
    asking = guests.join(groups, ["cluster", "to"]).withColumn("group", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("groups")).cast("int"))
    asking = asking.select("cluster", F.col("to").alias("shard"), "group", "rep", F.lit(1).alias("guest")).join(wide_home.select("rep", "elements").hint("merge"), "rep")
    there = wide_home.select(*asked.columns[:4], F.lit(0).alias("guest")).join(groups.select("cluster", F.col("to").alias("shard"), every_group), ["cluster", "shard"])
    second = there.unionByName(asking).groupBy("cluster", "shard", "group").applyInArrow(_search_shard(num, den, True), _EDGES)
    return first.unionByName(stored(second, "links"))


def similar_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (smallest id that links reach)."""
    spark = docs.sparkSession
    num, den = percent, 100
    index = stored(set_index(docs, size), "sets")
    elements = index.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(4 * shards(spark), elements // PART_ELEMENTS)
    classes = index.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"))
    # step 2: classes that share a signature
    likely = _shared_counts(_signature_requests(docs, size, num / den, parts), parts).select(F.col("owner").alias("set_a"))
    wanted = stored(classes.join(likely.hint("merge"), "set_a", "left_semi"), "likely")
    drop_stored()
    ids = wanted.select("rep", "n").hint("merge")
    texts = _texts(docs).join(ids, F.col("doc_id") == F.col("rep")).select("rep", "n", "text")
    texts = stored(texts, "texts")
    drop_stored()
    # step 3: classes of which enough shingles occur elsewhere; fewer parts where step 2 has left less
    elements = wanted.agg(F.sum("n")).first()[0] or 0
    parts = max(4 * shards(spark), elements // PART_ELEMENTS)
    shared = _shared_counts(_shingle_requests(texts, size, parts), parts).withColumnRenamed("owner", "_rep").withColumnRenamed("n", "shared")
    enough = wanted.join(shared.hint("merge"), F.col("rep") == F.col("_rep")).filter(F.col("shared") * den >= F.col("n") * num).select("rep")
    kept = texts.join(stored(enough, "enough").hint("merge"), "rep", "left_semi")
    sets = stored(_sets(kept, size, num, den), "kept")
    drop_stored(wanted, texts)
    component = stored(connected_components(_links(sets, num, den)).withColumnRenamed("node", "rep"), "components")
    drop_stored(sets)
    named = classes.join(component.hint("merge"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    joined = index.join(named.hint("merge"), ["set_a", "set_b"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one_of_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without those that links join to one with a smaller doc_id.

    Rows are linked by numbers of their own, so ids may repeat or be null (null ids come last).
    """
    row = free_name("_row", *docs.columns)
    numbered = row_numbered(docs, row)
    found = similar_documents(numbered.select(F.col(row).alias("doc_id"), "text"), size, percent)
    members = found.select(F.col("doc_id").alias(row), "component_id").join(numbered.select(row, F.col("doc_id").cast("long").alias("_id")).hint("merge"), row)
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", row)).alias("_best")).select(F.col(f"_best.{row}").alias(row))
    return numbered.join(stored(best, "stays").hint("merge"), row, "left_semi").drop(row)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), size=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w),
p AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n
      FROM p a JOIN p b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM o WHERE 100 * c >= 90 * (m + n - c)),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, min(v) AS component_id
FROM s JOIN reach ON u = s.doc_id GROUP BY s.doc_id, len(shingles)
"""
