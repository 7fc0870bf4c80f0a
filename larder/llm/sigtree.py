"""N-gram Jaccard join by signature trees.

Documents with equal shingle sets are one class, and only its smallest id goes on. Every class has a bitmap of 8 to 16 bits
per shingle, and a brief one of 2 to 4 bits for the trees. Two sets at the threshold share one of their first n - ceil(t n) + 1 shingles in any common order, so the
classes are dealt into buckets by those, in the order of a counted rarity: a passage that many documents share comes last
and makes no bucket. Over the members of a bucket stands a signature tree: a node holds the OR of its members' bitmaps,
the range of their sizes, and how many shingles of a member share a bit at most. What two nodes can have in common at most
is the number of their common bits plus that slack, and no more than their sizes; where that is less than the threshold asks of
their smallest sizes, dual traversal leaves the pair of nodes, else it goes on to their children. Nodes of one and
the same component are left as well.

A bucket's first member is tested against the others before, so that a group of near copies is one component when its tree is
walked, and buckets of two are done. Members without another one of their bucket near enough in size do not enter its tree; in buckets of
at most ``FEW`` members pairs are counted first, without bitmaps: a link shares many of the first shingles of large sets, so a pair
that meets too rarely is left out, and any other stands in one tree instead of one for each shingle it shares. A walk names for each component its most promising pairs, full sets confirm them, and as long as a walk had to hold
pairs back it is repeated over what is still apart, with 16 times the room: no link is lost, and a group is never turned into
all its pairs. A large bucket is cut into nodes of ``BLOCK`` members first, which are met pair by pair in tasks of their own.

Null and empty texts have no shingles and no links. A null id links with nothing, its component is null. Rows sharing an id
are one document, and its texts are linked. Equal rows are answered once each, an empty
table gives no rows, other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from larder.llm import tokens
from larder.llm.common import broadcast_if_small, rows_per_batch, written
from larder.llm.components import components
from larder.llm.neardup import sets
from larder.llm.tokens import U, mix

SLOTS = 1 << 18  # counters of shingle rarity
BLOCK, BLOCK_BYTES = 512, 1 << 22  # members and bitmap bytes of the largest node of a bucket
FANOUT = 8
FEW = 64  # members of a bucket whose pairs are counted before bitmaps travel
ROOM = 16  # pairs a component may name in the first walk
_SEEDS = mix(np.array([11, 23], dtype=U))


def _slot(v: np.ndarray) -> np.ndarray:
    return (v >> U(64 - 18)).astype(np.int64)


# ---- rarity, bitmaps, prefixes --------------------------------------------------------

def _count_slots(width: int):
    def run(batches):
        n = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for i, j, data, at in tokens.walk(batch.column("text")):
                h, row = tokens.word_hashes(data, at)
                n += np.bincount(_slot(tokens.shingles(h, row, j - i, width)[0]), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    return run


def rarity(docs: DataFrame, width: int) -> np.ndarray:
    """A class of rarity for each of SLOTS groups of shingles, eight classes per doubling of their number, counted over all
    documents; class 0 holds at most one. It only orders shingles: any order gives the same links."""
    counted = docs.select("text").mapInArrow(_count_slots(width), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, dtype=np.uint8)
    got = counted.toArrow()  # at most SLOTS rows
    out[got["slot"].to_numpy()] = np.minimum(255, 8 * np.log2(got["n"].to_numpy())).astype(np.uint8)
    return out


def bitmap(v: np.ndarray, per: int = 8, least: int = 64) -> bytes:
    """``per`` to twice as many bits per shingle, at least ``least``; the bit is the low bits of the hash, so that halves folded together are the smaller bitmap."""
    m = least
    while m < per * len(v):
        m *= 2
    bits = np.zeros(m, dtype=np.uint8)
    bits[(v & U(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(bits: int, size: int, to: int) -> int:
    """A bitmap of ``size`` bits as one of ``to`` bits."""
    while size > to:
        size //= 2
        bits = (bits >> size) | (bits & ((1 << size) - 1))
    return bits


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _sign(width: int, percent: int, classes):
    def run(batches):
        rare = classes.value
        for batch in batches:
            n = batch.num_rows
            size, sums, bits, brief, first_few = np.zeros(n, dtype=np.int64), np.zeros((2, n), dtype=U), [None] * n, [None] * n, [None] * n
            for i, j, data, at in tokens.walk(batch.column("text")):
                h, row = tokens.word_hashes(data, at)
                v, r = tokens.shingles(h, row, j - i, width)
                if not len(v):
                    continue
                full, first, count = np.unique(r, return_index=True, return_counts=True)
                size[i + full] = count
                for k in (0, 1):
                    sums[k][i + full] = np.add.reduceat(mix(v ^ _SEEDS[k]), first)
                kind = rare[_slot(v)]
                order = np.lexsort((v, kind, r))
                wanted = (np.arange(len(v)) - np.repeat(first, count) < np.repeat(prefix_length(count, percent), count)) & (kind[order] > 0)
                for k, a, c in zip(full, first, count):
                    bits[i + k], brief[i + k] = bitmap(v[a: a + c]), bitmap(v[a: a + c], 2, 1024)
                    first_few[i + k] = v[order[a: a + c][wanted[a: a + c]]].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(bits, pa.binary()),
                 pa.array(brief, pa.binary()), pa.array(first_few, pa.list_(pa.int64()))], names=["id", "n", "sa", "sb", "bits", "brief", "prefix"])

    return run


# ---- tree and traversal -----------------------------------------------------------------

class Node:
    """Bitmap of ``size`` bits, sizes from ``low`` to ``high``, ``slack`` (how many shingles of a member share a bit at most),
    the component if it is one, and the members or children below."""

    __slots__ = ("bits", "size", "low", "high", "slack", "component", "below", "id", "smaller")

    def __init__(self, below: list[Node], member: tuple | None = None):
        self.below, self.smaller = below, {}
        if member is not None:
            self.id, self.low, self.component, raw = member
            self.high, self.bits, self.size = self.low, int.from_bytes(raw, "little"), 8 * len(raw)
            self.slack = self.low - self.bits.bit_count()
            return
        self.size = min(x.size for x in below)
        self.bits, self.slack = 0, 0
        for x in below:
            bits, slack = x.at(self.size)
            self.bits, self.slack = self.bits | bits, max(self.slack, slack)
        self.low, self.high = min(x.low for x in below), max(x.high for x in below)
        one = {x.component for x in below}
        self.component, self.id = one.pop() if len(one) == 1 else None, None

    def at(self, size: int) -> tuple[int, int]:
        """(bits, slack) with the bitmaps folded to ``size`` bits, where more shingles of a member share one."""
        if size == self.size:
            return self.bits, self.slack
        if size not in self.smaller:
            bits = fold(self.bits, self.size, size)
            self.smaller[size] = bits, max(x.at(size)[1] for x in self.below) if self.below else self.low - bits.bit_count()
        return self.smaller[size]


def tree(members: list[tuple]) -> Node:
    """Over (id, shingles, component, bitmap), members of one component and near size side by side."""
    level = [Node([], m) for m in sorted(members, key=lambda m: (m[2], m[1], m[0]))]
    while len(level) > 1:
        level = [Node(level[i: i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def most_common(x: Node, y: Node) -> int:
    """The most shingles a member of one can have in common with a member of the other."""
    size = min(x.size, y.size)
    (p, s), (q, t) = x.at(size), y.at(size)
    return min(x.high, y.high, (p & q).bit_count() + min(s, t))


def possible(x: Node, y: Node, percent: int) -> bool:
    """Whether a member of one may link with a member of the other; the smallest sizes ask for the least in common."""
    if 100 * min(x.high, y.high) < percent * max(x.low, y.low):
        return False
    return (100 + percent) * most_common(x, y) >= percent * (x.low + y.low)


def walk(x: Node, y: Node, percent: int):
    """(likeness, member, member) of the pairs in different components that no pair of nodes above them rules out."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if x.component is not None and x.component == y.component or not possible(x, y, percent):
            continue
        if not x.below and not y.below:
            yield most_common(x, y) / (x.low + y.low), x, y
        elif x is y:
            stack += combinations_with_replacement(x.below, 2)
        else:
            stack += product(x.below or [x], y.below or [y])


def _named(percent: int, room: int):
    def run(batches):
        for batch in batches:
            out = {"a": [], "b": [], "more": []}
            for row in batch.to_pylist():
                left = tree([tuple(m.values()) for m in row["members"]])
                right = tree([tuple(m.values()) for m in row["others"]]) if row["others"] is not None else left
                found = sorted(((s, x.id, x.component, y.id, y.component) for s, x, y in walk(left, right, percent)), reverse=True)
                used, held = Counter(), False
                for _, a, p, b, q in found:
                    if min(used[p], used[q]) >= room:
                        held = True
                        continue
                    used.update((p, q))
                    out["a"].append(min(a, b))
                    out["b"].append(max(a, b))
                    out["more"].append(False)
                if held:
                    out["more"][-1] = True
            kind = batch.schema.field("members").type.value_type.field("id").type
            yield pa.RecordBatch.from_arrays([pa.array(out["a"], kind), pa.array(out["b"], kind), pa.array(out["more"], pa.bool_())], names=["a", "b", "more"])

    return run


def _blocks(batches):
    """Runs of one bucket's members, cut into nodes."""
    name = TaskContext.get().partitionId() << 40
    for batch in batches:
        schema = batch.schema
        member = pa.struct([(c, schema.field(c).type) for c in ("id", "n", "component", "bits")])
        out = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("members", pa.list_(member))])
        rows, size = [], 0
        for r in batch.to_pylist():
            token = r.pop("token")
            size += len(r["bits"])
            if not rows or token != rows[-1]["token"] or len(rows[-1]["members"]) >= BLOCK or size > BLOCK_BYTES:
                name += 1
                rows.append({"token": token, "node": name, "low": r["n"], "high": r["n"], "members": []})
                size = len(r["bits"])
            rows[-1]["members"].append(r)
            rows[-1]["low"], rows[-1]["high"] = min(rows[-1]["low"], r["n"]), max(rows[-1]["high"], r["n"])
        yield pa.RecordBatch.from_pylist(rows, out)


def _meetings(buckets: DataFrame, sizes: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, token): pairs of different components that meet in as many buckets of at most FEW members as a link asks for, and one of these.

    Of a link's common shingles at most n - prefix are outside the prefix that ends first, so all others are buckets of both. A link
    with one of them in a larger bucket is left to that bucket.
    """
    few = buckets.where(F.col("members") <= FEW).join(joined, "id", "left").join(sizes, "id").select(
        "token", F.struct("id", "n", F.coalesce("component", "id").alias("component")).alias("m"))
    groups = few.groupBy("token").agg(F.collect_list("m").alias("ms"), F.min("m.component").alias("x"), F.max("m.component").alias("y")).where("x <> y")
    two = groups.select("token", "ms", F.explode("ms").alias("p")).select("token", "p", F.explode("ms").alias("q")).where(
        "p.id < q.id AND p.component <> q.component").where(f"100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n)")
    met = two.groupBy(F.col("p.id").alias("a"), F.col("q.id").alias("b"), F.col("p.n").alias("na"), F.col("q.n").alias("nb")).agg(
        F.count(F.lit(1)).alias("met"), F.min("token").alias("token"))
    outside = [f"({percent} * {n} + 99) div 100 - 1" for n in ("na", "nb")]
    asked = f"({percent} * (na + nb) + {99 + percent}) div {100 + percent}"
    return met.where(f"met >= {asked} - greatest({outside[0]}, {outside[1]})").drop("met")


def _pairs_of_trees(buckets: DataFrame, meetings: DataFrame, signed: DataFrame, joined: DataFrame, percent: int, room: int) -> DataFrame:
    """(a, b, more): what the walks over all buckets that hold several components name."""
    to = joined.select("id", "component")
    open_ = meetings.join(to.toDF("a", "ca"), "a", "left").join(to.toDF("b", "cb"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    met = open_.select("token", F.col("a").alias("id"), F.col("na").alias("n"), "ca").unionByName(
        open_.select("token", F.col("b").alias("id"), F.col("nb").alias("n"), F.col("cb").alias("ca"))).distinct().select(
        "token", "id", "n", F.coalesce("ca", "id").alias("component"))
    of = buckets.where(F.col("members") > FEW).join(joined, "id", "left").join(signed.select("id", "n").distinct(), "id").select(
        "token", "id", "n", F.coalesce("component", "id").alias("component"))
    # whose neighbour in size is already too far off has no partner in the bucket
    by_size = Window.partitionBy("token").orderBy("n", "id")
    of = of.withColumns({"lower": F.lag("n").over(by_size), "upper": F.lead("n").over(by_size)}).where(
        (100 * F.col("lower") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("upper"))).drop("lower", "upper").unionByName(met)
    apart = of.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("q")).where("x <> y")
    apart = apart.groupBy("members", "p", "q").agg(F.min("token").alias("token")).select("token")  # one of the buckets with the same members
    placed = written(of.join(apart, "token"), "placed")
    own = signed.select("id", F.col("brief").alias("bits")).join(broadcast_if_small(placed.select("id").distinct()), "id", "left_semi")
    rows = placed.join(own, "id").select("token", "id", "n", "component", "bits")
    order = ["token", "component", "n", "id"]
    kind = rows.schema["id"].dataType.simpleString()
    member = f"struct<id: {kind}, n: bigint, component: {kind}, bits: binary>"
    nodes = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _blocks, f"token long, node long, low long, high long, members array<{member}>"), "nodes")
    several = nodes.join(broadcast_if_small(nodes.groupBy("token").count().where("count > 1").select("token")), "token")
    other = several.select("token", F.col("node").alias("node_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.col("members").alias("others"))
    two = several.join(other, "token").where(
        (F.col("node") < F.col("node_b")) & (100 * F.least("high", "high_b") >= percent * F.greatest("low", "low_b"))).select("members", "others")
    one = nodes.select("members", F.lit(None).cast(other.schema["others"].dataType).alias("others"))
    return one.unionByName(two).mapInArrow(_named(percent, room), f"a {kind}, b {kind}, more boolean")


# ---- the join -----------------------------------------------------------------------------

def _bound(percent: int):
    """Pairs that their bitmaps do not rule out."""
    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("na", "bits_a", "nb", "bits_b")]
            ok = [possible(Node([], (0, na, 0, ba)), Node([], (1, nb, 1, bb)), percent) for na, ba, nb, bb in zip(*cols)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _confirm(width: int, percent: int):
    """Pairs whose full sets are near enough."""
    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()
            texts = list(dict.fromkeys(a + b))
            of = dict(zip(texts, sets(texts, width)))
            ok = []
            for x, y in zip(a, b):
                both = len(np.intersect1d(of[x], of[y], assume_unique=True))
                ok.append(100 * both >= percent * (len(of[x]) + len(of[y]) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def jaccard_components(df: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles (long), component_id (smallest id reachable by links).

    Links: 100 * intersection >= percent * union of the ``width``-word shingle sets.
    """
    spark = df.sparkSession
    rows_per_batch(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    pair = f"a {kind}, b {kind}"
    rare = spark.sparkContext.broadcast(rarity(docs, width))
    signed = written(docs.mapInArrow(_sign(width, percent, rare), f"id {kind}, n long, sa long, sb long, bits binary, brief binary, prefix array<long>"), "signed")
    # of each class the smallest id goes on; the others are told by a narrow list, so that the bitmaps are neither shuffled nor written again
    own = signed.where("n > 0 AND id IS NOT NULL")
    least = written(own.groupBy("sa", "sb", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    copies = own.select("id", "sa", "sb", "n").join(least.where("rows > 1"), ["sa", "sb", "n"]).where("id <> rep").select("id", "sa", "sb").distinct()
    classes = own.join(broadcast_if_small(written(copies, "copies")), ["id", "sa", "sb"], "left_anti")
    posts = classes.select("id", F.explode("prefix").alias("token"))
    shared = posts.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("members")).where(
        "first <> last").select("token", "first", "members")
    buckets = written(posts.join(shared, "token"), "buckets")
    sizes = classes.select("id", "n").distinct()

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def test(pairs: DataFrame) -> DataFrame:
        """The pairs that bitmaps and full sets confirm."""
        sized = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(
            sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        sized = written(sized.distinct(), "sized")
        own = classes.select("id", "bits").join(broadcast_if_small(ends(sized)), "id", "left_semi")
        p = sized.join(own.select(F.col("id").alias("a"), F.col("bits").alias("bits_a")), "a").join(
            own.select(F.col("id").alias("b"), F.col("bits").alias("bits_b")), "b")
        close = written(p.mapInArrow(_bound(percent), pair), "close")
        texts = written(docs.join(broadcast_if_small(ends(close)), "id", "left_semi"), "texts")
        full = close.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), pair)

    rows = signed.select("id", "n", "sa", "sb").join(
        least.drop("rows"), ["sa", "sb", "n"], "left").select("id", "n", "rep")
    # an id with several texts links their classes
    several = rows.where("rep IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    same = rows.join(several.select("id", "a"), "id").select("a", F.col("rep").alias("b"))

    entry = buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    joined, tested, room = written(components(test(entry).unionByName(same)), "joined"), entry, ROOM
    meetings = written(_meetings(buckets, sizes, joined, percent), "meetings")
    while True:
        untested = meetings.join(tested, ["a", "b"], "left_anti")
        named = written(_pairs_of_trees(buckets, untested, classes, joined, percent, room), "named")
        fresh = written(named.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
        links = joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(test(fresh))
        joined = written(components(links), "joined")
        if named.where("more").isEmpty():
            break
        tested, room = tested.unionByName(fresh), room * 16
    out = rows.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
