"""Near-duplicate components by an exact Jaccard join of word shingles with adaptive multi-match prefixes.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles in hash order. Two sets of sizes a and b with
similarity t or more share at least ``alpha = ceil(t / (1 + t) * (a + b))`` hashes, and for every l up to ``ceil(t * size)``
they share l of the first ``size - ceil(t * size) + l`` of each. The join goes on as follows; every step is exact:

1. Equal sets are one class, told apart by 128 bits. From each class the prefix for ``1 + spare`` matches is kept.
2. Hubs: classes that share half of their first ``KEYS`` hashes with the most typical holder of those are verified against
   it, and in a crowd, if that one is out of reach, against the
   crowd's most central members. Linked ones form a star; pairs inside a star need no more work, and hashes held by one star only are left out.
3. Families, stars of ``FAMILY`` members or more, never meet member by member unless they must: hubs that are linked join two families at
   once; else the distance of the hubs, less what their members are away from them, rules out most members (1 - similarity is
   a metric), the rest are measured against the other hub, and only those that may still reach a member there meet.
4. Lengths: a hash held by ``HOT`` stars or more is hot and makes no candidates. Each class lengthens its prefix: of all l
   that leave at least one match on cold hashes, it takes the one with the least estimated cost, the number of postings
   and the candidates that they can make with l matches. A pair must share as many cold hashes as the one with the
   smaller l asks for. In a posting list, only holders outside its largest star look for partners.
5. Classes with so many hot hashes that no l of the kept prefix leaves a match are joined among themselves on their whole
   sets, by prefixes of the rarest hashes, which take the sizes of both into account.
6. Candidates are verified on whole sets, which are made only for the classes in candidates. Links and stars are joined to
   components by the large-star and small-star rounds.

Shingles are told apart by 64-bit hashes. Defined results: null, empty and blank texts have an empty set, link with nothing
and are their own component; fewer words than a shingle are one shingle; repeated rows get equal results, one for each; a
row without id gets its set size and no component, and links nothing; an empty table has no result. Very long texts are blocks of their own in
memory. Only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import kept_fields, map_arrow
from fettle.llm.tables import Tables
from fettle.session import settle

PERCENT = 85
SHINGLE = 4
KEYS = 8
#: Candidates of one hub from which on its most central members are tried as well, and how many of them.
CROWD = 64
CENTRAL = 3
HOT = 48
#: Members from which on a star meets another such star by its hub first.
FAMILY = 8
SLACK = 1e-9
#: What a candidate costs, in postings: its two whole sets are moved.
CANDIDATE = 100
LONG = T.LongType()
LONGS = T.ArrayType(LONG)


def least_shared(n, percent: int):
    """``ceil(t * n)``."""
    return -(-percent * n // 100)


def prefix(n, percent: int):
    """How many hashes come before the last ``ceil(t * n) - 1``."""
    return n - least_shared(n, percent) + 1


def spare(n, percent: int):
    """How many matches beyond the first the kept prefix serves."""
    return 4 + prefix(n, percent) // 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    starts, ends, bounds = B.words(data, offsets, B.NOT_BLANK)
    h = B.hash_spans(data, starts, ends)
    factor = [B.mix(np.array([B.BASE + 2 * k + 1], np.uint64))[0] | np.uint64(1) for k in range(size)]
    n = max(0, len(h) - size + 1)
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed += h[k : k + n] * factor[k]
    mixed = B.mix(mixed).view(np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(mixed[a : b - size + 1])
        elif b > a:
            short = sum((h[a + k] * factor[k] for k in range(b - a)), start=np.uint64(b - a))
            yield B.mix(np.array([short], np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def signature(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    return tuple(int(B.mix(u ^ np.uint64(salt)).sum().view(np.int64)) for salt in (0x51ED270B0F0F0F0F, 0xA0761D6478BD642F))


def _sets(batches: Iterator[pa.RecordBatch], text: str, kept: list[str], size: int, percent: int, whole: bool | None, members, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The kept columns, n, k1, k2 and with ``whole`` the set (true) or its kept prefix (false).

    ``members`` is a Bloom filter on the bits in ``__bit``: rows that it stops are left out.
    """
    with np.errstate(over="ignore"):
        for batch in batches:
            if members is not None:
                bit = batch["__bit"].to_numpy()
                batch = batch.filter(pa.array((members.value[bit >> 6] >> (bit & 63)) & 1 == 1))
            for first, end, data, offsets in B.blocks(batch[text]):
                sizes, keys, lists = [], [], []
                for s in shingle_sets(B.LOWER[data], offsets, size):
                    sizes.append(len(s))
                    keys.append(signature(s) if len(s) else (0, 0))
                    lists.append(s if whole else s[: prefix(len(s), percent) + spare(len(s), percent)])
                own = [pa.array(sizes, pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64())]
                if whole is not None:
                    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    own.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate(lists))).cast(schema.field(len(kept) + 3).type))
                yield pa.RecordBatch.from_arrays([batch[c].slice(first, end - first) for c in kept] + own, schema=schema)


def sets(docs: DataFrame, text: str, keep: list[str], whole: bool | None, size: int = SHINGLE, percent: int = PERCENT, members=None) -> DataFrame:
    """``keep`` of ``docs`` with __n, __k1, __k2 and, unless ``whole`` is None, __set."""
    rows = docs.select(*dict.fromkeys([*keep, text, *(["__bit"] if members else [])]))
    fields = kept_fields(rows, keep) + [T.StructField(k, LONG) for k in ("__n", "__k1", "__k2")]
    fields += [T.StructField("__set", LONGS)] if whole is not None else []
    return map_arrow(rows, _sets, fields, text=text, kept=keep, size=size, percent=percent, whole=whole, members=members)


# --- Bloom filter: a bounded reducer before a join by id ---------------------------------------------------------------

BLOOM_BITS = 1 << 23


def bloom(ids: DataFrame, key: str) -> np.ndarray:
    """A filter of ``BLOOM_BITS`` bits, 1 MB whatever the number of ids; a full one lets every row through."""
    bit = F.pmod(F.xxhash64(key), F.lit(BLOOM_BITS))
    words = ids.select(F.floor(bit / 64).cast("int").alias("w"), (bit % 64).cast("int").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("v"))
    bits = np.zeros(BLOOM_BITS // 64, np.int64)
    for batch in [rows.toArrow()]:
        bits[batch["w"].to_numpy()] = batch["v"].to_numpy()
    return bits


def sets_of(docs: DataFrame, id_col: str, text: str, members: DataFrame, label: str, size: int, percent: int, settle=settle) -> DataFrame:
    """(c, set) of the classes in ``members`` (c, rep, __n, __k1, __k2): their documents are read again."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bloom(members, "rep"))
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(BLOOM_BITS)).alias("__bit"))
    rows = rows.where("rep IS NOT NULL")
    found = sets(rows, "text", ["rep"], True, size, percent, shared).dropDuplicates(["rep", "__n", "__k1", "__k2"])
    return settle(found.join(members, ["rep", "__n", "__k1", "__k2"]).select("c", F.col("__set").alias("set")), label)


# --- links and components ----------------------------------------------------------------------------------------------


def sized(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def shared_sizes(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs`` (c1, c2, ...) with ``both`` and ``either``, the sizes of the intersection and of the union; row by row, on the JVM."""
    joined = pairs.join(of.select(F.col("c").alias("c1"), F.col("set").alias("s1")), "c1").join(of.select(F.col("c").alias("c2"), F.col("set").alias("s2")), "c2")
    counted = joined.withColumn("both", F.size(F.array_intersect("s1", "s2")))
    return counted.withColumn("either", F.size("s1") + F.size("s2") - F.col("both")).drop("s1", "s2")


def alike(percent: int) -> Column:
    return 100 * F.col("both") >= percent * F.col("either")


def distance() -> Column:
    return 1 - F.col("both") / F.col("either").cast("double")


def verified(pairs: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """The pairs (c1, c2) whose sets are similar enough, and their distance d."""
    return shared_sizes(pairs, of).where(alike(percent)).select("c1", "c2", distance().alias("d"))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(c, root): the smallest node reachable from each node of ``links`` (c1, c2); large-star and small-star rounds.

    Each round is written to the shared folder; sums of all edges tell when nothing moves.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        """Hang the larger (or, with ``small``, the smaller and own) neighbours of each node on its smallest one."""
        way = edges.select(F.col("c1").alias("u"), F.col("c2").alias("v"))
        both = way if small else way.unionByName(edges.select(F.col("c2").alias("u"), F.col("c1").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = both.join(least, "u")
        moved = hung.select(F.col("v").alias("a"), F.col("m").alias("b")) if small else hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))) if small else moved
        return moved.where("a <> b").select(F.greatest("a", "b").alias("c1"), F.least("a", "b").alias("c2")).distinct()

    edges, before = settle(links.where("c1 <> c2").select(F.greatest("c1", "c2").alias("c1"), F.least("c1", "c2").alias("c2")).distinct(), label), None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("c1", "c2").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("c1").alias("c"), F.col("c2").alias("root"))
        edges, before = settle(star(star(edges, False), True), label), seen


# --- candidates ----------------------------------------------------------------------------------------------------------


def chosen_length(n: int, places: np.ndarray, df: np.ndarray, percent: int, hot: int = HOT) -> tuple[int, int]:
    """(l, cold matches asked for) of the least estimated cost; (0, 0) if no l leaves a match on cold hashes.

    ``places`` and ``df`` are those of the hashes that several stars hold.
    """
    start = prefix(n, percent)
    most = min(least_shared(n, percent), spare(least_shared(n, percent), percent) + 1)
    length = np.arange(1, most + 1)
    often = df >= hot
    upto = np.searchsorted(places, start + length - 1)
    asked = length - np.concatenate([[0], np.cumsum(often)])[upto]
    postings = np.concatenate([[0], np.cumsum(np.where(often, 0, df))])[upto]
    partners = np.concatenate([[0], np.cumsum(np.where(often, 0, df - 1))])[upto]
    cost = np.where(asked >= 1, postings + CANDIDATE * partners / np.maximum(asked, 1), np.inf)
    best = int(np.argmin(cost))
    return (int(length[best]), int(asked[best])) if np.isfinite(cost[best]) else (0, 0)


def _lengthen(batches: Iterator[pa.RecordBatch], percent: int, hot: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = batch["held"]
        at = held.offsets.to_numpy()
        place, df, tok = (held.values.field(k).to_numpy() for k in ("pos", "df", "tok"))
        length, asked, use = [], [], np.zeros(len(place), bool)
        for n, a, b in zip(batch["__n"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            one, need = chosen_length(n, place[a:b], df[a:b], percent, hot)
            end = prefix(n, percent) + (one - 1 if one else spare(n, percent))
            use[a:b] = (df[a:b] < hot) & (place[a:b] < end)
            length.append(one)
            asked.append(need)
        kept = np.concatenate([[0], np.cumsum(use)])[at].astype(np.int32)
        lists = {k: pa.ListArray.from_arrays(kept, pa.array(x[use].astype(np.int64))) for k, x in (("toks", tok), ("places", place))}
        own = {"length": pa.array(length, pa.int64()), "asked": pa.array(asked, pa.int64())} | lists
        columns = [own[f.name].cast(f.type) if f.name in own else batch[f.name] for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def with_stars(rows: DataFrame, least: int = 2) -> DataFrame:
    """``rows`` (tok, star, ...) of hashes held by ``least`` stars or more, with df (stars) and big (the largest star).

    The counts are written first: a join of two plain shuffles lets Spark split the rows of a frequent hash.
    """
    held = rows.groupBy("tok", "star").agg(F.count(F.lit(1)).alias("n")).groupBy("tok")
    of = held.agg(F.count(F.lit(1)).alias("df"), F.max_by("star", F.struct("n", "star")).alias("big")).where(F.col("df") >= least)
    return rows.join(settle(of, "stars"), "tok")


def meetings(postings: DataFrame, reach: DataFrame, percent: int, more: list[str]) -> DataFrame:
    """Pairs of classes of different stars that hold the same hash, once for each hash; columns end with 1 and 2.

    Only holders outside the largest star of a hash look for partners, so a large star costs its size and not its square. Members of
    two families meet only where ``reach`` (c, star, other) says that either may reach the other family.
    """
    names = ["c", "star", "__n", *more]
    side = lambda df, k: df.select("tok", *[F.col(x).alias(f"{x}{k}") for x in names], F.col("fam").alias(f"fam{k}"), (F.col("star") == F.col("big")).alias(f"in_big{k}"))
    left, right = side(postings.where("star <> big"), 1), side(postings, 2)
    # holders without a family meet all; of two without, each pair once
    single = left.where("NOT fam1").join(right, "tok").where(F.col("in_big2") | F.col("fam2") | (F.col("c1") < F.col("c2")))
    # a family meets those of the largest star, unless that is one too
    to_big = left.where("fam1").join(right.where("in_big2 AND NOT fam2"), "tok")
    near = postings.where("fam").join(reach.select("c", "other"), "c").withColumns({"lo": F.least("star", "other"), "hi": F.greatest("star", "other")})
    one, two = (near.where(F.col("star") == F.col(x)).select("tok", "lo", "hi", *[F.col(c).alias(f"{c}{k}") for c in names]) for k, x in ((1, "lo"), (2, "hi")))
    columns = [f"{x}{k}" for x in names for k in (1, 2)]
    met = single.where("star1 <> star2").select(*columns).unionByName(to_big.select(*columns)).unionByName(one.join(two, ["tok", "lo", "hi"]).select(*columns))
    met = met.where(sized(F.col("__n1"), F.col("__n2"), percent))
    swap = F.col("c1") > F.col("c2")
    pick = lambda x, k: F.when(swap, F.col(f"{x}{3 - k}")).otherwise(F.col(f"{x}{k}")).alias(f"{x}{k}")
    return met.select(*[pick(x, k) for x in ("c", "__n", *more) for k in (1, 2)])


def star_members(ties: DataFrame) -> DataFrame:
    """(c, star, away, fam): the members of all stars, hubs too, with a bound on their distance from the hub, and whether the star is a family."""
    next_ = ties.select(F.col("c1").alias("c2"), F.col("c2").alias("c3"), F.col("d").alias("d2"))
    own = ties.join(next_, "c2", "left").select(F.col("c1").alias("c"), F.coalesce("c3", "c2").alias("star"), (F.col("d") + F.coalesce("d2", F.lit(0.0))).alias("away"))
    sizes = own.groupBy("star").agg((F.count(F.lit(1)) + 1 >= FAMILY).alias("fam"))
    hubs = sizes.select(F.col("star").alias("c"), "star", F.lit(0.0).alias("away"), "fam")
    # a class may be a hub and hang on another one: it belongs to the star that it hangs on
    return settle(own.join(sizes, "star").select("c", "star", "away", "fam").unionByName(hubs.join(own.select("c"), "c", "left_anti")), "members")


def family_reach(starred: DataFrame, members: DataFrame, of: DataFrame, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(links, reach): links (c1, c2) that join two families, and the members (c, star, other) of families that may link with one of another.

    Families are compared where they share a cold hash. Once a hub links with the other hub or with any of its members, nothing more is
    asked of the two: they are one component. Else a member x of one is linked with a y of the other only if
    d(hubs) <= d(x, own hub) + (1 - t) + d(y, its hub), and d(x, other hub) <= (1 - t) + d(y, its hub).
    """
    held = starred.where(F.col("fam") & (F.col("df") < hot)).select("tok", "star").distinct()
    pairs = held.select("tok", F.col("star").alias("c1")).join(held.select("tok", F.col("star").alias("c2")), "tok").where("c1 < c2").select("c1", "c2").distinct()
    hubs = settle(shared_sizes(settle(pairs, "families"), of), "hub-distances")
    joined = hubs.where(alike(percent)).select("c1", "c2")
    apart = hubs.where(~alike(percent)).select("c1", "c2", distance().alias("d"))
    both = apart.select(F.col("c1").alias("star"), F.col("c2").alias("other"), "d").unionByName(apart.select(F.col("c2").alias("star"), F.col("c1").alias("other"), "d"))
    radius = members.where("fam").groupBy("star").agg(F.max("away").alias("radius"))
    least = 1 - percent / 100
    asked = settle(both.join(radius.select(F.col("star").alias("other"), "radius"), "other").withColumn("need", F.col("d") - least - F.col("radius") - SLACK), "asked")
    far = members.where("fam").select("c", "star", "away").join(asked, "star").where("away >= need")
    near = settle(shared_sizes(far.select(F.col("c").alias("c1"), F.col("other").alias("c2"), "star", "radius"), of), "reach")
    direct = near.where(alike(percent))
    done = direct.select(F.least("star", "c2").alias("lo"), F.greatest("star", "c2").alias("hi")).distinct()
    open_ = near.where(~alike(percent) & (distance() <= least + F.col("radius") + SLACK))
    left = open_.withColumns({"lo": F.least("star", "c2"), "hi": F.greatest("star", "c2")}).join(done, ["lo", "hi"], "left_anti")
    return joined.unionByName(direct.select("c1", "c2")), settle(left.select(F.col("c1").alias("c"), "star", F.col("c2").alias("other")), "family-reach")


def prefix_candidates(prefixes: DataFrame, bigs: DataFrame, reach: DataFrame, percent: int) -> DataFrame:
    """Pairs that share as many cold hashes of their prefixes as the one with the smaller length asks for."""
    at = F.explode(F.arrays_zip("toks", "places")).alias("x")
    postings = prefixes.select("c", "star", "fam", "__n", "length", "asked", at).select("c", "star", "fam", "__n", "length", "asked", F.col("x.toks").alias("tok"), F.col("x.places").alias("pos"))
    met = meetings(postings.join(bigs, "tok"), reach, percent, ["length", "asked", "pos"])
    no = 1 << 30
    l1, l2 = (F.when(F.col(f"length{k}") > 0, F.col(f"length{k}")).otherwise(no) for k in (1, 2))
    length = F.least(l1, l2)
    inside = [F.col(f"pos{k}") < F.col(f"__n{k}") - F.ceil(percent * F.col(f"__n{k}") / 100) + length for k in (1, 2)]
    asked = F.greatest(*[F.when(one == length, F.col(f"asked{k}")).otherwise(0) for k, one in ((1, l1), (2, l2))])
    counted = met.where((length < no) & inside[0] & inside[1]).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max(asked).alias("asked"))
    return counted.where("n >= asked").select("c1", "c2")


def size_bucket(n: Column) -> Column:
    """Sizes in steps of three percent; it rises with ``n``."""
    return F.floor(F.log(n.cast("double")) / math.log(1.03)).cast("int")


def hot_candidates(rows: DataFrame, percent: int, often: int = HOT) -> DataFrame:
    """Pairs of classes that are mostly hot, from their whole sets: rows (c, star, __n, tok).

    Hashes are ordered by the stars that hold them, those of one star first. The first hash that a linked pair shares lies
    in the prefix of the smaller set that fits partners of its size or more, and in the longer prefix of the larger one.
    If that hash is hot, no cold one is shared, so both sets must hold enough hot ones; this bounds the sizes at which
    they can meet. Smaller and larger meet by hash and size bucket, never two holders of the hash's largest star.
    """
    held = with_stars(rows)
    n, size = F.col("__n"), F.size("held")
    lists = held.groupBy("c", "star", "__n").agg(
        F.sort_array(F.collect_list(F.struct("df", "tok", "big"))).alias("held"), F.count_if(F.col("df") >= often).alias("hot"))
    lists = settle(lists, "hot")

    def postings(least: Column) -> DataFrame:
        """The hashes of the prefix for partners that share ``least`` or more; those of one star alone come first."""
        kept = F.slice("held", F.lit(1), F.greatest(F.lit(0), (n - least + 1 - (n - size)).cast("int")))
        return lists.select("c", "star", "__n", "hot", F.explode(kept).alias("x")).select("c", "star", "__n", "hot", "x.*").withColumn("in_big", F.col("star") == F.col("big"))

    small = postings(F.ceil(2 * percent * n / (100 + percent))).withColumn("bucket", size_bucket(n))
    least = F.ceil(percent * n / 100)
    most = F.when(F.col("df") < often, n).otherwise(F.least(n, F.floor(F.col("hot") * (100 + percent) / percent) - n))
    large = postings(least).where(most >= least).withColumn("bucket", F.explode(F.sequence(size_bucket(least), size_bucket(most))))
    large = large.withColumn("to", F.explode(F.when(F.col("in_big"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    left = small.select("tok", "bucket", F.col("in_big").alias("to"), "df", *[F.col(x).alias(f"{x}1") for x in ("c", "star", "__n", "hot")])
    right = large.select("tok", "bucket", "to", *[F.col(x).alias(f"{x}2") for x in ("c", "star", "__n", "hot")])
    n1, n2 = F.col("__n1"), F.col("__n2")
    shared = F.ceil(percent * (n1 + n2) / (100 + percent))
    fits = (F.col("df") < often) | (F.least("hot1", "hot2") >= shared)
    once = (n1 < n2) | ((n1 == n2) & (F.col("c1") < F.col("c2")))
    met = left.join(right, ["tok", "bucket", "to"]).where((F.col("star1") != F.col("star2")) & once & sized(n1, n2, percent) & fits)
    return met.select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()


def central_ties(tied: DataFrame, ties: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links (c1, c2, d) of classes that missed their hub with the most central classes of the same crowd.

    Central is who holds most of the hashes that half of the crowd has, and fewest others. ``CENTRAL`` of them are
    taken, each from another part of the crowd, so the pairs are linear in it.
    """
    size = settle(tied.groupBy("c2").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= CROWD), "crowds")
    crowd = tied.join(size, "c2")
    tokens = crowd.join(whole.withColumnRenamed("c", "c1"), "c1").select("c1", "c2", "size", F.explode("set").alias("tok"))
    common = tokens.groupBy("c2", "tok").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("2 * n >= size")
    common = settle(common.select("c2", "tok", F.lit(True).alias("common")), "common")
    score = tokens.join(common, ["c2", "tok"], "left").groupBy("c2", "c1").agg((2 * F.count("common") - F.count(F.lit(1))).alias("score"))
    part = F.pmod(F.xxhash64("c1"), F.lit(CENTRAL)).alias("part")
    central = score.groupBy("c2", part).agg(F.max_by("c1", F.struct("score", -F.col("c1"))).alias("mid")).select("c2", "mid")
    missed = tied.join(ties.select("c1"), "c1", "left_anti").join(settle(central, "central"), "c2").where("c1 <> mid")
    found = verified(missed.select("c1", F.col("mid").alias("c2")), whole, percent)
    return found.groupBy("c1").agg(F.min("c2").alias("c2"), F.min_by("d", "c2").alias("d"))


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id and n_same (documents with the same set) for each row of ``docs``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    tables = Tables(docs.sparkSession)
    rows = tables.settle(sets(source, "text", ["doc_id"], False, size, percent), "sets")
    real = rows.where("__n > 0 AND doc_id IS NOT NULL")
    one = real.groupBy("__n", "__k1", "__k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_same"), F.min_by("__set", "doc_id").alias("set"))
    classes = tables.settle(one.withColumn("c", F.monotonically_increasing_id()), "classes")
    narrow = tables.settle(rows.drop("__set"), "set-sizes")
    tables.drop(rows)
    who = tables.settle(classes.select("c", "rep", "__n", "__k1", "__k2", "n_same"), "class-names")

    def of(ids: DataFrame, label: str) -> DataFrame:
        named = tables.settle(ids.distinct().join(who.drop("n_same"), "c"), f"{label}-ids")
        found = sets_of(source, "doc_id", "text", named, label, size, percent, tables.settle)
        tables.drop(named)
        return found

    # hashes of kept prefixes that several classes hold
    tokens = classes.select("c", "__n", F.size("set").alias("kept"), F.posexplode("set").alias("pos", "tok"))
    several = tables.settle(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "several")
    held = tables.settle(tokens.join(several, "tok"), "held")
    tables.drop(classes, several)
    # hubs
    keyed = held.where(F.col("pos") < KEYS)
    typical = held.groupBy("c").agg((F.count(F.lit(1)) / F.max("kept")).alias("weight"))
    typical = settle(typical, "typical")
    key = keyed.join(typical, "c")
    hub = settle(key.groupBy("tok").agg(F.max_by(F.struct("c", "__n"), F.struct("weight", -F.col("c"))).alias("hub")), "hubs")
    near = keyed.join(hub, "tok").where((F.col("hub.c") != F.col("c")) & sized(F.col("hub.__n"), F.col("__n"), percent))
    best = near.groupBy("c", F.col("hub.c").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= KEYS // 2)
    tied = tables.settle(best.groupBy(F.col("c").alias("c1")).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("c2")), "tied")
    hub_sets = of(tied.select(F.explode(F.array("c1", "c2")).alias("c")), "hub-sets")
    ties = settle(verified(tied, hub_sets, percent), "ties")
    ties = settle(ties.unionByName(central_ties(tied, ties, hub_sets, percent)), "all-ties")
    # prefixes
    members = star_members(ties)
    told = held.drop("df", "kept").join(members.select("c", F.col("star").alias("hub"), "fam"), "c", "left")
    starred = with_stars(told.withColumns({"star": F.coalesce("hub", "c"), "fam": F.coalesce("fam", F.lit(False))}).drop("hub"))
    starred = tables.settle(starred, "starred")
    tables.drop(held)
    lists = starred.groupBy("c", "star", "fam", "__n").agg(F.sort_array(F.collect_list(F.struct("pos", "df", "tok"))).alias("held"))
    fields = [T.StructField("c", LONG), T.StructField("star", LONG), T.StructField("fam", T.BooleanType()), T.StructField("__n", LONG), T.StructField("length", LONG),
              T.StructField("asked", LONG), T.StructField("toks", LONGS), T.StructField("places", LONGS)]
    prefixes = tables.settle(map_arrow(lists, _lengthen, fields, percent=percent, hot=hot), "prefixes")
    bigs = settle(starred.where(F.col("df") < hot).groupBy("tok").agg(F.first("big").alias("big")), "bigs")
    between, reach = family_reach(starred, members, hub_sets, percent, hot)
    between = settle(between, "families-joined")
    tables.drop(starred, hub_sets)
    cold = settle(prefix_candidates(prefixes, bigs, reach, percent), "candidates")
    # classes that are mostly hot
    mostly = prefixes.where("length = 0").select("c", "star")
    wanted = cold.select(F.explode(F.array("c1", "c2")).alias("c")).unionByName(mostly.select("c"))
    whole = of(wanted, "whole-sets")
    hot_rows = whole.join(mostly, "c").select("c", "star", F.size("set").cast("long").alias("__n"), F.explode("set").alias("tok"))
    pairs = cold.unionByName(hot_candidates(hot_rows, percent, hot)).distinct()
    links = settle(verified(pairs, whole, percent).unionByName(ties).select("c1", "c2").unionByName(between), "links")
    tables.drop(whole, prefixes)
    # components
    roots = components(links)
    known = who.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = known.join(smallest, "root").select("__n", "__k1", "__k2", "component_id", "n_same")
    joined = narrow.join(named, ["__n", "__k1", "__k2"], "left")
    own = F.when(F.col("__n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", F.col("__n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_same", F.lit(0)).alias("n_same"), "__k1", "__k2")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; equal rows of that id stay once.

    Rows without id or without words stay, as they link with nothing.
    """
    found = linked(docs, id_col, text, size, percent).where("n_shingles > 0 AND doc_id = component_id")
    keep = found.select(F.col("doc_id").alias("__keep"), F.col("n_shingles").alias("__n"), "__k1", "__k2").distinct()
    rows = sets(docs, text, docs.columns, None, size, percent)
    free = F.col(id_col).isNull() | (F.col("__n") == 0)
    same = [rows["__n"] == keep["__n"], rows["__k1"] == keep["__k1"], rows["__k2"] == keep["__k2"], rows[id_col] == keep["__keep"]]
    kept = rows.where(~free).join(keep, same, "left_semi").dropDuplicates(["__n", "__k1", "__k2", id_col])
    return rows.where(free).select(*docs.columns).unionByName(kept.select(*docs.columns))


