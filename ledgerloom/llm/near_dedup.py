"""Near-duplicate documents: SuperMinHash, banding, verification, union-find.

SuperMinHash gives each element of a set a random permutation of the
signature's places and draws its j-th value from [j, j + 1), so the values of
one element are spread over the signature and its estimate varies less than
with independent hashes. Places filled in round j cannot be improved by later
rounds: a document stops as soon as its whole signature lies below j + 1,
which long documents reach after a round or two.

Documents with equal sets are one class. Classes that share a band (a hash of
``rows`` signature values) are candidates. Within a band's bucket all members
are first compared with its most central one, and what is confirmed is joined
into components. Members of different components of one bucket are then
compared where what sets them apart from the leader still allows a link
(``_left_over``, an exact bound). A large group of copies so costs about its
size, not its square, and no candidate is left out. Every comparison reads the
whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.llm import common
from ledgerloom.llm.common import mix, staged
from ledgerloom.llm.components import components

BLOCK = 1 << 19
SIGNED = "doc_id long, key long, n_shingles long, class string, bands array<long>"


def shingle_sets(data: np.ndarray, offs: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, concatenated and sorted within the
    row, and the rows' offsets. A row of fewer than q words, but not none, has
    its whole sequence as the only shingle."""
    data = common.lowered(data)
    starts, ends, first = common.word_spans(data, offs)
    w = common.word_hashes(data, starts, ends)
    rows, n = len(offs) - 1, np.diff(first)
    sums = common.prefix_sums(w)
    out, sizes = [], np.zeros(rows + 1, np.int64)
    for r in range(rows):
        if n[r]:
            a = np.arange(first[r], first[r] + max(n[r] - q + 1, 1))
            h = np.unique(common.span_hash(sums, a, np.minimum(a + q, first[r + 1])))
            out.append(h)
            sizes[r + 1] = len(h)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(sizes)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def superminhash(elements: np.ndarray, offs: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows x m) of sets of 64-bit elements; a row without elements has infinite values."""
    rows = len(offs) - 1
    h = np.full((rows, m), np.inf)
    flat = h.reshape(-1)
    size = np.diff(offs)
    row = np.repeat(np.arange(rows), size)
    live = elements
    places = None  # the permutation of each element that is still drawn, as far as it is fixed
    for j in range(m):
        r = mix(live + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (_unit(mix(r)) * (m - j)).astype(np.int64)
        if places is None:
            at = k
        else:
            at = places[np.arange(len(live)), k].astype(np.int64)
            places[np.arange(len(live)), k] = places[:, j]
        np.minimum.at(flat, row * m + at, j + _unit(r))
        done = h.max(axis=1) < j + 1
        stay = ~done[row]
        if not stay.any():
            break
        if places is None:
            places = np.tile(np.arange(m, dtype=np.int16), (int(stay.sum()), 1))
            places[np.arange(len(places)), k[stay]] = 0  # place 0 is taken up by k
            live, row = live[stay], row[stay]
        elif not stay.all():
            live, row, places = live[stay], row[stay], places[stay]
    return h


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64)
    out = np.zeros((len(bits), bits.shape[1] // rows), np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, i::rows])
    return out.view(np.int64)


def _signer(q: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in common.blocks(batch.column(2), BLOCK):
                sets, at = shingle_sets(data, offs, q)
                n = np.diff(at)
                b = band_hashes(superminhash(sets, at, bands * rows), rows)
                names = [hashlib.blake2b(sets[at[i]:at[i + 1]].tobytes(), digest_size=16).hexdigest() if n[i] else None for i in range(hi - lo)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]), pa.int32()),
                                                 pa.array(b[n > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n),
                                                  pa.array(names, pa.string()), lists], names=["doc_id", "key", "n_shingles", "class", "bands"])
    return sign


def _verifier(q: int, percent: int, apart: bool):
    """Rows sorted by (leader, salt, kind): a leader's text, then its
    candidates'. One leader's set and one batch are held at a time."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            lead, kind, other = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            a, b, rest, ok = [], [], [], []
            for lo, hi, data, offs in common.blocks(batch.column(3), BLOCK):
                sets, at = shingle_sets(data, offs, q)
                for i in range(lo, hi):
                    s = sets[at[i - lo]:at[i - lo + 1]]
                    if kind[i] == 0:
                        leader, own = lead[i], s
                        continue
                    assert leader == lead[i], "a leader's text must come first"
                    hit = own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s if len(own) and len(s) else np.zeros(len(s), bool)
                    n = int(hit.sum())
                    a.append(lead[i])
                    b.append(other[i])
                    rest.append(np.setxor1d(own, s, assume_unique=True).view(np.int64) if apart else None)
                    ok.append(100 * n >= percent * (len(own) + len(s) - n))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), 
                                              pa.array(rest, pa.list_(pa.int64())), pa.array(ok, pa.bool_())], names=["a", "b", "apart", "linked"])
    return verify


def verified(pairs: DataFrame, texts: DataFrame, q: int, percent: int, apart: bool = False, per_leader: int = 2000) -> DataFrame:
    """(a, b, apart, linked) for candidate pairs of classes, on their whole
    texts: the shingles that only one of them has (if asked for), and whether
    they are similar. A leader ``a`` with many candidates is spread over
    several groups."""
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_leader).cast("int").alias("groups"))
    p = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    leaders = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))) \
        .join(texts.withColumnRenamed("class", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    members = p.join(texts.withColumnRenamed("class", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = leaders.unionByName(members).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "kind", "b")
    return rows.select("a", "kind", "b", "text").mapInArrow(_verifier(q, percent, apart), "a string, b string, apart array<long>, linked boolean")


def _left_over(open_: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): all pairs that can still be links: they share a bucket
    but no component. ``open_`` are the buckets' members with their leader c,
    ``met`` (c, class, apart) the shingles D that a member and c do not share.

    Two members differ in |Da| + |Db| - 2 |Da and Db| shingles and may differ
    in u (na + nb), u = (100 - percent) / (100 + percent); so they must share
    half of (|Da| - u na) + (|Db| - u nb) in their D. If that is nothing, the
    pair is taken from the bucket. Else it is found by a join on shingles of
    D: of those, in any fixed order, only the first all-but-the-needed (and
    one) are looked at, rare ones first, and what comes after must suffice. What is needed at least follows from
    the least excess |D| - u n on the other side, which is the leader's main
    component for some and the rest for all."""
    bucket, whole, slack = ["band", "hash"], 100 + percent, 100 - percent
    mine = open_.select(*bucket, "class", "root", "n_shingles", F.col("l.lead").alias("c"))
    who = mine.select("class", "root", "n_shingles", "c").distinct().join(met, ["c", "class"], "left") \
        .withColumn("apart", F.coalesce("apart", F.expr("cast(array() as array<bigint>)"))) \
        .withColumn("excess", whole * F.size("apart") - slack * F.col("n_shingles"))
    main = who.groupBy("c", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("c").agg(F.max(F.struct("k", "root")).alias("m")).select("c", F.col("m.root").alias("main"))
    who = staged(who.join(main, "c").withColumn("own", F.when(F.col("root") == F.col("main"), 0).otherwise(1)).drop("main"), "excess")
    least = who.groupBy("c").agg(F.min(F.when(F.col("own") == 0, F.col("excess"))).alias("e0"), F.min(F.when(F.col("own") == 1, F.col("excess"))).alias("e1"))
    # the main component's members need only meet the rest
    sides = F.when(F.col("own") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    who = who.join(least.where("e1 is not null"), "c").withColumn("other", F.explode(sides)) \
        .withColumn("against", F.when(F.col("other") == 0, F.col("e0")).otherwise(F.col("e1"))).drop("e0", "e1")

    def paired(rows: DataFrame, *on: str) -> DataFrame:
        """Rows met with rows of another component that look for their side."""
        named = lambda k: [F.col(c).alias(f"{s}{k}") for c, s in (("class", ""), ("root", "r"), ("n_shingles", "n"), ("excess", "e"), ("after", "f"))]
        x = rows.select(*on, "own", "other", *named("a"))
        y = rows.select(*on, F.col("other").alias("own"), F.col("own").alias("other"), *named("b"))
        once = (F.col("own") < F.col("other")) | ((F.col("own") == F.col("other")) & (F.col("a") < F.col("b")))
        # at the first shingle that both have, they share it and what both have after it, at most
        enough = 2 * whole * (1 + F.least("fa", "fb")) >= F.col("ea") + F.col("eb")
        return x.join(y, [*on, "own", "other"]).where(
            once & enough & (F.col("ra") != F.col("rb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    lone = who.where("excess + against <= 0").drop("apart", "root", "n_shingles")
    free = paired(mine.join(lone, ["c", "class"]).withColumn("after", F.lit(0)), *bucket, "c").where("ea + eb <= 0")
    each = who.select("c", "class", "apart").distinct().select("c", "class", F.explode("apart").alias("name"))
    often = each.groupBy("c", "name").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ordered = each.join(often, ["c", "name"]).groupBy("c", "class").agg(F.array_sort(F.collect_list(F.struct("f", "name"))).alias("shared"))
    needed = F.greatest(F.ceil((F.col("excess") + F.col("against")) / (2 * whole)), F.lit(1)).cast("int")
    # shingles that no other member has are left out: they are never met
    names = who.drop("apart").join(ordered, ["c", "class"]) \
        .select("*", F.posexplode(F.slice("shared", 1, F.greatest(F.size("shared") - needed + 1, F.lit(0)))).alias("place", "s")) \
        .withColumn("name", F.col("s.name")).withColumn("after", F.size("shared") - F.col("place") - 1).drop("s", "shared", "place")
    both = free.unionByName(paired(names, "c", "name"), allowMissingColumns=True)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4,
                    keep_key: bool = False) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that
    links reach, itself included), kept (doc_id = component_id).

    Documents are linked when 100 * shared shingles >= percent * all shingles.
    With 32 bands of 4 values a pair at 0.8 is a candidate with probability
    1 - 5e-8; what is a candidate is decided on the full sets.

    One row per input row. Null, empty and word-free texts have no shingles,
    are linked with nothing and are their own component. Repeated rows share
    an id and a component, and are all kept or none (``representatives``
    keeps one). Null ids count for no minimum; a null id is kept only if its
    component has no other, and its component_id is then null. Other columns
    are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("key", F.xxhash64("text"))
    signed = staged(src.select("doc_id", "key", "text").mapInArrow(_signer(shingle, bands, rows), SIGNED), "signed")
    classes = signed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(common.LAST)).alias("oid"), "key")).alias("of"))

    one = signed.where("class is not null").dropDuplicates(["class"])
    each = one.select("class", "n_shingles", F.posexplode("bands").alias("band", "hash"))
    shared = each.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the join has a shuffle of its own and a large bucket's rows can be split
    members = staged(each.join(staged(shared, "buckets"), ["band", "hash"]), "members")
    wanted = members.select("class").distinct().join(classes, "class").select("class", "of.*")
    text_of = src.select(F.coalesce("doc_id", F.lit(common.LAST)).alias("oid"), "key", "text")
    texts = staged(text_of.join(wanted, ["oid", "key"]).dropDuplicates(["class"]).select("class", "text"), "texts")

    bucket = ["band", "hash"]
    # members of many and large buckets are near the middle of their group: most others are similar to them
    central = staged(members.groupBy("class").agg(F.sum("n").alias("weight")), "weights")
    members = members.drop("n").join(central, "class")
    leader = F.struct((-F.col("weight")).alias("o"), F.xxhash64("class").alias("h"), F.col("class").alias("lead"), F.col("root").alias("of"), F.col("n_shingles").alias("na"))

    def with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.join(components(links).withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))

    def compared(found: DataFrame, tested: DataFrame | None, apart: bool = False) -> DataFrame:
        pairs = found.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        return staged(verified(staged(pairs, "pairs"), texts, shingle, percent, apart), "verified")

    # first each class is compared with the most central of all its buckets
    everyone = members.withColumn("root", F.col("class"))
    each = everyone.join(everyone.groupBy(*bucket).agg(F.min(leader).alias("l")), bucket).groupBy("class").agg(F.min("l").alias("l"), F.first("n_shingles").alias("nb"))
    result = compared(each.where("class != l.lead").select(F.col("l.lead").alias("a"), F.col("class").alias("b"), "l.na", "nb"), None)
    # then, in buckets of more than one component, all with the bucket's most central
    m = staged(with_roots(members, result.where("linked")), "rooted")
    mixed = m.groupBy(*bucket).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(leader).alias("l")).where("r0 != r1")
    open_ = staged(m.join(mixed.select(*bucket, "l"), bucket), "open")
    if not open_.isEmpty():
        near = open_.where("class != l.lead").select(F.col("l.lead").alias("a"), F.col("class").alias("b")).distinct()
        met = staged(verified(staged(near, "pairs"), texts, shingle, percent, apart=True), "verified")
        result = result.unionByName(met.withColumn("apart", F.lit(None).cast("array<bigint>")))
        open_ = with_roots(open_.drop("root"), result.where("linked"))
        left = _left_over(staged(open_, "open"), met.select(F.col("a").alias("c"), F.col("b").alias("class"), "apart"), percent)
        result = result.unionByName(compared(left, result.select("a", "b")))
    links = result.where("linked").select("a", "b")

    root = components(links)
    of_class = classes.join(root.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.join(least, "root").select("class", "component_id", "root")
    out = signed.select("doc_id", "key", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", *(["key", "root"] if keep_key else []), "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns. Of
    repeated rows (same id and text) one stays, as of a group's different texts
    under one id (or under none). Texts without shingles all stay."""
    kept = near_duplicates(docs, keep_key=True, **options).where("kept").groupBy("root", "doc_id", "key") \
        .agg(F.count(F.lit(1)).alias("_ll_n"), F.max("n_shingles").alias("_ll_size")).withColumnsRenamed({"doc_id": "_ll_kept", "key": "_ll_text"})
    alone = F.when(F.col("root").isNull(), F.struct("_ll_kept", "_ll_text"))
    kept = kept.groupBy("root", alone.alias("alone")).agg(F.min(F.struct("_ll_kept", "_ll_text", "_ll_n", "_ll_size")).alias("of")).select("of.*")
    mine = docs.withColumn("_ll_id", F.col("doc_id").cast("long")).withColumn("_ll_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    j = mine.join(kept, F.col("_ll_id").eqNullSafe(F.col("_ll_kept")) & (F.col("_ll_key") == F.col("_ll_text")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = j.where("_ll_n = 1 or _ll_size = 0").select(*own)
    again = j.where("_ll_n > 1 and _ll_size > 0").dropDuplicates(["_ll_id", "_ll_key"]).select(*own)
    return once.unionByName(again)
