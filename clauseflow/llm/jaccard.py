"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent: first those that a filter over all documents shows
to occur in one document only, then the rest by counts over all documents (both of fixed size).
A document with enough shingles of its own thus has nothing in its prefix to meet others with.
Two sets that reach the similarity share at least l shingles among their first
n - ceil(t * n) + l ones, for any l; each document takes the l of least estimated cost: longer
prefixes cost more look-ups but ask for more shared prefix shingles, and so leave fewer
candidates to verify. A pair is verified when it shares min(l, l') prefix shingles and its sizes
allow the similarity; verification is exact, on the sets of the whole texts. Before that the two
parity maps are compared: each shingle of a set turns over one of ``MAP_BITS`` bits, so two maps
differ in no more bits than the sets in shingles. What differs in more cannot link and does not
leave the join (beyond some 1 300 shingles the maps tell little, and the texts decide).

Documents of equal sets are one class from the start. Inside the classes that share a prefix
shingle not all pairs are compared: while that would be more than the number of
prefix shingles, every shingle's classes are compared with a few hubs only (one, then ``MORE_HUBS``
times as many in each round), the links found are united to components, and only pairs of different
components stay open. A near copy group thus
costs its size, not its square, and no link between components is lost: every open pair is
compared in the end. (A pair inside one component needs no comparison: it cannot change it.)

Nulls and odd input: a null or wordless text has the empty set and links with nothing; a text of
fewer words than a shingle is one shingle; rows with one id count as one document, which
belongs to the classes of all its texts; a null id links with nothing and gets a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clauseflow.llm import sketch, twofilters
from clauseflow.llm.words import LOWER, SPACED, U, Words, chunks, column, join_two, mix, windows
from clauseflow.operators.clustering import connected_components
from clauseflow.session import cut_lineage

#: Longest multi-match prefix tried, and the cost of a verification in look-ups for each shingle.
MAX_MATCH = 4
VERIFY = 1 / 64
#: All open pairs are compared when they are at most so many times the prefix shingles.
OPEN_PAIRS = 1
#: Each round of hubs takes so many times the hubs of the round before.
MORE_HUBS = 32
#: Most pairs of one document that are verified in one place.
PARTNERS = 2_000
#: Steps of a counter's logarithm: counts up to 2^51 fit one byte.
LEVELS = 5
#: Bits of a filter for a shingle, and places a prefix shingle sets.
BITS_EACH, K = 12, 2
#: Bits of a set's parity map, before it is folded to the set's size.
MAP_BITS = 512


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``n`` words; linked when ``den * intersection >= num * union``."""

    n: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, size: int) -> int:
        """Least intersection of a set of this size with any set it links to."""
        return -(-self.num * size // self.den)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both > 0 and self.den * both >= self.num * (len(a) + len(b) - both)


def shingle_sets(texts: list | pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    for _, group in chunks(texts):
        words = Words(group, SPACED)
        hashes = words.hashes(LOWER)
        rolling = windows(hashes, n)
        for a, b in zip(words.first.tolist(), words.first[1:].tolist()):
            if b - a >= n:
                yield np.unique(rolling[a : b - n + 1])
            elif b > a:
                yield join_two(windows(hashes[a:b], b - a), np.full(1, b - a, U))
            else:
                yield hashes[:0]


def parity_map(s: np.ndarray) -> np.ndarray:
    """``MAP_BITS`` bits as 64-bit numbers; each shingle turns over one."""
    at = (mix(s + U(11)) & U(MAP_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=MAP_BITS) & 1).astype(np.uint8)).view(np.int64)


def folded_map(s: np.ndarray, sim: Similarity) -> np.ndarray:
    """The map in as few words (a power of two) as tell sets of this size apart.

    Half the bits of unrelated maps differ: that is to be three halves of what links may. Word i is
    the parity of the words of the whole map whose numbers leave i.
    """
    need = 6 * len(s) * (sim.den - sim.num) / (sim.den + sim.num)
    words = 1
    while words * 64 < need and words < MAP_BITS // 64:
        words *= 2
    return np.bitwise_xor.reduce(parity_map(s).reshape(-1, words), axis=0)


def _maps_allow(a: str, b: str, sizes: Column, sim: Similarity) -> Column:
    """Whether two maps differ in no more bits than linked sets of this size together may in shingles."""
    words = F.least(F.size(a), F.size(b))  # the larger map is folded to the smaller one

    def bit_differences(n: int) -> Column:
        folded = []
        for i in range(n):
            word = F.lit(0).cast("bigint")
            for side in (a, b):
                for j in range(i, MAP_BITS // 64, n):
                    word = word.bitwiseXOR(F.coalesce(F.get(side, F.lit(j)), F.lit(0)))
            folded.append(F.bit_count(word))
        return sum(folded[1:], folded[0])

    sizes_of_maps = [1 << i for i in range((MAP_BITS // 64).bit_length())]
    differ = F.coalesce(*[F.when(words == n, bit_differences(n)) for n in sizes_of_maps], F.lit(0))
    return differ * (sim.den + sim.num) <= sizes * (sim.den - sim.num)


def choose_match(excess: np.ndarray, size: int, base: int, most: int) -> int:
    """The number of shared prefix shingles to ask for: least look-ups and verifications.

    ``excess`` estimates, for the first shingles in order, how many other documents hold each;
    a candidate uses up as many of these meetings as the match asks for.
    """
    run = np.cumsum(excess)
    options = range(1, most + 1)
    cost = [run[base + m - 1] * (1 + VERIFY * size / m) for m in options]
    return 1 + int(np.argmin(cost))


def _profiles(docs: DataFrame, sim: Similarity, counts: np.ndarray, twice) -> DataFrame:
    """(node, n, m, digest, need, map, prefix) of every row; digest is null for an empty set.

    m counts the shingles that another document may have too. The prefix leaves out shingles that no other document has; they count in its length.
    """
    levels = np.round(LEVELS * np.log2(counts + 1.0)).clip(0, 255).astype(np.uint8)
    value = (2.0 ** (np.arange(256) / LEVELS) - 1).astype(np.float32)  # count of a level
    typical = float(np.median(counts))
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        blank = np.zeros(1, np.int64)
        for batch in batches:
            sizes, commons, digests, needs, maps, prefixes = [], [], [], [], [], []
            for s in shingle_sets(batch.column("body"), sim.n):
                n = len(s)
                sizes.append(n)
                if not n:
                    digests.append(None)
                    needs.append(0)
                    commons.append(0)
                    maps.append(blank)
                    prefixes.append(s.view(np.int64))
                    continue
                two = mix(s + U(7))
                digests.append(
                    int(np.bitwise_xor.reduce(mix(s ^ U(0xA5A5A5A5A5A5A5A5)))).to_bytes(8, "little")
                    + int(two.sum(dtype=U)).to_bytes(8, "little")
                    + n.to_bytes(8, "little")
                )
                at = sketch.counter(s)
                met = twice.hits(s)
                commons.append(int(met.sum()))
                base = n - sim.overlap(n)
                most = min(MAX_MATCH, sim.overlap(n))
                order = np.lexsort((two, np.where(met, level[at].astype(np.int16), np.int16(-1))))[: base + most]
                excess = np.where(met, np.maximum(value[level[at]] - typical, 0.5), 0.0)[order]
                need = choose_match(excess, n, base, most)
                needs.append(need)
                chosen = order[: base + need]
                prefixes.append(s[chosen[met[chosen]]].view(np.int64))
                maps.append(folded_map(s, sim) if len(prefixes[-1]) else blank)  # without a prefix it meets none
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array(sizes, pa.int64()),
                    pa.array(commons, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(needs, pa.int32()),
                    pa.array(maps, pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)),
                ],
                names=["node", "n", "m", "digest", "need", "map", "prefix"],
            )

    kind = docs.schema["node"].dataType.simpleString()
    return docs.select("node", "body").mapInArrow(
        profile, f"node {kind}, n bigint, m bigint, digest binary, need int, map array<bigint>, prefix array<bigint>"
    )


def _shared_prefixes(heads: DataFrame) -> DataFrame:
    """(node, n, m, need, map, toks): prefix shingles that other heads may hold too.

    A pair shares the smaller need of its two, which may be 1: a head stays with any such shingle.
    """
    total = heads.agg(F.sum(F.size("prefix"))).first()[0] or 0

    def all_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield batch.column("prefix").flatten().to_numpy(zero_copy_only=False).view(U)

    bits = twofilters.bits_for(total, BITS_EACH)
    (twice,) = twofilters.build(heads.select("prefix"), all_of, bits, K, ("twice",))

    @F.arrow_udf("array<bigint>")
    def shared(prefix: pa.Array) -> pa.Array:
        flat = prefix.flatten().to_numpy(zero_copy_only=False)
        hit = twice.hits(flat.view(U))
        ends = np.concatenate(([0], np.cumsum(prefix.value_lengths().to_numpy())))
        kept = np.concatenate(([0], np.cumsum(hit)))[ends]
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(flat[hit]))

    kept = cut_lineage(
        heads.select("node", "n", "m", "need", "map", shared("prefix").alias("toks")).where(
            F.size("toks") >= 1
        )
    )
    twice.release()
    return kept


def _candidates(pairs: DataFrame, heads: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) whose shared prefix shingles allow a link."""
    side = heads.select("node", "need", "toks")
    return (
        pairs.join(side.toDF("a", "la", "ta"), "a")
        .join(side.toDF("b", "lb", "tb"), "b")
        .where(F.size(F.array_intersect("ta", "tb")) >= F.least("la", "lb"))
        .select("a", "b")
    )


def _verified(pairs: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs that link, by the sets of their whole texts.

    Every b comes before the texts it is compared with, so it crosses the shuffle and becomes a
    set once for each ``PARTNERS`` of them, however many it has.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, U)
        for batch in batches:
            good = []
            first = batch.column("a").is_null().to_pylist()
            bodies = batch.column("body")
            for leads, found in zip(first, shingle_sets(bodies, sim.n)):
                if leads:
                    own = found
                good.append(not leads and sim.linked(found, own))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    members = dealt.join(texts.toDF("a", "body"), "a").select("b", "part", "a", "body")
    leaders = (
        dealt.select("b", "part").distinct().join(texts.toDF("b", "body"), "b")
        .select("b", "part", F.lit(None).cast(kind).alias("a"), "body")
    )
    return (
        members.unionByName(leaders)
        .repartition("b", "part")
        .sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
        .mapInArrow(check, f"a {kind}, b {kind}")
    )


def _links(shared: DataFrame, texts: DataFrame, sim: Similarity) -> DataFrame:
    """Links (a, b) that connect all classes which the similarity connects."""
    nodes = shared.select(F.col("node").alias("id"))
    columns = ["node", "t", "label"]
    about = shared.select("node", "n", "m", "map")
    # sizes and maps do not cross the shuffles that only count and choose: they are joined to the
    # shingles where pairs meet
    posts = shared.select("node", F.explode("toks").alias("t"))
    labels = None  # at first every class is a component of its own
    links, hubs_each = None, 1
    while True:
        if labels is None:
            tagged = posts.withColumn("label", F.col("node"))
        else:
            tagged = posts.join(labels, "node").select(*columns)
        counts = (
            tagged.groupBy("t", "label")
            .agg(F.count(F.lit(1)).alias("c"))
            .groupBy("t")
            .agg(
                F.sum("c").alias("c"),
                F.sum(F.col("c") * F.col("c").cast("double")).alias("same"),
                F.count(F.lit(1)).alias("kinds"),
            )
            .where("kinds > 1")
        )
        open_now = cut_lineage(tagged.join(counts.select("t"), "t").select(*columns))
        pairs, size = counts.agg(
            F.sum((F.col("c") * F.col("c").cast("double") - F.col("same")) / 2), F.sum("c")
        ).first()
        if not size:
            break
        few = pairs <= OPEN_PAIRS * size
        if few:
            others = open_now
        else:
            first = F.row_number().over(Window.partitionBy("t").orderBy("node"))
            hubs = cut_lineage(
                open_now.withColumn("r", first).where(F.col("r") <= hubs_each).drop("r")
            )
            hubs_each *= MORE_HUBS
            others = hubs
        x = open_now.join(about, "node").select("node", "n", "m", "map", *columns[1:])
        y = x if few else others.join(about, "node").select("node", "n", "m", "map", *columns[1:])
        x, y = x.toDF("a", "na", "ma", "pa", "t", "la"), y.toDF("b", "nb", "mb", "pb", "t", "lb")
        most = F.least("ma", "mb")  # no more can be common to the two
        met = (
            x.join(y, "t")
            .where("a < b" if few else "a <> b")
            .where("la <> lb")
            .where(most * sim.den >= (F.col("na") + F.col("nb") - most) * sim.num)
            .where(_maps_allow("pa", "pb", F.col("na") + F.col("nb"), sim))
            .select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
            .distinct()
        )
        met = cut_lineage(_candidates(met.select("a", "b"), shared, sim))
        found = cut_lineage(_verified(met, texts, sim))
        linked = not found.isEmpty()
        if linked:
            links = found if links is None else links.unionByName(found)
        if few:
            break
        if linked:
            labels = cut_lineage(
                connected_components(nodes, links).select(
                    F.col("id").alias("node"), F.col("component").alias("label")
                )
            )
        # a hub has met every other component of its shingle
        posts = cut_lineage(
            open_now.join(hubs.select("t", "node"), ["t", "node"], "left_anti").select("node", "t")
        )
    if links is None:
        return shared.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return links


def _node(docs: DataFrame, id_col: str, text_col: str):
    """Rows are told apart by id and text; the smallest node has the smallest id."""
    return F.struct(
        column(docs, id_col).alias("doc"), F.xxhash64(column(docs, text_col)).alias("sig")
    )


def link_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()
) -> DataFrame:
    """All rows with n_shingles long, class_id and component_id, and stays boolean.

    ``class_id`` is the smallest id with an equal set; ``component_id`` the smallest id that
    links reach, the document's own included; ``stays`` is true for the one text that stands
    for its component, and for every row without id or words.
    """
    rows = docs.select(
        _node(docs, id_col, text_col).alias("node"), column(docs, text_col).cast("binary").alias("body")
    )

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield from shingle_sets(batch.column("body"), sim.n)

    text = F.col("body").cast("string")
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    about = rows.agg(F.sum(spaces + 1)).first()[0] or 0
    (twice,) = twofilters.build(
        rows.select("body"), keys_of, twofilters.bits_for(about, BITS_EACH), 1, ("twice",)
    )
    counts = sketch.count_keys(rows.select("body"), keys_of)
    profiles = cut_lineage(_profiles(rows, sim, counts, twice))
    twice.release()
    heads = cut_lineage(
        profiles.where("digest is not null and node.doc is not null")
        .groupBy("digest")
        .agg(
            F.min("node").alias("node"),
            F.min_by(F.struct("n", "m", "need", "map", "prefix"), "node").alias("h"),
        )
        .select("digest", "node", "h.n", "h.m", "h.need", "h.map", "h.prefix")
    )
    shared = _shared_prefixes(heads.drop("digest"))
    key = F.xxhash64("node.doc", "node.sig")

    def ids_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mix(batch.column("id").to_numpy(zero_copy_only=False).view(U))

    (once,) = twofilters.build(
        shared.select(key.alias("id")), ids_of, twofilters.bits_for(shared.count(), 16), 2, ("once",)
    )

    @F.arrow_udf("boolean")
    def wanted(keys: pa.Array) -> pa.Array:
        return pa.array(once.hits(mix(keys.to_numpy(zero_copy_only=False).view(U))))

    texts = cut_lineage(rows.where(wanted(key)).dropDuplicates(["node"]))
    once.release()
    links = _links(shared, texts, sim)

    classes = (
        profiles.where("digest is not null and node.doc is not null")
        .select("node", "digest")
        .join(heads.select("digest", F.col("node").alias("class")), "digest")
        .select("node", "class")
    )
    # an id with several texts joins their classes
    own = classes.groupBy("node.doc").agg(F.min("class").alias("least"), F.max("class").alias("most"))
    several = own.where("least <> most").select(F.col("doc").alias("of"), "least")
    joined = classes.join(several, F.col("node.doc") == F.col("of")).select(
        F.col("class").alias("a"), F.col("least").alias("b")
    )
    nodes = heads.select(F.col("node").alias("id"))
    parts = connected_components(nodes, links.unionByName(joined)).toDF("class", "component")
    placed = (
        classes.distinct()
        .join(parts, "class")
        .select("node", F.col("class.doc").alias("class_id"), "component")
        .join(profiles.select("node", "n").dropDuplicates(["node"]), "node", "right")
        .withColumnRenamed("node", "of")
    )
    added = {"n_shingles", "class_id", "component_id", "stays"}
    kept = [c for c in docs.columns if c not in added]
    whole = docs.select(
        F.struct(*[column(docs, c) for c in kept]).alias("row"),
        _node(docs, id_col, text_col).alias("node"),
    )
    return whole.join(placed, F.col("node").eqNullSafe(F.col("of")), "left").select(
        *[F.col("row")[c].alias(c) for c in kept],
        F.col("n").alias("n_shingles"),
        F.when(F.col("node.doc").isNotNull(), F.coalesce("class_id", "node.doc")).alias("class_id"),
        F.when(F.col("node.doc").isNotNull(), F.coalesce("component.doc", "node.doc")).alias("component_id"),
        F.coalesce(F.col("component") == F.col("node"), F.lit(True)).alias("stays"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sim: Similarity = Similarity()
) -> DataFrame:
    """The rows that stay: one of each component, all rows without id or words."""
    return link_components(docs, id_col, text_col, sim).where("stays").select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    )
