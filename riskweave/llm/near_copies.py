"""Near copies of texts: SimHash and exact similarity of five-word shingles (the pipeline's form of operator 4).

Texts whose sets of word shingles have a Jaccard similarity of ``SIMILARITY`` (.8) or more are linked; groups are the
connected components. Such texts mostly lie 3 to 16 bits apart in a 64-bit SimHash. A pivot distance table has no selective
key at such distances (with 20 of 64 bits free, every block of bits may differ), so the candidates come from operator 4's
pivot distance tables (all within its radius of 2 bits) and, for larger distances, from MinHash bands. The SimHash distance
discards before the exact comparison:

1. Texts with equal shingle sets are one node.
2. ``BANDS`` bands of ``ROWS`` MinHash values: texts at similarity .8 share a band with probability
   1 - (1 - .8**4)**16 = .9998.
3. Round one compares what the pivot distance tables link (nodes of one fingerprint with their smallest) and every member
   of a band's bucket with one leader of the bucket (another leader in every band).
   Links at more than ``BITS`` differing SimHash bits are discarded (3.6 standard deviations above the mean at .8), the
   others verified by the exact similarity of the two shingle sets.
4. Round two compares members of a bucket that are still in different components, leaving out pairs inside one
   component and pairs whose distances to the bucket's leader, a pivot, differ by more than .2.
5. A bucket with over ``CROWD`` pairs of a member and one outside its main component is crowded (from some ten members
   on, so nearly all members of larger buckets are, at any size of the table). There, shingles are counted over all
   members of such buckets: one row for each shingle of a node, so no more rows than shingles. A pair that shares a rare shingle (in at most ``RARE`` sets) is found by
   that shingle. Any other pair shares frequent shingles only, and sets of sizes m and n with similarity s share at
   least s / (1 + s) (m + n): members with too few frequent shingles drop out. So a text with a share of words of its own
   is compared with nobody, and no link between groups is lost. The rest is first compared with the plainest member of
   the bucket (the largest share of frequent shingles), which ties nearly all of it into one component, and only then
   across the components that are left.

Words are lower-cased (A-Z) runs of non-blanks. Defined results: a text of under five words has one shingle, the whole
sequence; null and empty texts have none and are one group. Of each group the row with the smallest id stays (of equal
ids that with the smaller text hash; null ids come last; of rows with equal id and text one stays).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.components import components
from riskweave.llm.simhash_dedup import close_fingerprints
from riskweave.llm.tables import pieces
from riskweave.llm.words import mix, shingle_hashes, shingle_starts, split_words
from riskweave.session import reliable_checkpoint

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 4
BITS = 20
CROWD = 64
RARE = 32
TOGETHER = 512  # pairs whose sets are held as Python values at once
UNPACKED = 1 << 16  # shingles, of 64 bytes, unpacked at once, and those of one more text
TEXT_BYTES = 1 << 18  # text whose shingles are held at once, and that of one more text
FEW_SHINGLES = 500_000  # that are broadcast
MOST_NAMED = 300_000  # nodes, of 24 bytes, that are broadcast

_PROFILE = "doc_id long, th long, node long, fp long, bands array<long>"


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, row by row and sorted, with the rows' bounds."""
    words = split_words(column, lower=True)
    n = len(words.bounds) - 1
    starts, rows = shingle_starts(words.bounds, SHINGLE)
    hashes = shingle_hashes(words.hash, SHINGLE)[starts] if len(starts) else np.zeros(0, np.uint64)
    size = np.diff(words.bounds)
    for k in range(1, SHINGLE):  # shorter texts: the whole sequence
        short = np.flatnonzero(size == k)
        if len(short):
            whole = shingle_hashes(words.hash, k)[words.bounds[short]]
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[new], hashes[new]
    return hashes, np.searchsorted(rows, np.arange(n + 1))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(3).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketches(batches):
    for piece in pieces(batches, size=TEXT_BYTES):
        hashes, bounds = shingle_sets(piece.column("text"))
        n = piece.num_rows
        node = np.zeros(n, np.uint64)
        prints = np.zeros(n, np.uint64)
        bands = np.zeros((n, BANDS), np.uint64)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            first = bounds[full]
            node[full] = mix(np.add.reduceat(mix(hashes ^ np.uint64(0x5DEECE66D)), first) ^ np.diff(bounds)[full].astype(np.uint64))
            before = bounds[full] // UNPACKED
            for rows in np.split(full, np.flatnonzero(before[1:] != before[:-1]) + 1):
                a, b = bounds[rows[0]], bounds[rows[-1] + 1]
                bits = np.unpackbits(hashes[a:b].byteswap().view(np.uint8)).reshape(-1, 64)
                ones = np.add.reduceat(bits, bounds[rows] - a, axis=0, dtype=np.int32)
                packed = np.packbits(2 * ones > np.diff(bounds)[rows][:, None], axis=1)
                prints[rows] = packed.view(">u8").ravel()
            for i, m in enumerate(_multipliers()):
                least = np.minimum.reduceat(hashes * m, first)
                bands[full, i // ROWS] = mix(bands[full, i // ROWS] * np.uint64(31) + least)
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"), piece.column("th"), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)),
                pa.ListArray.from_arrays(
                    pa.array((np.arange(n + 1) * BANDS).astype(np.int32)), pa.array(bands.view(np.int64).ravel())
                ),
            ],
            names=["doc_id", "th", "node", "fp", "bands"],
        )


def _packed_sets(batches):
    """node and its shingle set as sorted 32-bit numbers."""
    for piece in pieces(batches, size=TEXT_BYTES):
        hashes, bounds = shingle_sets(piece.column("text"))
        small = (hashes >> np.uint64(32)).astype("<u4")  # sorted as the hashes are
        sets = [small[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"node": piece.column("node"), "shingles": pa.array(sets, pa.binary())})


def _similar(batches):
    for batch in (b.slice(s, TOGETHER) for b in batches for s in range(0, b.num_rows, TOGETHER)):
        found = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(x, y))
            found.append(both / (len(x) + len(y) - both))
        yield pa.RecordBatch.from_pydict(
            {"a": batch.column("a"), "b": batch.column("b"), "similarity": pa.array(found, pa.float64())}
        )


def _sets_of(needed: DataFrame, source: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and packed shingle set of the needed nodes. Up to ``MOST_NAMED`` nodes are broadcast, so that only their texts
    leave the scan; more are joined."""
    rows = nodes.join(needed, "node").select("node", F.col("rep.doc_id").alias("_d"), F.col("rep.th").alias("_t"))
    rows = reliable_checkpoint(rows)
    named = F.broadcast(rows) if rows.count() <= MOST_NAMED else rows
    texts = source.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    return texts.select("node", "text").mapInArrow(_packed_sets, "node long, shingles binary").dropDuplicates(["node"])


def _unpacked(batches):
    """One row per node and shingle, in batches of ``UNPACKED`` rows and those of one more node."""
    for piece in pieces(batches, "shingles", 4 * UNPACKED):
        packed = [np.frombuffer(x, "<u4") for x in piece.column("shingles").to_pylist()]
        node = np.repeat(np.asarray(piece.column("node")), [len(x) for x in packed])
        shingle = np.concatenate(packed).view(np.int32)
        yield pa.RecordBatch.from_pydict({"node": pa.array(node), "shingle": pa.array(shingle)})


def _crowded_pairs(members: DataFrame, source: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, pairs) of the members of crowded buckets: node, size and number of frequent shingles; and the pairs of
    nodes (a, b) in different components that share a rare shingle. members: node, fp, root."""
    members = reliable_checkpoint(members.distinct())
    sets = reliable_checkpoint(_sets_of(members.select("node"), source, nodes))
    each = sets.mapInArrow(_unpacked, "node long, shingle int")
    often = reliable_checkpoint(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    few = often.count() <= FEW_SHINGLES  # then only shared shingles leave the scan
    placed = each.join(F.broadcast(often) if few else often, "shingle")
    frequent = placed.filter(F.col("n") > RARE).groupBy("node").agg(F.count(F.lit(1)).alias("frequent"))
    sizes = sets.select("node", (F.octet_length("shingles") / 4).cast("long").alias("size"))
    counts = sizes.join(frequent, "node", "left").withColumn("frequent", F.coalesce("frequent", F.lit(0)))
    rare = placed.filter(F.col("n") <= RARE).join(members, "node").select("shingle", "node", "fp", "root")  # RARE a shingle
    other = rare.select("shingle", F.col("node").alias("a"), F.col("fp").alias("a_fp"), F.col("root").alias("a_root"))
    pairs = other.join(rare, "shingle").filter((F.col("a") < F.col("node")) & (F.col("root") != F.col("a_root")) & ~_far("fp", "a_fp"))
    return reliable_checkpoint(counts), pairs.select("a", F.col("node").alias("b")).distinct()


def _compared(pairs: DataFrame, source: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and the exact similarity of their shingle sets, for every pair of nodes."""
    pairs = reliable_checkpoint(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = reliable_checkpoint(_sets_of(needed, source, nodes))
    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return reliable_checkpoint(both.mapInArrow(_similar, "a long, b long, similarity double"))


def _far(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) > BITS


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _pivot_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (a, b) that connect what operator 4 links: nodes of equal fingerprints, and by its pivot distance
    tables those within its radius."""
    owners = reliable_checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("owner")))
    same = nodes.join(owners, "fp").filter("node <> owner").select(*_ordered("node", "owner"))
    names = owners.select(F.col("fp").alias("a"), F.col("owner").alias("x")), owners.select(F.col("fp").alias("b"), F.col("owner").alias("y"))
    near = close_fingerprints(owners.select("fp")).join(names[0], "a").join(names[1], "b")
    return same.unionByName(near.select(*_ordered("x", "y")))


def _with_main(named: DataFrame) -> DataFrame:
    """Members of buckets with several components; main is the largest; see the module text for ``crowded``."""
    sizes = named.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "value").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("k"), ((F.sum("n") - F.max("n")) * F.sum("n") > CROWD).alias("crowded")
    )
    return named.join(main.filter("k > 1").drop("k"), ["band", "value"])


def _shares(size, other):
    """The least number of common shingles of similar sets."""
    return (size + other) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6


def _across(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different components that may be similar."""
    others = members.filter("root <> main").select(
        "band", "value", F.col("node").alias("a"), F.col("fp").alias("a_fp"), F.col("root").alias("a_root"),
        F.col("to_lead").alias("a_to_lead"), F.col("size").alias("a_size"), F.col("frequent").alias("a_frequent"),
    )
    enough = F.col("size").isNull() | (F.least("frequent", "a_frequent") >= _shares(F.col("size"), F.col("a_size")))
    apart = F.coalesce(F.abs(F.col("to_lead") - F.col("a_to_lead")) > 1 - SIMILARITY + 1e-9, F.lit(False))
    pairs = others.join(members, ["band", "value"]).filter(
        (F.col("root") != F.col("a_root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("node")))
        & ~_far("fp", "a_fp") & ~apart & enough
    )
    return pairs.select(*_ordered("a", "node"))


def near_copy_nodes(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile, groups): doc_id, th and node of every row; node, root of the nodes that have a link."""
    profile = reliable_checkpoint(source.mapInArrow(_sketches, _PROFILE))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    nodes = profile.groupBy("node").agg(F.min(order).alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = reliable_checkpoint(nodes)
    members = nodes.select("node", "fp", F.posexplode("bands").alias("band", "value"))
    turn = F.xxhash64("node", "band")
    buckets = members.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("node", "fp"), turn).alias("leader")
    )
    buckets = buckets.filter("n > 1")
    shared = members.join(buckets, ["band", "value"]).select(
        "band", "value", "node", "fp", F.col("leader.node").alias("lead"), F.col("leader.fp").alias("lead_fp")
    )
    shared = reliable_checkpoint(shared)
    first = shared.filter((F.col("node") != F.col("lead")) & ~_far("fp", "lead_fp")).select(*_ordered("node", "lead"))
    first = reliable_checkpoint(first.unionByName(_pivot_pairs(nodes.select("node", "fp"))).distinct())
    compared = _compared(first, source, nodes)
    links = compared.filter(F.col("similarity") >= SIMILARITY).select("a", "b")
    groups = components(links)

    # Round two: members of a bucket in other components than most of it, with all members in yet another component.
    # The leader is a pivot: by the triangle inequality of the Jaccard distance, two members whose distances to it
    # differ by more than 1 - SIMILARITY can't be similar.
    named = shared.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = reliable_checkpoint(named.select("band", "value", "node", "fp", "lead", "root"))
    members = _with_main(named).withColumns({"a": F.least("node", "lead"), "b": F.greatest("node", "lead")})
    to_lead = F.when(F.col("node") == F.col("lead"), F.lit(1.0)).otherwise(F.col("similarity"))
    members = members.join(compared, ["a", "b"], "left").withColumn("to_lead", to_lead)
    members = reliable_checkpoint(members.select("band", "value", "node", "fp", "root", "main", "to_lead", "crowded"))
    nothing = F.lit(None).cast("long")
    second = _across(members.filter("not crowded").withColumns({"size": nothing, "frequent": nothing}))
    crowd, seen = members.filter("crowded"), first
    if not crowd.isEmpty():
        counts, rare = _crowded_pairs(crowd.select("node", "fp", "root"), source, nodes)
        crowd = crowd.join(counts, "node")
        # a partner has SIMILARITY of a set's size at least, and at least the smallest size of the bucket
        least = crowd.groupBy("band", "value").agg(F.min("size").alias("least"))
        partner = F.greatest("least", F.col("size") * SIMILARITY)
        crowd = crowd.join(least, ["band", "value"]).filter(F.col("frequent") >= _shares(F.col("size"), partner))
        crowd = reliable_checkpoint(crowd.drop("least", "main", "crowded"))
        plain = F.struct(F.col("frequent") / F.col("size"), "node")
        hubs = crowd.groupBy("band", "value").agg(F.max_by("node", plain).alias("hub"))
        to_hub = crowd.join(hubs, ["band", "value"]).filter("node <> hub").select(*_ordered("node", "hub")).distinct()
        to_hub = reliable_checkpoint(to_hub.join(first, ["a", "b"], "left_anti"))
        hub_links = _compared(to_hub, source, nodes).filter(F.col("similarity") >= SIMILARITY).select("a", "b")
        links, seen = links.unionByName(hub_links), first.unionByName(to_hub)
        groups = components(links)
        crowd = crowd.drop("root").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        second = second.unionByName(_across(_with_main(crowd))).unionByName(rare)
    more = _compared(second.distinct().join(seen, ["a", "b"], "left_anti"), source, nodes)
    more = more.filter(F.col("similarity") >= SIMILARITY).select("a", "b")
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    return profile, groups


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that stay: one of each group."""
    keyed = docs.withColumns({"_id": F.col(doc_id).cast("long"), "_th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    source = keyed.select(F.col("_id").alias("doc_id"), F.col("_th").alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    profile, groups = near_copy_nodes(source)
    rooted = profile.join(groups, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first")
    stay = rooted.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_d"), F.col("first.th").alias("_t"))
    kept = keyed.join(stay, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_semi")
    return kept.dropDuplicates(["_id", "_th"]).select(docs.columns)
