import re

import numpy as np
import pyarrow as pa
import xxhash

from riskweave.llm import near_copies as N
from riskweave.llm import simhash_dedup as S
from riskweave.llm import substring_dedup as B
from riskweave.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2400, (300, 2))]
    got = components(spark.createDataFrame(links, "a long, b long"))
    expected = grouped({n for ab in links for n in ab}, links)
    own = {a for a, b in links if a == b} - {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.root for r in got.collect()} == {n: r for n, r in expected.items() if n not in own}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_close_fingerprints_with_crowds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    values = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 4), replace=False)
            values.add(int(np.int64(b) ^ np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64))).view(np.int64)))
    values = sorted(values)
    links = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    expected = grouped(values, links)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    for crowd in (48, 3):  # by pairs, and by shared values
        monkeypatch.setattr(S, "CROWD", crowd)
        assert grouped(values, [(r.a, r.b) for r in S.close_fingerprints(nodes).collect()]) == expected


def test_odd_rows(odd, none):
    rows = S.near_duplicate_groups(odd).collect()
    texts = {(r.doc_id, r.text) for r in odd.collect()}
    assert len(rows) == odd.count()
    assert {(r.doc_id, r.fp & (1 << 64) - 1) for r in rows} == {(i, fingerprint(t)) for i, t in texts}
    group = {r.doc_id: r.component_id for r in rows if r.doc_id not in (None, 9)}
    assert group[1] == group[2] == 1 and group[3] == group[4] == group[5] == group[10] == 3
    assert S.near_duplicate_groups(none).count() == 0


def test_near_copies(spark, odd, none):
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # copies 2, upper-cased 9 and the copy with one more word go; nulls, empty and blank texts are one group
    assert ids == sorted([1, 3, 6, 7, 8, 9], key=str)
    assert N.one_of_each(none).count() == 0


def test_near_copies_of_a_large_group(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = base.copy()
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"v{j}" for j in rng.integers(0, 5000, 80))) for i in range(40)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = grouped(sets, links)
    kept = N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(expected.values())


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(260):  # from no to thirty changed words: a few percent, or far too many
        words = base.copy()
        for at in rng.choice(100, int(rng.choice([0, 1, 2, 3, 12, 30])), replace=False):
            words[at] = f"own{i}x{at}" if i % 5 else f"shared{i % 15}x{at // 20}"  # some changes are common to a few
        rows.append((i, " ".join(words[: 100 - i % 7])))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = set(grouped(sets, links).values())
    for crowd, rare in ((32, 32), (0, 32), (0, 2), (10_000, 32)):
        monkeypatch.setattr(N, "CROWD", crowd)
        monkeypatch.setattr(N, "RARE", rare)
        kept = N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.doc_id for r in kept.collect()} == expected


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(800):  # one in eight texts is plain; others are hardly similar to one another
        words = [f"w{j}" for j in range(200)]
        for at in rng.choice(200, int(rng.integers(0, 3) if i % 8 == 0 else rng.integers(3, 9)), replace=False):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))
    pairs, compared = [], N._compared

    def counted(p, *more):
        pairs.append(p.count())
        return compared(p, *more)

    monkeypatch.setattr(N, "_compared", counted)
    assert N.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() < len(rows)
    assert sum(pairs) < 30 * len(rows)


def test_sets_are_unpacked_in_small_batches():
    sets = [np.arange(i, i + 5000, dtype="<u4").tobytes() for i in range(60)] + [b"", np.arange(3, dtype="<u4").tobytes()]
    batch = pa.RecordBatch.from_pydict({"node": pa.array(range(len(sets)), pa.int64()), "shingles": pa.array(sets, pa.binary())})
    made = list(N._unpacked(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in made) <= N.UNPACKED + 5000
    got = [(r["node"], r["shingle"]) for b in made for r in b.to_pylist()]
    assert got == [(i, int(x)) for i, packed in enumerate(sets) for x in np.frombuffer(packed, "<i4")]


def test_small_and_large_buckets_are_crowded_alike(spark):
    sizes = {0: 20, 1: 100, 2: 4}
    named = [(0, b, 1000 * b + i, 1000 * b + i) for b, n in sizes.items() for i in range(n)]
    rows = N._with_main(spark.createDataFrame(named, "band int, value long, node long, root long")).collect()
    assert {(r.value, r.crowded) for r in rows} == {(0, True), (1, True), (2, False)}


def test_pivot_tables_give_candidates(spark, monkeypatch):
    rng = np.random.default_rng(6)
    prints = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    prints += [prints[0] ^ 1, prints[1] ^ 6, prints[2], prints[3] ^ 7]  # 1, 2, 0 and 3 bits apart
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp long")
    assert sorted(tuple(r) for r in N._pivot_pairs(nodes).collect()) == [(0, 60), (1, 61), (2, 62)]
    asked, pivot_pairs = [], N._pivot_pairs
    monkeypatch.setattr(N, "_pivot_pairs", lambda n: asked.append(n.columns) or pivot_pairs(n))
    N.one_of_each(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).count()
    assert asked == [["node", "fp"]]


def brute_removed(rows):
    import hashlib

    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone |= set(range(p, p + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, odd, none):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(130)]
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for i in range(40):
        own = [f"o{x}" for x in rng.integers(0, 3000, 60)]
        cut = sorted(rng.integers(0, 130, 2))
        rows.append((100 + i, " ".join(own[:30] + passage[cut[0] : cut[1]] + own[30:] + (passage[:55] if i % 3 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for memory_rows in (500_000, 20, 1):
        got = [tuple(r) for r in B.remove_repeats(docs, memory_rows=memory_rows).collect()]
        assert sorted(got, key=str) == brute_removed(rows)
    assert B.remove_repeats(none).count() == 0
    assert B.remove_repeats(odd).count() == odd.count()
