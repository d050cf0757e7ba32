import pyarrow as pa
import pytest

from riskweave.llm import decontamination as D
from tests.llm.conftest import PROSE

WORDS = PROSE.split()


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, " ".join(WORDS[10:40])), (2, None), (3, "too short"), (None, " ".join(WORDS[30:60])), (4, "")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows(odd, benchmark):
    rows = D.find_contamination(odd, benchmark).collect()
    found = sorted((str(r.doc_id), str(r.item_id)) for r in rows)
    holders = ["1", "2", "2", "9", "None"]  # upper case is found, repeated rows are judged one by one
    assert found == sorted([(d, i) for d in holders for i in ("1", "None")])
    assert all(r.similarity == pytest.approx(1) and r.differing_bits == 0 for r in rows)
    kept = D.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


def test_empty_tables(odd, none, benchmark):
    assert D.find_contamination(none, benchmark).count() == 0
    assert D.find_contamination(odd, benchmark.limit(0)).count() == 0
    assert D.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()


def test_blocks_of_items(odd, benchmark):
    one, many = D.find_contamination(odd, benchmark), D.find_contamination(odd, benchmark, block_bytes=60)
    assert sorted(map(tuple, one.fillna(-1).collect())) != []
    assert {(r.doc_id, r.item_id) for r in one.collect()} == {(r.doc_id, r.item_id) for r in many.collect()}


def test_near_passage_and_radius():
    index = D.build_index([7], [" ".join(WORDS[:40])])
    changed = WORDS[:40]
    changed[1] = "changed"  # touches 2 of 36 shingles: similarity 34/38 or so
    rows = D.find_leaks(index, pa.array([" ".join(["x", "y", *changed, "z"]), " ".join(WORDS[:19])]))
    assert [r[:4] for r in rows] == [(0, 0, 2, 40)] and 0.8 <= rows[0][5] < 1
    # every print within the radius is found, none beyond it
    prints = index.prints.copy()
    for flips, found in ((31, True), (32, False)):
        p = prints.copy()
        for b in range(flips):
            p[0, b * 4 // 8] ^= 1 << (b * 4 % 8)
        assert (len(D.within_radius(index, 40, p)[0]) == 1) is found
