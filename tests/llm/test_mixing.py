import math
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriata.llm import mixing
from seriata.llm.queries import op10_mixing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abcdefgh", min_size=1, max_size=3), st.floats(0.01, 100), min_size=1, max_size=20))
def test_frame_stays_within_a_block(weights):
    counts = mixing.quantised(weights, 256)
    assert sum(counts.values()) == 256 and min(counts.values()) >= 1
    done = Counter()
    for t, (s, j) in enumerate(mixing.frame_schedule(counts)):
        assert j == done[s] and j * 256 // counts[s] <= t < -(-(j + 1) * 256 // counts[s])
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * c / 256) < 1 for x, c in counts.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(1e-4, 1e4), st.integers(1, 200)), min_size=1, max_size=12))
def test_blocks_stay_within_one_of_exact_weights(sources):
    weights, blocks = mixing.whole_weights([w for w, _ in sources]), [n for _, n in sources]
    total, done, last = sum(weights), [0] * len(weights), -1
    for i, j, release, deadline, slot in mixing.block_schedule(weights, blocks):
        assert slot > last and j == done[i] and j * total // weights[i] == release <= slot < deadline == -(-(j + 1) * total // weights[i])
        done[i], last = done[i] + 1, slot
        assert all(n == blocks[k] or abs(n * total - (slot + 1) * w) < total for k, (n, w) in enumerate(zip(done, weights, strict=True)))
    assert done == blocks


def test_skewed_weights_and_chunks(spark, monkeypatch):
    df = spark.range(20000).selectExpr("id as doc_id", "if(id < 16000, 'large', 'small') as source")
    rows = mixing.schedule(df, {"large": 1000.0, "small": 1.0}, block=1).collect()
    check(rows, Counter(r.source for r in rows), 1)
    assert {r.source: r.target_weight for r in rows} == {"large": 1000 / 1001, "small": 1 / 1001}
    assert sum(r.source == "small" and r.slot < 16000 for r in rows) in (15, 16)
    monkeypatch.setattr(mixing, "CHUNK", 3000)
    assert sorted(mixing.schedule(df, {"large": 1000.0, "small": 1.0}, block=1).collect()) == sorted(rows)
    many = spark.range(60000).selectExpr("id as doc_id", "cast(id as string) as source")
    monkeypatch.undo()
    assert mixing.schedule(many).agg({"slot": "max"}).first()[0] == 59999


def check(rows, sizes, block):
    assert len(rows) == sum(sizes.values()) and Counter(r.source for r in rows) == sizes
    for s, n in sizes.items():
        assert sorted(r.nth for r in rows if r.source == s) == list(range(n))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    slots = {}
    for r in rows:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block) and r.block == r.nth // block
    out = min(max(r.slot for r in rows if r.source == s) for s in sizes)
    weight = {r.source: r.target_weight for r in rows}
    done = Counter()
    for t in range(out + 1):
        done[slots[t][0]] += 1
        assert all(abs(done[s] - (t + 1) * w) < 1 for s, w in weight.items())
    assert len({r.position for r in rows}) == len(rows)


def test_op10_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = op10_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    check(rows, Counter(d.source for d in docs), mixing.BLOCK)


def test_op10_against_plain_edf(spark):
    """Slot by slot over the whole table: of all released blocks the one with the earliest deadline, exact fractions throughout."""
    sf = "/root/testdata/sf0.01"
    sizes = Counter(d.source for d in spark.read.parquet(f"{sf}/documents.parquet").select("source").collect())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = {s: Fraction(sizes[s] ** mixing.ALPHA) for s in names}
    share = {s: w / sum(share.values()) for s, w in share.items()}
    left, done, want, slot = {s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, Counter(), {}, 0
    while any(done[s] < left[s] for s in names):
        ready = [(math.ceil((done[s] + 1) / share[s]), names.index(s)) for s in names if done[s] < left[s] and math.floor(done[s] / share[s]) <= slot]
        if ready:
            s = names[min(ready)[1]]
            want[s, done[s]] = slot
            done[s] += 1
        slot += 1
    got = {(r.source, r.block): r.slot for r in op10_mixing(spark, sf).collect()}
    assert got == want


def test_weights_parts_and_edges(spark, edge_docs, empty_docs):
    assert mixing.schedule(empty_docs).count() == 0
    rows = mixing.schedule(edge_docs, block=2).collect()
    check(rows, Counter(r.source for r in edge_docs.collect()), 2)
    df = spark.range(500).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "1 as block", "2 as slot")
    weights = {"hot": 5.0} | {f"s{i}": 1.0 for i in range(7)}
    rows = mixing.schedule(df, weights, block=3).collect()
    check(rows, Counter(r.source for r in df.collect()), 3)
    assert abs(next(r.target_weight for r in rows if r.source == "hot") - 5 / 12) < 0.01
    small = mixing.schedule(df, weights, block=3, part=10).collect()
    check(small, Counter(r.source for r in df.collect()), 3)
    order = {r.doc_id: r.position for r in mixing.schedule(df).collect()}
    whole = [(r.doc_id, r.slot) for r in mixing.mixed(df).collect()]
    assert [d for d, _ in whole] == sorted(order, key=order.get) and {s for _, s in whole} == {2}
    with pytest.raises(ValueError):
        mixing.schedule(df, {"hot": 1.0})
