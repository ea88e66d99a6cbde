"""ProbMinHash, components and near-duplicate classes against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearth.llm import neardup
from hearth.llm.components import components
from tests.conftest import SF_SMALL


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    x, y = a[:300], a[60:]
    wx, wy = rng.random(300) + 0.5, rng.random(340) + 0.5
    wy[:240] = wx[60:]
    sx, sy = neardup.probminhash(x, wx, 2000), neardup.probminhash(y, wy, 2000)
    # probability Jaccard: sum over shared d of 1 / sum_e max(x_e / x_d, y_e / y_d)
    px, py = dict(zip(x.tolist(), wx, strict=True)), dict(zip(y.tolist(), wy, strict=True))
    true = sum(1 / sum(max(px.get(e, 0) / px[d], py.get(e, 0) / py[d]) for e in {*px, *py}) for d in px if d in py)
    assert abs((sx == sy).mean() - true) < 0.04


def test_signature_equals_full_simulation():
    """Early termination changes nothing: the same arrivals without it."""
    e = np.array([3, 99, 12345], np.uint64)
    w = np.array([1.0, 2.5, 0.3])
    j = np.arange(1, 4001, dtype=np.uint64)
    bits = neardup._mix(e[:, None] + j * neardup._GOLDEN)
    at = np.cumsum(-np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / w[:, None], 1)
    reg = (neardup._mix(bits) % np.uint64(50)).astype(int)
    best = [min((at[i, k], int(e[i])) for i in range(3) for k in range(4000) if reg[i, k] == r)[1] for r in range(50)]
    assert neardup.probminhash(e, w, 50).tolist() == best


def test_shingles():
    h = neardup.WordHashes()
    assert len(h.shingles(None)) == len(h.shingles(" \n")) == 0
    assert len(h.shingles("a")) == len(h.shingles("a b c d e")) == 1
    assert len(h.shingles("a b c d e f")) == 2
    assert (h.shingles("a b c d e") == h.shingles("a\tb\nc d  e ")).all()
    assert h.shingles("a b")[0] != h.shingles("a b c")[0]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 60)]
    df = spark.createDataFrame(path + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 60))
    assert components(df.limit(0)).count() == 0


def brute_classes(rows):
    """Classes by all pairs."""
    words = neardup.WordHashes()
    sets = [np.unique(words.shingles(t)) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            same = (rows[i][1] or "") == (rows[k][1] or "")
            if find(i) != find(k) and (same or neardup.jaccard(sets[i], sets[k]) >= neardup.SIMILARITY):
                group[find(i)] = find(k)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), []).append(r[0])
    return sorted(sorted(v, key=repr) for v in out.values())


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {}
    for r in neardup.near_duplicates(docs).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(v, key=repr) for v in got.values()) == brute_classes(rows)


def _rows():
    base = " ".join(f"w{i}" for i in range(120))
    near = [base.replace(f"w{i} ", f"x{i} ") for i in range(1, 12)]
    return ([(i, base) for i in (50, 51, 52)] + [(10 + i, t) for i, t in enumerate(near)] + [(90, base.replace(" ", "\n"))]
            + [(1, None), (2, ""), (3, " "), (4, "short one"), (5, "short one"), (None, "short one"), (None, None),
               (60, " ".join(f"v{i}" for i in range(80))), (60, " ".join(f"v{i}" for i in range(80))), (61, base + " tail " * 2000)])


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, "clash", 7) for r in _rows()], "doc_id long, text string, key string, class_id int")
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()]
    assert len(got) == len(_rows())
    by = dict(got)
    assert all(by[i] == 10 for i in [50, 51, 52, 90, *range(10, 21)])
    assert by[1] == by[2] == 1 and by[3] == 3 and by[4] == by[5] == 4 and by[60] == 60 and by[61] == 10
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 10, 60]


def test_all_ids_null_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r.class_id for r in neardup.near_duplicates(df).collect()] == [None, None]
    assert neardup.keep_one(df).count() == 1
    assert neardup.near_duplicates(df.limit(0)).count() == neardup.keep_one(df.limit(0)).count() == 0


def test_a_large_family_stays_linear_in_pairs(spark):
    """300 near copies in one bucket: pairs drawn per member stay bounded."""
    base = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(base[:k] + [f"y{k}"] + base[k + 1:])) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = neardup.signatures(df).select("key", F.explode("bands").alias("band"))
    buckets = nodes.groupBy("band").agg(F.max("key").alias("middle"))
    pairs = neardup._pairs(nodes.join(buckets, "band"), "middle").count()
    assert pairs <= 300 * neardup.BANDS
    assert neardup.near_duplicates(df).select("class_id").distinct().count() == 1


def test_every_pair_of_a_bucket_is_compared(spark):
    """60 pairs of twins, unrelated otherwise, in one bucket."""
    rows = []
    for k in range(60):
        text = " ".join(f"x{k}_{i}" for i in range(40))
        rows += [(2 * k, text), (2 * k + 1, f"{text} tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    banded = docs.select("doc_id", neardup.text_key(F.col("text")).alias("key"), F.array(F.lit(1)).cast("array<long>").alias("bands"))
    got = {}
    for r in neardup.classes(banded, docs).collect():
        got.setdefault(r.class_key, []).append(r.doc_id)
    assert sorted(sorted(v, key=repr) for v in got.values()) == brute_classes(rows)


def test_repeated_passages_keep_candidates():
    """Texts with the same shingles share a band however often one repeats a passage."""
    words = neardup.WordHashes()
    for k in range(40):
        rest, passage = (" ".join(f"{c}{k}_{i}" for i in range(n)) for c, n in (("a", 300), ("b", 100)))
        once, often = f"{passage} {passage} {rest}", " ".join([passage] * 300 + [rest])
        assert len(set(neardup.band_hashes(once, words)) & set(neardup.band_hashes(often, words))) >= neardup.BANDS


def _family(n, edits, seed, shared=0, vocabulary=0):
    """Copies of one text, each with ``edits`` words replaced by words of its own (or of a small vocabulary),
    the first ``shared`` replacements the same in all of a third of them."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    for k in range(n):
        words = list(base)
        for j, at in enumerate(rng.choice(300, edits, replace=False)):
            words[at] = f"v{rng.integers(vocabulary)}" if vocabulary else f"u{k}_{j}"
        if k % 3 == 0:
            words[:shared] = [f"s{i}" for i in range(shared)]
        yield k, " ".join(words)


def own_differences(texts, anchor):
    """The differences from the anchor as one Arrow table, each text a class of its own."""
    words = neardup.WordHashes()
    rows = [(bytes(r.key), np.unique(words.shingles(r.text))) for r in texts.collect()]
    own = dict(rows)[bytes(anchor)]
    return pa.table({"key": [k for k, _ in rows], "component": [k for k, _ in rows], "n": pa.array([len(x) for _, x in rows], pa.int32()),
                     "delta": pa.array([np.setxor1d(x, own).view(np.int64) for _, x in rows], pa.list_(pa.int64()))})


@pytest.mark.parametrize("most", [neardup.MOST_ELEMENTS, 3000, 0])
def test_open_pairs_hold_every_link(spark, monkeypatch, most):
    """Overlapping differences miss no link between texts of different classes, in tasks and by joins."""
    monkeypatch.setattr(neardup, "MOST_ELEMENTS", most)
    rows = [*_family(60, 3, 1), *((100 + k, t) for k, t in _family(60, 3, 2, 30)), *((200 + k, t) for k, t in _family(50, 4, 3, 0, 3)),
            *((300 + k, " ".join(f"z{k % 9}_{i}" for i in range(100 + k))) for k in range(40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(neardup.text_key(F.col("text")).alias("key"), "text").distinct()
    anchor = texts.orderBy("key").first().key
    open_rows = texts.select(F.lit(anchor).alias("anchor"), "key", F.col("key").alias("component"))
    open_pairs = neardup._overlapping_pairs(open_rows, texts)
    got = {frozenset((bytes(r.member), bytes(r.centre))) for r in open_pairs.collect()}
    apart = own_differences(texts, anchor)
    assert {tuple(sorted(p)) for p in got} == {tuple(sorted((bytes(a), bytes(b)))) for a, b in zip(
        *(neardup._pairs_within(apart)[c].to_pylist() for c in ("member", "centre")), strict=True)}
    words = neardup.WordHashes()
    sets = {bytes(r.key): np.unique(words.shingles(r.text)) for r in texts.collect()}
    own = sets[bytes(anchor)]
    keys = sorted(sets)
    links = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if neardup.jaccard(sets[a], sets[b]) >= 0.8}
    by_anchor = {k for k in keys if k != bytes(anchor) and neardup.jaccard(sets[k], own) >= 0.8}
    # a pair may be left out only if both link to the anchor
    assert len(links) > 500 and all(p in got or p <= by_anchor | {bytes(anchor)} for p in links)


def test_families_under_the_threshold_make_few_pairs(spark):
    """Copies of similarity about 0.75 with edits of their own: far fewer pairs than all."""
    rows = list(_family(400, 9, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(neardup.text_key(F.col("text")).alias("key"), "text")
    anchor = texts.orderBy("key").first().key
    open_rows = texts.select(F.lit(anchor).alias("anchor"), "key", F.col("key").alias("component"))
    assert neardup._overlapping_pairs(open_rows, texts).distinct().count() < 0.05 * 400 * 399 / 2
    got = {}
    for r in neardup.near_duplicates(docs).collect():
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(v) for v in got.values()) == brute_classes(rows)
