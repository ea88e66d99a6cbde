"""The positional index against plain search: exact windows, proximity, edges, split vocabularies."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from hearth.catalog.oracle import duck
from hearth.llm import contamination as con
from hearth.llm import sql
from hearth.llm.queries import op12_positional_index
from tests.conftest import SF_SMALL

DOCS, ITEMS = "doc_id long, text string, n_words string, row string", "item_id long, text string, words string"


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain(docs, items, window=10):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item_id, other, *_ in items:
            x = words(other)
            k = min(window, len(x))
            for s in range(len(x) - k + 1 if x else 0):
                for at in range(len(w) - k + 1):
                    if w[at:at + k] == x[s:s + k]:
                        hit |= set(range(at, at + k))
                        found |= {item_id} - {None}
        out.append((doc_id, len(w), len(hit), sorted(map(str, found)), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in df.collect()), key=repr)


def corpus(seed, n_docs=60, n_items=12):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "é1", "x2", "and", "日本", "w", "rare" + str(seed)]
    some = lambda n: "".join(rng.choices(vocabulary, [9, 8, 2, 2, 6, 1, 1, 1])[0] + rng.choice([" ", ", ", "-", "\n"])
                             for _ in range(n))
    items = [(rng.choice([i, 3, None]), some(rng.choice([0, 1, 3, 9, 10, 11, 25])), "c") for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [some(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            t = words(rng.choice(items)[1])
            a = rng.randint(0, 3)
            parts += [" ".join(t[a:a + rng.randint(1, 20)]).upper() if rng.random() < 0.3 else " ".join(t[a:]), some(rng.randint(0, 3))]
        docs.append((rng.choice([i, None, 5]), rng.choice([None, ""]) if i % 20 == 0 else " ".join(parts), "c", "c"))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, seed):
    docs, items = corpus(seed)
    df = con.decontaminate(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS).repartition(3))
    assert got(df) == plain(docs, items)


def test_large_vocabulary_and_many_lookups(spark, monkeypatch):
    """Several dictionaries, salted joins: the same rows."""
    monkeypatch.setattr(con, "MOST_TERMS", 3)
    monkeypatch.setattr(con, "MOST_LOOKUPS", 0)
    docs, items = corpus(6, 30, 8)
    df = con.decontaminate(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert got(df) == plain(docs, items)


def test_other_windows(spark):
    docs, items = corpus(4, 25, 6)
    for window in (1, 4):
        df = con.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window)
        assert got(df) == plain(docs, items, window)


def test_edges(spark):
    docs = [(1, None, "c", "c"), (2, "", "c", "c"), (2, "", "c", "c"), (None, "one two", "c", "c"), (4, "one " * 50_000, "c", "c")]
    d = spark.createDataFrame(docs, DOCS)
    items = [(None, "two", "c"), (7, "One, one one", "c"), (70, "one", "c"), (8, "...", "c"), (9, None, "c"), (10, "never seen", "c")]
    i = spark.createDataFrame(items, ITEMS)
    assert got(con.decontaminate(d, i)) == sorted([
        (1, 0, 0, [], False), (2, 0, 0, [], False), (2, 0, 0, [], False), (None, 2, 2, ["70"], True),
        (4, 50_000, 50_000, ["7", "70"], True)], key=repr)
    assert got(con.decontaminate(d.limit(0), i)) == []
    assert got(con.decontaminate(d.where("doc_id = 4"), i.limit(0))) == [(4, 50_000, 0, [], False)]


def test_hot_passage(spark):
    """A third of all rows hold one passage; every row is found, by index places as well."""
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"{'x ' * (i % 7)}{passage} y" if i % 3 == 0 else "x y z " * 5, "c", "c") for i in range(300)]
    d = spark.createDataFrame(docs, DOCS).repartition(6)
    i = spark.createDataFrame([(1, passage, "c")], ITEMS)
    rows = got(con.decontaminate(d, i))
    assert [r[2] for r in rows] == [30 if r[0] % 3 == 0 else 0 for r in rows]
    items = con.item_words(i)
    terms = con.vocabulary(items)
    index = con.postings(con.numbered(d), terms)
    runs = con.exact_runs(index, items, terms).join(index.select("row", "doc_id"), "row").collect()
    assert sorted((r.doc_id, r.start, r.length, r.item_start) for r in runs) == [
        (k, k % 7, 30, 0) for k in range(0, 300, 3)]


def test_proximity(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("a b c d e f g".split(), k=rng.randint(0, 25))), "c", "c") for i in range(60)]
    phrases = [(1, "a b c", "c"), (2, "d d e", "c"), (3, "f", "c"), (4, "g zz", "c")]
    items = con.item_words(spark.createDataFrame(phrases, ITEMS))
    terms = con.vocabulary(items)
    index = con.postings(con.numbered(spark.createDataFrame(docs, DOCS)), terms)
    for span in (3, 5):
        found = con.near_runs(index, items, terms, span).join(index.select("row", "doc_id"), "row").join(
            items.select("seq", F.col("item").cast("long").alias("item")), "seq").collect()
        want = set()
        for (doc_id, text, *_), (item, phrase, _) in product(docs, phrases):
            w, x = text.split(), phrase.split()
            holds = lambda s, e: all(w[s:e + 1].count(t) >= x.count(t) for t in x)  # noqa: E731, B023
            want |= {(doc_id, item, s, e - s + 1) for s in range(len(w)) for e in range(s, min(s + span, len(w)))
                     if holds(s, e) and not holds(s + 1, e) and not holds(s, e - 1)}
        assert sorted((r.doc_id, r["item"], r.start, r.length) for r in found) == sorted(want)


def test_registered_query(spark):
    want = sorted(duck(SF_SMALL).sql(sql.contamination_sql()).fetchall(), key=repr)
    out = op12_positional_index(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want and any(r[-1] for r in want)
