import collections
import itertools

import numpy as np
import pytest

from fareline.llm import near_copies as N
from tests.llm.rows import documents, prose


def edited(text, n, seed):
    rng = np.random.default_rng(seed)
    w = text.split()
    for i in rng.integers(0, len(w), n):
        w[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(w)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def plain(a, b):
    a, b = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in (a.split(), b.split()))
    n = lcs(a, b)
    return n / (len(a) + len(b) - n)


def classes(texts, ids):
    name = dict(zip(ids, ids, strict=True))
    for (i, a), (j, b) in itertools.combinations(zip(ids, texts, strict=True), 2):
        if plain(a or "", b or "") >= N.SIMILARITY:
            low, high = sorted((name[i], name[j]))
            name = {k: low if v == high else v for k, v in name.items()}
    return name


def corpus():
    base = [prose(150, s) for s in range(5)]
    texts = [*base, None, "", " \n", "tiny text", "tiny  text", "tiny text too"]
    texts += [edited(base[0], n, 7 + n) for n in (1, 1, 2, 3, 4, 6, 12)]
    texts += [edited(base[1], 3, 50 + n) for n in range(25)]  # mostly similar to their origin alone
    passage = prose(60, 99)
    texts += [f"{prose(15, 200 + n)} {passage} {prose(15, 300 + n)}" for n in range(40)]
    texts += [base[2]] * 10 + [prose(20_000, 8), edited(prose(20_000, 8), 150, 3), "x " * 300, "x " * 310]
    return texts


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus()
    ids = np.random.default_rng(1).permutation(len(texts)).tolist()
    docs = documents(spark, texts, ids)
    want = classes([" ".join((t or "").split()) if len(t or "") < 50_000 else t[:9000] for t in texts], ids)
    got = {r["doc_id"]: r["class_id"] for r in N.find_near_copies(docs).collect()}
    assert got == want
    stay = N.drop_near_copies(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(want.values()))


def test_repeated_and_missing_ids(spark):
    a, b = prose(40, 1), prose(40, 2)
    docs = documents(spark, [a, a, b, a, edited(prose(80, 3), 1, 1), prose(80, 3)], [1, 1, 1, None, 4, 5])
    stay = sorted((r["doc_id"] or -1, r["text"]) for r in N.drop_near_copies(docs).collect())
    assert stay == sorted([(1, a), (1, b), (-1, a), (4, edited(prose(80, 3), 1, 1))])


def test_empty_table(spark):
    docs = documents(spark, ["a"]).limit(0)
    assert N.find_near_copies(docs).count() == 0 and N.drop_near_copies(docs).count() == 0


@pytest.mark.parametrize("seed", range(300))
def test_banded_alignment(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, rng.integers(2, 60), rng.integers(1, 60)).astype(np.uint64)
    b = a.tolist()
    for _ in range(rng.integers(0, 10)):
        at = int(rng.integers(0, len(b) + 1))
        b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 60, rng.integers(0, 2)).tolist()
    b = np.array(b, dtype=np.uint64)
    need, want = N._needed(len(a) + len(b)), lcs(a.tolist(), b.tolist())
    got = N.aligned(a, b, need)
    assert got == want if want >= need else got < need


def similar_pairs(texts):
    """All pairs of different texts that are similar, by an index of all shingles; texts by position."""
    found = [N.shingles(t.encode()) for t in texts]
    holders = collections.defaultdict(list)
    for i, own in enumerate(found):
        for x in N.labelled(own).tolist():
            holders[x].append(i)
    common = collections.Counter(
        (j, i) for own, i in zip(found, range(len(found)), strict=True) for x in N.labelled(own).tolist() for j in holders[x] if j < i
    )
    enough = [(i, j) for (i, j), n in common.items() if n >= N._needed(len(found[i]) + len(found[j]))]
    return {(i, j): s for i, j in enough if (s := N.similarity(found[i], found[j])) >= N.SIMILARITY}


def test_pairs_by_edit_rate(spark):
    """Every pair of 0.8 or more is found, whatever share of its words was edited."""
    texts, rates = [], {}
    for n in range(1, 41):
        for copy in range(5):
            words = 120 + 40 * (n % 12)
            edits = 1 + (n + 8 * copy) % max(1, words // 45)
            rates[len(texts) + 1] = edits / words
            origin = prose(words, 10_000 + 5 * n + copy, 50_000)
            texts += [origin, edited(origin, edits, 20_000 + 5 * n + copy)]
    pairs = similar_pairs(texts)
    assert len(pairs) > 150 and max(rates[j] for _, j in pairs) > 0.02 and min(pairs.values()) < 0.82
    got = {r["doc_id"]: r["class_id"] for r in N.find_near_copies(documents(spark, texts)).collect()}
    assert [p for p in pairs if got[p[0]] != got[p[1]]] == []
    assert [i for i in got if got[i] != i and (got[i], i) not in pairs] == []


def test_classes_of_a_given_table(spark):
    """On a given table no similar pair is missed and no class holds texts that no chain of links joins."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in docs.collect()]
    by_text = collections.defaultdict(list)
    for i, t in rows:
        by_text[t].append(i)
    texts = [t for t in by_text if t]
    name = {min(by_text[t]): min(by_text[t]) for t in by_text}
    links = [(min(by_text[texts[i]]), min(by_text[texts[j]])) for i, j in similar_pairs(texts)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    want = {i: name[min(ids)] for ids in by_text.values() for i in ids}
    assert {r["doc_id"]: r["class_id"] for r in N.find_near_copies(docs).collect()} == want
