import re
import struct
from collections import Counter

import numpy as np
import xxhash

from fareline.llm import quality as Q
from tests.llm.rows import documents, prose

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=240):
    texts = []
    for i in range(n):
        text = prose(60, i)
        texts.append(text if i % 4 else text.replace(" ", "!! "))
    return texts


def test_grams_are_tokens_and_pairs():
    raw = ["One one, two  two!! x".encode(), b"", "é|é".encode(), b"one"]
    found = Q.grams(raw)
    per = np.bincount(found.owner, minlength=4).tolist()
    want = []
    for t in raw:
        tokens = TOKEN.findall(t)
        want.append(len(tokens) + max(0, len(tokens) - 1))
    assert per == want
    again = Q.grams([raw[0]])
    assert sorted(again.buckets.tolist()) == sorted(found.buckets[found.owner == 0].tolist())


def test_weights_against_a_plain_sum(spark):
    texts = corpus() + [None, "", corpus()[1]]
    docs = documents(spark, texts)
    marks = labels(spark, [(i, int(i % 4 > 0), 0) for i in range(200)])
    scored, model = Q.weighed(docs, marks)
    told = {r["doc_id"]: r for r in scored.collect()}
    for i, text in enumerate(texts):
        buckets = Q.grams([(text or "").encode()]).buckets
        assert told[i]["weight"] == sum(model.weights[b] for b in buckets.tolist())
    ranked = sorted((r["noisy"] for r in told.values()), reverse=True)
    assert model.cut == ranked[model.k - 1]


def chosen_by_hash(ids, part):
    """Spark's hash of the id and then the seed, as a share of one half per sample."""
    out = set()
    for i in ids:
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", Q.SEED), seed=h)
        if part / 2 <= (h >> 11) / 2**53 <= part / 2 + 0.5:
            out.add(i)
    return out


def test_counts_and_ratios_against_plain_code(spark):
    texts = [*corpus(120), None, "", "a a b", corpus()[1]]
    marks = [(i, int(i % 4 > 0), int(i % 10 == 3)) for i in range(90)] + [(5, 0, 0), (None, 1, 0), (91, None, 0)]
    scored, model = Q.weighed(documents(spark, texts), labels(spark, marks))
    good = {i for i, q, toxic in marks if i is not None and q == 1 and not toxic} - {5}
    target = chosen_by_hash(good, 0)

    def plain_grams(text):
        tokens = [t.decode() for t in TOKEN.findall((text or "").encode())]
        return [(t,) for t in tokens] + list(zip(tokens, tokens[1:]))

    def bucket(gram):  # only the hash is the operator's own
        if len(gram) == 2 and gram[0] == gram[1]:
            return 0
        return int(Q.grams([" ".join(gram).encode()]).buckets[-1])

    raw, aim = Counter(), Counter()
    for i, text in enumerate(texts):
        raw.update(plain_grams(text))
        if i in target:
            aim.update(plain_grams(text))
    place = {g: bucket(g) for g in raw}
    raw_of, aim_of = Counter(), Counter()
    for g, n in raw.items():
        raw_of[place[g]] += n
        aim_of[place[g]] += aim[g]
    all_raw, all_aim = sum(raw.values()), sum(aim.values())
    size = len(model.weights)
    for b in {*raw_of, 0, 17}:
        p, q = (aim_of[b] + 1) / (all_aim + size), (raw_of[b] + 1) / (all_raw + size)
        assert abs(model.weights[b] - np.log(p / q) * Q.UNIT) <= 1
    told = {r["doc_id"]: r["weight"] for r in scored.collect()}
    tried = chosen_by_hash({i for i, q, _ in marks if i is not None and q is not None}, 1)
    # An id with both marks is bad; toxic ones that are not bad take no side.
    bad = {i for i, q, _ in marks if i is not None and q == 0}
    sides = [(told[i], i in good) for i in sorted(tried) if i in good or i in bad]
    want = Q.best_level(np.array([s for s, _ in sides]), np.array([g for _, g in sides]))
    assert model.level == want and model.k == sum(w >= want for w in told.values())


def test_good_documents_stay_and_bad_ones_go(spark):
    texts = corpus()
    docs = documents(spark, texts)
    kept = {r["doc_id"] for r in Q.keep_good(docs, labels(spark, [(i, int(i % 4 > 0), 0) for i in range(160)])).collect()}
    assert kept == {i for i in range(len(texts)) if i % 4}
    assert Q.keep_good(docs, labels(spark, [(1, None, None), (None, 1, 0)])).count() == len(texts)


def test_clean_corpora_lose_nothing_and_empty_ones_work(spark):
    docs = documents(spark, corpus())
    marks = labels(spark, [(i, int(i % 4 > 0), 0) for i in range(160)])
    assert Q.keep_good(docs.limit(0), marks).count() == 0
    assert Q.keep_good(docs, marks.limit(0)).count() == docs.count()
    assert Q.keep_good(docs, marks).columns == docs.columns


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(-(1 << 40), 1 << 40, 500), np.repeat(7, 20), [-(1 << 62), 1 << 61]])
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    ranked = sorted(values.tolist(), reverse=True)
    for k in (1, 2, 100, len(ranked)):
        assert Q.kth_largest(df, "v", k) == ranked[k - 1]


def test_noise_is_gumbel(spark):
    noise = np.array([r[0] for r in documents(spark, [f"t{i}" for i in range(4000)]).select(Q.gumbel()).collect()]) / Q.UNIT
    assert abs(noise.mean() - 0.5772) < 0.1 and abs(noise.std() - 1.2825) < 0.1


def test_level_parts_the_sides():
    assert Q.best_level(np.array([-9, -8, 1, 2]), np.array([False, False, True, True])) == -3
    assert Q.best_level(np.array([5, 5]), np.array([True, False])) == 5
