import math
from collections import Counter

import numpy as np

from palimpsest.llm import cross_entropy as ce

ROWS = [(1, "the cat sat on the mat"), (2, "The dog sat on the log"), (3, "buy now buy now"), (4, ""), (5, None), (3, "buy now buy now"), (None, "the cat")]


def brute(rows, targets, prior=ce.PRIOR):
    texts = [(i, (t or "").lower().split()) for i, t in rows]
    size = len({w for _, ws in texts for w in ws}) + 1
    models = {True: Counter(), False: Counter()}
    for i, ws in texts:
        models[i in targets].update(zip(["<s>", *ws], ws, strict=False))

    def loss(m, a, b):
        uni = sum(n for (_, y), n in m.items() if y == b)
        ctx = sum(n for (x, _), n in m.items() if x == a)
        return -math.log((m[a, b] + prior * (uni + 1) / (sum(m.values()) + size)) / (ctx + prior))

    out = []
    for i, ws in texts:
        pairs = list(zip(["<s>", *ws], ws, strict=False))
        t, b = (sum(loss(models[k], *p) for p in pairs) / max(1, len(pairs)) for k in (True, False))
        out.append((i, i in targets, len(ws), round(t, 9), round(b, 9), round(t - b, 9)))
    return sorted(out, key=str)


def ours(rows):
    return sorted(((r[0], r[1], r[2], *(round(x, 9) + 0.0 for x in r[3:])) for r in rows.collect()), key=str)


def test_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for targets in ([1, 4], [], [1, 2, 3, 4, 5]):
        ids = spark.createDataFrame([(t,) for t in [*targets, None]], "doc_id long")
        want = [(i, t, n, a + 0.0, b + 0.0, c + 0.0) for i, t, n, a, b, c in brute(ROWS, set(targets))]
        for sizes in ({}, {"block": 30, "bucket": 2}):  # the latter: many blocks and buckets
            got = ours(ce.score(docs, ids, **sizes))
            assert [g[:3] for g in got] == [w[:3] for w in want]
            assert all(abs(x - y) < 1e-6 for g, w in zip(got, want, strict=True) for x, y in zip(g[3:], w[3:], strict=True))


def test_odd_rows(spark, odd, none):
    ids = spark.createDataFrame([(5,)], "doc_id long")
    assert ce.score(odd, ids).count() == odd.count()
    assert ce.score(none, ids).count() == 0


def test_every_word_is_in_the_vocabulary(spark):
    """Also the rarest among many tokens: texts that differ only in these differ in score."""
    rows = [(1, "the of " * 30_000), (2, "the red fox"), (3, "the red hen"), (4, "the red fox"), (5, "a fox")]
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(4,)], "doc_id long")
    words = Counter(w for _, t in rows for w in t.split())
    models = {k: Counter(p for i, t in rows if (i == 4) == k for p in zip(["<s>", *t.split()], t.split(), strict=False)) for k in (True, False)}

    def loss(m, a, b):
        uni, ctx = (sum(n for p, n in m.items() if p[k] == x) for k, x in ((1, b), (0, a)))
        return -math.log((m[a, b] + ce.PRIOR * (uni + 1) / (sum(m.values()) + len(words) + 1)) / (ctx + ce.PRIOR))

    for sizes in ({}, {"block": 10, "bucket": 2}):
        got = {r.doc_id: r for r in ce.score(docs, ids, **sizes).collect()}
        for i, t in rows:
            pairs = list(zip(["<s>", *t.split()], t.split(), strict=False))
            want = [sum(n * loss(models[k], *p) for p, n in Counter(pairs).items()) / len(pairs) for k in (True, False)]
            assert abs(got[i].target_loss - want[0]) < 1e-9 and abs(got[i].background_loss - want[1]) < 1e-9
        assert got[2].score < got[3].score


def test_packing():
    rng = np.random.default_rng(0)
    for n in (1, 5, 1000):
        codes = np.unique(rng.integers(1 << 60, (1 << 64) - 1, n, dtype=np.uint64, endpoint=True))
        assert (ce.unpack_codes(ce.pack_codes(codes, 1 << 60), 1 << 60) == codes).all()
        counts = rng.choice([0, 1, 254, 255, 256, 1 << 40], (2, n))
        assert (ce.unpack_counts(ce.pack_counts(counts.ravel()), 2, n) == counts).all()
    for buckets in (ce.Buckets(1, 3), ce.Buckets(7, 1000)):
        codes = np.unique(np.concatenate((np.array([0, (1 << 64) - 1], np.uint64), rng.integers(0, (1 << 64) - 1, 5000, dtype=np.uint64))))
        for is_pair in (False, True):
            cuts = list(buckets.cut(codes, is_pair))
            assert np.concatenate([codes[at] for _, at in cuts]).tolist() == codes.tolist()
            assert all(buckets.base(k) <= int(codes[at][0]) for k, at in cuts)
