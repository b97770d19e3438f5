import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import suffix_dedup as sd
from palimpsest.llm.common import table


def gone_of(docs, length):
    """Of each text the bytes in repeated strings, from all strings as they are."""
    seen = Counter(r[k : k + length] for _, r in docs for k in range(len(r) - length + 1))
    for _, r in docs:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        yield gone


def brute(docs, length, short):
    out = []
    for (i, r), gone, repeated in zip(docs, gone_of(docs, length), gone_of(docs, short), strict=True):
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest(), sum(repeated)))
    return sorted(out, key=str)


def ours(df, **options):
    found = sd.remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256), "n_repeated")
    return sorted((tuple(r) for r in found.collect()), key=str)


def made(seed, n=60):
    draw = random.Random(seed)
    base = "".join(draw.choices("ab", k=300))
    out = []
    for i in range(n):
        text = ""
        while len(text) < draw.randint(0, 400):
            a = draw.randint(0, 250)
            text += base[a : a + draw.randint(5, 120)] if draw.random() < 0.7 else "".join(draw.choices("abé", k=draw.randint(1, 30)))
        out.append((i, "a" * draw.randint(0, 200) if draw.random() < 0.1 else text))
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("group", [sd.GROUP, 2])
def test_brute_force(spark, seed, group):
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for short in (25, 40):
        assert ours(df, length=40, short=short, gram=13, group=group) == brute([(i, t.encode()) for i, t in docs], 40, short)


def test_long_texts_in_parts(monkeypatch):
    draw = random.Random(1)
    text = "".join(draw.choices("abcd", k=3000)).encode()
    monkeypatch.setattr(sd, "BLOCK", 500)
    starts, of = [], sd.Sizes(60, 40, 13)
    for data, parts in sd._blocks([text, b"short", text[:700]], of):
        own, first, counts, whole, *_ = sd._runs(data, parts, of)
        for k, s, n, m in zip(own, first, counts, whole, strict=True):
            at = int(s) - parts[k].start + parts[k].offset
            starts += [(parts[k].owner, at + i) for i in range(n)]
            assert m == max(0, min(n, (3000 if parts[k].owner == 0 else 700) - at - 59))
    assert sorted(starts) == [(0, i) for i in range(3000 - 39)] + [(2, i) for i in range(700 - 39)]


def test_sorted_suffixes_have_the_order_of_their_bytes():
    draw = random.Random(2)
    data = np.frombuffer(bytes(draw.choices(b"ab", k=400)), np.uint8)
    positions = np.arange(0, 360)
    classes = np.repeat([0, 1, 2], 120)
    limit = np.array([draw.randint(1, 40) for _ in positions])
    order = sd.sort_suffixes(data, positions, classes, limit)
    raw = data.tobytes()
    for k in range(3):
        own = [raw[positions[i] : positions[i] + limit[i]] for i in order[classes == k]]
        assert own == sorted(own)


def test_common_extension():
    data = np.frombuffer(b"abcabcabx" + b"q" * 20, np.uint8)
    n = 1 << 20
    assert sd.common_extension(sd._prefix(data), sd._powers(n)[1], np.array([0, 0, 1]), np.array([3, 0, 2]), np.array([8, 7, 8])).tolist() == [5, 7, 0]


def test_odd_rows(odd, none):
    rows = odd.select("doc_id", "text").collect()
    assert ours(odd, length=20, short=12, gram=8) == brute([(r[0], (r[1] or "").encode()) for r in rows if r[1] is None or len(r[1]) < 60_000] + [(4, b"word " * 30_000)], 20, 12)
    assert ours(none) == []


def test_contract_columns(spark):
    from palimpsest.llm.queries import op1_suffix_array

    found = op1_suffix_array(spark, "/root/testdata/sf0.001")
    assert found.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), ("n_repeated", "bigint")]
    docs = [(r.doc_id, (r.text or "").encode()) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, sd.LENGTH, sd.SHORT)


def test_lengths_below_the_defaults(spark):
    docs = made(5, 20)
    assert ours(spark.createDataFrame(docs, "doc_id long, text string"), length=30) == brute([(i, t.encode()) for i, t in docs], 30, 30)


def test_passages_of_over_fifty_words(spark):
    """Shorter than a removed string, but told of."""
    words = "the passage that we put in two texts has some fifty words of its own".split()
    draw = random.Random(9)
    passage = " ".join(draw.choice(words) + draw.choice(["", "s", "ing", "ed"]) for _ in range(58))
    other = lambda: " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(80))
    assert sd.SHORT <= len(passage) < sd.LENGTH
    docs = spark.createDataFrame([(1, f"{other()} {passage} {other()}"), (2, f"{passage} {other()}"), (3, other())], "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_repeated) for r in sd.remove_repeats(docs).collect()}
    assert found[3] == (0, 0) and all(found[i][0] == 0 and len(passage) <= found[i][1] <= len(passage) + 2 for i in (1, 2))
