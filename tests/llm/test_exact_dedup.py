import hashlib
import random

from palimpsest.llm import exact_dedup as ed


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live, draw = ed.CuckooIndex(2), {}, random.Random(0)
    for step in range(20_000):
        k = key(draw.randint(0, 3000))
        if k in live:
            assert index.find(k) == live[k]
            if draw.random() < 0.5:
                assert index.delete(k)
                del live[k]
        else:
            assert index.find(k) is None and not index.delete(k)
            index.insert(k, [step])
            live[k] = [step]
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3


def test_a_hit_is_verified():
    index = ed.CuckooIndex(2)
    index.insert(b"\1\0" + b"\0" * 30, [1])
    assert index.find(b"\1\0" + b"\0" * 29 + b"\1") is None  # same tag and buckets


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and (t or "") not in seen
        if kept:
            seen.add(t or "")
        out.append((i, keep, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in ed.exact_dedup(odd).collect()), key=str) == brute(rows)
    assert ed.exact_dedup(none).count() == 0
    kept = ed.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len({t or "" for _, t in rows})
    assert ed.drop_copies(none).count() == 0


def test_withdrawn_digests(spark, odd):
    gone = spark.createDataFrame([(bytearray(hashlib.sha256(b"another text with the same id").digest()),)], "digest binary")
    assert ed.keepers(odd, withdrawn=gone).count() == ed.keepers(odd).count() - 1


def test_large_groups_and_clashing_columns(spark):
    rows = [(i, "common") for i in range(2000)] + [(i, f"text {i % 50}") for i in range(2000, 2200)]
    docs = spark.createDataFrame([(*r, *"abcde") for r in rows], "doc_id long, text string, digest string, key string, ID_OR_0 string, no_id string, salt string")
    assert sorted((tuple(r) for r in ed.exact_dedup(docs).collect()), key=str) == brute(rows)
    kept = ed.drop_copies(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple("abcde")}
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _, k, _ in brute(rows) if k}
