import random

import numpy as np
import pytest
import xxhash

from palimpsest.llm import components, queries, simhash
from palimpsest.llm.common import table

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text, size=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits):
    """fps: id -> fingerprint; the least id reachable."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits):
            x, y = root(i), root(ids[k + 1 + j])
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints(odd):
    for text in [None, "", " ", "One", "a b c", "A b c d e f", "é è ê ë a\x0bb\x0cc", "x\x1cy z w q"]:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text), text


@pytest.mark.parametrize("chunk", [4096, 3])
def test_links_lose_none(spark, chunk):
    draw = random.Random(6)
    fps = set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(draw.randint(1, 30)):
            x = centre
            for _ in range(draw.randint(0, 6)):
                x ^= 1 << draw.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), chunk=chunk)
    found = {r.node: r.root for r in components.components(edges).collect()}
    want = plain_components({s: f for s, f in zip(signed, fps, strict=True)}, simhash.BITS)
    assert {s: found.get(s, s) for s in signed} == want


def test_components_of_a_chain_a_star_and_noise(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3), (7, 6)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    rows = odd.select("doc_id", "text").collect()
    found = simhash.near_duplicates(odd)
    assert sorted((r.doc_id or -1, r.fingerprint) for r in found.collect()) == sorted((r[0] or -1, format(plain_fingerprint(r[1]), "016x")) for r in rows)
    assert {r.component_id for r in found.where("fingerprint = '0000000000000000'").collect()} == {1}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == found.select("component_id", "fingerprint").where("kept").distinct().count()
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_large_groups_and_clashing_columns(spark):
    words = [f"w{i}" for i in range(400)]
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(0, 400, 4)]
    rows = [(i, None) for i in range(300)] + [(i, near[i % 100]) for i in range(300, 900)] + [(i, f"quite another text {i} {i * 7}") for i in range(900, 1000)]
    docs = spark.createDataFrame([(*r, *"abcde") for r in rows], "doc_id long, text string, key string, _key string, salt string, NO_ID string, fp string")
    want = plain_components({i: plain_fingerprint(t) for i, t in rows}, 4)
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want and len(found) == len(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {tuple("abcde")}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_query_against_a_plain_version(spark):
    """op9's rows over its whole table: fingerprints by words and bits, components by all pairs."""
    sf = "/root/testdata/sf0.001"
    prints = {r.doc_id: plain_fingerprint(r.text) for r in table(spark, sf, "documents").collect()}
    roots = plain_components(prints, 4)
    rows = queries.op9_simhash(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, format(f, "016x"), roots[i]) for i, f in prints.items())
