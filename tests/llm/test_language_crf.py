import re
import zlib
from itertools import product

import numpy as np

from palimpsest.llm import language_crf as crf
from palimpsest.llm import queries
from palimpsest.llm.common import table

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.op5_language_crf(spark, SF)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = found.join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(0)
    sizes, n = np.array([3, 1, 4]), 3
    scores, transitions = draw.normal(size=(8, n)), draw.normal(size=(n, n))
    pairs = np.zeros((n, n))
    got = crf.forward_backward(scores, sizes, transitions, pairs)
    want, want_pairs, at = np.zeros_like(scores), np.zeros((n, n)), 0
    for size in sizes:
        total, node, edge = 0.0, np.zeros((size, n)), np.zeros((n, n))
        for path in product(range(n), repeat=int(size)):
            w = np.exp(sum(scores[at + t, x] for t, x in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            for t, x in enumerate(path):
                node[t, x] += w
            for a, b in zip(path, path[1:], strict=False):
                edge[a, b] += w
        want[at : at + size] = node / total
        want_pairs += edge / total
        at += size
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_chunks_are_one_chain():
    draw = np.random.default_rng(2)
    sizes, n = np.array([5, 200, 1, 64, 65, 128, 1000]), 4
    scores, transitions = draw.normal(size=(sizes.sum(), n)) * 0.3, draw.normal(size=(n, n)) * 2
    want = crf.forward_backward(scores, sizes, transitions)
    for chunk in (1, 7, 64, 5000):
        assert np.allclose(crf.chain_forward_backward(scores, sizes, transitions, chunk), want)
    single = crf.chain_forward_backward(scores.astype(np.float32), sizes, transitions.astype(np.float32))
    assert np.abs(single - want).max() < 1e-4
    assert crf.chain_forward_backward(scores[:0], sizes[:0], transitions).shape == (0, n)


def plain_document(model, text):
    """The prediction and mean of a text from the words, features and sums written out one by one, without batches, blocks or chunks."""
    word = re.compile(rb"[a-z\x80-\xff]+")
    raw = b" " + text.lower().encode() + b" "
    mask = (1 << 64) - 1
    base = crf._BASE

    def slot(x, kind):
        x = (x + kind + 1) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 31) * 0x94D049BB133111EB & mask
        return x >> (64 - crf.TABLE_BITS)

    def polynomial(w):
        return sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) & mask

    scores = []
    for m in word.finditer(raw):
        w = m[0]
        slots = [slot(polynomial(w), 1), slot(polynomial(w[:2]), 2), slot(polynomial(w[:4]), 3), slot(polynomial(w[-2:]), 4), slot(polynomial(w[-4:]), 5)]
        padded = b" " + w + b" "
        slots += [slot(padded[k] << 16 | padded[k + 1] << 8 | padded[k + 2], 6) for k in range(len(w))]
        scores.append(model.weights[slots].astype(float).sum(axis=0))
    scores, step = np.array(scores), model.transitions.astype(float)
    forward, backward = [scores[0]], [np.zeros(scores.shape[1])]
    for x in scores[1:]:
        forward.append(x + np.logaddexp.reduce(forward[-1][:, None] + step, axis=0))
    for x in scores[:0:-1]:
        backward.append(np.logaddexp.reduce(step + x + backward[-1], axis=1))
    both = np.array(forward) + np.array(backward[::-1])
    return np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None]).mean(axis=0)


def test_query_against_a_plain_version(spark):
    """op5's rows over its whole table: every document's language and score, computed word by word."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = crf.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op5_language_crf(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        p = plain_document(model, text)
        assert model.languages[int(p.argmax())] == r.lang_pred and abs(p.max() - r.score) < 1e-3


def test_switched_text_is_labelled_word_by_word(spark):
    docs = table(spark, SF, "documents").where("lang in ('en', 'de') and n_chars between 300 and 3000").select("text", "lang").limit(300).collect()
    model = crf.fit([r.text for r in docs], [r.lang for r in docs])
    en, de = (next(r.text for r in docs if r.lang == x)[:200] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string")
    runs = crf.identify(mixed, model, runs=True).first().runs
    assert runs[0].lang == "en" and runs[-1].lang == "de" and len(runs) < 12
    assert model.transitions.diagonal().min() > (model.transitions - 9 * np.eye(2)).max()


def test_odd_rows(odd, none):
    model = crf.fit(["the and of", "der und die"] * 20, ["en", "de"] * 20)
    rows = {(r.doc_id, r.lang_pred) for r in crf.identify(odd, model).collect()}
    assert {i for i, x in rows if x == "und"} == {1, 2, 3, None} and crf.identify(odd, model).count() == odd.count()
    assert crf.identify(none, model).count() == 0
    assert {r.lang_pred for r in crf.identify(odd, crf.train(odd)).collect()} == {"und"}  # no language is known


def test_long_and_rare_languages_are_learned(spark):
    en, de, fr = "the cat and the dog were here ", "der Hund und die Katze waren hier ", "le chien et le chat sont ici "
    rows = [(i, en, "en") for i in range(3 * crf.SAMPLE_DOCS)] + [(10_000 + i, de * 400, "de") for i in range(8)] + [(20_000 + i, fr * 50, "fr") for i in range(4)]
    model = crf.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    found = crf.identify(spark.createDataFrame([(1, en), (2, de), (3, fr)], "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in found.collect()} == {1: "en", 2: "de", 3: "fr"}
    only_long = crf.train(spark.createDataFrame(rows[-12:-4], "doc_id long, text string, lang string"))
    assert only_long.languages == ["de"]


def test_long_texts_are_read_from_start_to_end(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    words = [int(w[1:]) for w in spark.createDataFrame([(text,)], "text string").select(crf._spread("text")).first()[0].split()]
    assert words == sorted(set(words)) and words[0] < 5 and words[-1] > 19_990 and max(b - a for a, b in zip(words, words[1:])) < 2_500


def test_shares_fill_the_sample():
    shares = crf._shares({"a": 10**9, "b": 10**6, "c": 3})
    assert shares["c"] == 3 and sum(shares.values()) == crf.SAMPLE_DOCS and abs(shares["a"] - shares["b"]) <= 1
    assert set(crf._shares({str(i): 100 for i in range(500)}).values()) == {crf.LEAST_DOCS}
