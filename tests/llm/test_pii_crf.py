import hashlib
import random
import re

import numpy as np
import pytest

from palimpsest.llm import pii_crf as pii
from palimpsest.llm import queries
from palimpsest.llm.common import table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


def test_base_spans_are_the_patterns_matches():
    draw = random.Random(4)
    for _ in range(20_000):
        text = "".join(draw.choices("a.@-1 2 3+4().5%9\né", k=draw.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 100_000, "a@" * 100_000])
def test_base_spans_take_linear_time(text):
    pii.base_spans(text)


@pytest.fixture(scope="module")
def model():
    return pii.train()


def test_held_out_labels(model):
    right = total = 0
    for words, labels in pii.labelled_table(300, seed=99):
        found = pii.viterbi(pii.emissions(model.weights, [words]), np.array([len(words)]), model.transitions)
        right += sum(pii.LABELS[a] == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path():
    from itertools import product

    draw = np.random.default_rng(1)
    sizes, n = np.array([3, 1, 4]), 3
    scores, transitions = draw.normal(size=(8, n)), draw.normal(size=(n, n))
    found, at = pii.viterbi(scores, sizes, transitions), 0
    for size in sizes:
        own = scores[at : at + size]
        value = lambda p, own=own: sum(own[t, x] for t, x in enumerate(p)) + sum(transitions[a, b] for a, b in zip(p, p[1:], strict=False))
        assert tuple(found[at : at + size]) == max(product(range(n), repeat=int(size)), key=value)
        at += size


def test_the_field_adds_disguised_spans(model):
    texts = ["call (555) 123-4567 now", "write to john [at] example dot com please", "mail a.b@ex.com", "nothing 12 of 2024-01-05 version 2.0.1 here"]
    (b0, a0), (b1, a1), (b2, a2), (b3, a3) = pii.find(texts, model)
    assert a0["phone"] == [(5, 19)] and texts[1][slice(*a1["email"][0])] == "john [at] example dot com"
    assert b2["email"] == [(5, 15)] and not a2["email"]
    assert not any(b3.values()) and not any(a3.values())


@pytest.mark.parametrize("address", [
    "john.smith [at] example dot org", "john.smith (at) example.org", "john.smith[at]example[dot]org", "john.smith @ example.org",
    "john.smith (at) example (dot) org", "john.smith{at}example.org", "john.smith(AT)example(DOT)org",
])
def test_disguised_addresses_reach_the_field_without_digits_nearby(address):
    text = f"please write a letter to our good friend {address} and wait there for some kind answer"
    assert any(a <= text.index(address) and b >= text.index(address) + len(address) for s in pii.sequences(text) for a, b in [(s[0][0], s[-1][1])])


def test_every_labelled_form_is_found_without_digits_nearby(model):
    syllables = ["an", "er", "ti", "la", "que", "ment"]
    draw, missed = random.Random(3), {}
    for form in ("{}@{}.{}", "{} [at] {} dot {}", "{} (at) {}.{}", "{}[at]{}[dot]{}", "{} @ {}.{}", "{} (at) {} (dot) {}", "{} at {} dot {}", "{}(at){}(dot){}", "{}(at){}.{}", "{} [at] {} [dot] {}"):
        missed[form] = 0
        for _ in range(50):
            name = lambda: "".join(draw.choices(syllables, k=2))
            address = form.format(f"{name()}.{name()}", name(), draw.choice(["com", "org", "net"]))
            text = f"quement laan titi {address} erla anque tila lament"
            (base, added), = pii.find([text], model)
            missed[form] += address not in [text[a:b] for a, b in base["email"] + added["email"]]
    assert max(missed.values()) <= 5, missed


@pytest.mark.parametrize("address", ["john[at]example[dot]com", "john(at)example.com", "john(at)example(dot)com", "john at example dot com"])
def test_plain_disguised_addresses(model, address):
    (_, added), = pii.find([f"please write to {address} if you like"], model)
    assert [f"please write to {address} if you like"[a:b] for a, b in added["email"]] == [address]


def test_words_at_alone_is_no_address(model):
    texts = ["we met at noon and looked at the dot on the wall", "have a look at example.com or meet us at the station", "he was at home at ten - and left at 12 ..."]
    assert not any(s for _, added in pii.find(texts, model) for s in added.values())


def plain_spans(text, model):
    """All spans of a text, decoded word by word and path by path of one sequence at a time."""
    n = len(pii.LABELS)
    places = [m.span() for m in re.finditer(r"\S+", text)]
    words = [text[a:b] for a, b in places]
    near = [any(0 <= j < len(words) and (re.search(r"[0-9@]|\b(?:at|dot)\b", words[j], re.I) or not any(c.isalpha() for c in words[j])) for j in range(i - 3, i + 4)) for i in range(len(words))]
    base, out = plain(text), {k: [] for k in pii.KINDS}
    i = 0
    while i < len(words) and re.search(r"[0-9@]|\bat\b", text, re.I):
        if not near[i]:
            i += 1
            continue
        j = i
        while j < len(words) and near[j]:
            j += 1
        own = ["<s>", *words[i:j], "</s>"]
        best, back = None, []
        for t in range(1, len(own) - 1):
            x = model.weights[[*pii._features(own[t]), *pii._beside(own[t - 1], "before"), *pii._beside(own[t + 1], "after")]].astype(float).sum(axis=0)
            if best is None:
                best = list(x)
                continue
            steps = [[best[a] + model.transitions[a, b] for a in range(n)] for b in range(n)]
            back.append([max(range(n), key=s.__getitem__) for s in steps])
            best = [max(s) + v for s, v in zip(steps, x, strict=True)]
        path = [max(range(n), key=best.__getitem__)]
        for step in reversed(back):
            path.append(step[path[-1]])
        names = [pii.LABELS[k] for k in reversed(path)]
        t = 0
        while t < len(names):
            e = t + 1
            if names[t] != "O":
                kind = names[t][2:]
                while e < len(names) and names[e] == f"I-{kind}":
                    e += 1
                a, b = places[i + t][0], places[i + e - 1][1]
                while a < b and text[a] in pii._TRIM:
                    a += 1
                while a < b and (text[b - 1] in pii._TRIM or (text[b - 1] == ")" and "(" not in text[a:b])):
                    b -= 1
                if a < b and pii._possible(kind, text[a:b]) and all(y <= a or b <= x for spans in base.values() for x, y in spans):
                    out[kind].append((a, b))
            t = e
        i = j
    return base, {k: sorted(base[k] + out[k]) for k in pii.KINDS}


def test_query_against_a_plain_version(spark, model):
    """op4's rows over its whole table, base and added spans."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = queries.op4_pii_crf(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base, spans = plain_spans(texts[r.doc_id], model)
        listed = lambda found: ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest() and r.spans == listed(spans)


def test_long_words(model):
    text = f"call {'x1' * 100_000} or (555) 123-4567 {'-' * 100_000} now"
    (_, added), = pii.find([text], model)
    assert [text[a:b] for a, b in added["phone"]] == ["(555) 123-4567"]


def test_query_and_odd_rows(spark, odd, none, model):
    out = queries.op4_pii_crf(spark, "/root/testdata/sf0.001")
    assert [t for _, t in out.dtypes] == ["bigint"] * 5 + ["string"] * 2
    found = pii.find_personal_data(odd, model)
    assert found.count() == odd.count() and found.where("size(spans) > 0").count() == 0
    assert pii.find_personal_data(none, model).count() == 0
