import random
import re

from palimpsest.llm import decontaminate as dc

LOWER = {c: c + 32 for c in range(65, 91)}
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, size):
    found = [m for m in WORDS.finditer((text or "").translate(LOWER))]
    words = [m[0] for m in found]
    hit, named = set(), set()
    for name, item in items:
        own = WORDS.findall((item or "").translate(LOWER))
        for w in {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else ():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    named.add("null" if name is None else str(name))
    return len(words), sorted(hit), sorted(named), [(found[i].start(), found[i].end()) for i in sorted(hit)]


ITEMS = [(1, "One two THREE four five"), (2, "two three"), (3, None), (4, ""), (5, "!!"), (6, "été où"), (None, "seven eight nine ten"), (2, "aa aa aa aa"), (7, "One two three four five")]
TEXTS = ["zero one two-three FOUR five six", "Seven, eight; nine: TEN", "x été  où y", "aa aa aa aa aa aa", "onetwo three", "two three two three one two three four five", "", "two"]


def test_brute_force(spark, odd, none, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, words string")
    for bound in (dc.BLOCK_BYTES, 30):
        monkeypatch.setattr(dc, "BLOCK_BYTES", bound)
        for r in dc.find_windows(docs, items, size=4).collect():
            n, hit, named, spans = brute(r.text, ITEMS, 4)
            assert (r.words, r["items"]) == (n, named) and [i for h in r.hits for i in range(h.first, h.last)] == hit
            text = r.text or ""
            covered = {i for s in r.spans for i in range(s.start, s.end)}
            assert all(set(range(a, b)) <= covered for a, b in spans) and all(text[s.start : s.end].strip() for s in r.spans)
    monkeypatch.undo()
    assert dc.find_windows(odd, items).count() == odd.count()
    assert dc.find_windows(none, items).count() == 0
    assert dc.find_windows(odd, items.limit(0)).where("size(items) > 0").count() == 0


def test_many_words_of_the_items():
    """More words than a symbol can number, some being others' beginnings."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(30_000)]
    items = [(str(k), " ".join(draw.choices(words, k=draw.randint(1, 12)))) for k in range(1200)]
    held = dc.built([(i, t.encode()) for i, t in items], 3)
    assert len(held.other) == 3
    for _ in range(30):
        own = [w for _ in range(4) for w in draw.choice(items)[1].split()[: draw.randint(1, 9)] + draw.choices([*words, "none"], k=draw.randint(0, 3))]
        n, hit, named, _ = brute(" ".join(own), items, 3)
        count, flags, found = dc.scan(" ".join(own).encode(), held)
        assert (count, sorted(found)) == (n, named) and hit == ([] if flags is None else flags.nonzero()[0].tolist())
