import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from palimpsest.llm import bpe, queries
from palimpsest.llm.common import table

PATH = public_tokenizers.path(queries.VOCABULARY)
ALPHABET = "abcABC019 \n\t\r\x1c\x1f\x85\xa0\u2003\u3000'st.,!?-²½Ⅷ一二éßñ中文字🙂𝐀𝟘\u200b\u0301"


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(open(PATH, "rb").read())


def test_against_the_library(vocabulary, oracle, spark):
    draw = random.Random(1)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 60))) for _ in range(5000)]
    texts += ["", "a" * 5000, " " * 3000, "=" * 4001, "ab" * 3000, "aab" * 2000, "'s's't it's 's \n's", "\n \n x  y   z", "thestingofthe" * 300]
    texts += [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    ids, starts = bpe.encode_texts([t.encode() for t in texts], vocabulary, public_tokenizers.PATTERN)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == oracle.encode_ordinary(text), text[:80]
    raw, cuts = bpe.decode_ids(ids, vocabulary)
    assert raw == "".join(texts).encode() and cuts[-1] == len(raw)


def test_a_very_long_pretoken(vocabulary, oracle):
    text = "".join(random.Random(2).choices("etaoin", k=60_000))
    assert bpe.encode_texts([text.encode()], vocabulary, public_tokenizers.PATTERN)[0].tolist() == oracle.encode_ordinary(text)


def test_the_queue_pops_ranks_in_order():
    import numpy as np

    queue, draw = bpe.RankQueue(50_000), random.Random(3)
    ranks = [draw.randrange(50_000) for _ in range(3000)]
    for i in range(0, 3000, 100):
        queue.push(np.array(ranks[i : i + 100]), np.arange(i, i + 100))
    out = []
    while (popped := queue.pop()) is not None:
        out += [(popped[0], int(x)) for x in popped[1]]
    assert out == sorted((r, i) for i, r in enumerate(ranks))


def test_columns_and_odd_rows(spark, odd, none):
    tokenizer = bpe.Tokenizer(PATH, public_tokenizers.PATTERN)
    clash = odd.withColumnRenamed("spans", "ids")
    rows = tokenizer.decode(tokenizer.encode(clash)).collect()
    assert len(rows) == odd.count() and all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert tokenizer.decode(tokenizer.encode(none)).count() == 0
    got = {r.doc_id: r for r in queries.op7_bpe(spark, "/root/testdata/sf0.001").collect()}
    for r in table(spark, "/root/testdata/sf0.001", "documents").collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert tokenizer.decode(spark.createDataFrame([([1, 2],), (None,), ([],)], "ids array<int>")).where("decoded is null").count() == 1
