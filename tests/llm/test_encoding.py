import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import encoding

PIECES = st.sampled_from(["a", "B", "'s", "'", "re", " ", "  ", "\n", "\t", "\r\n", "\x1c", " ", "　", "1", "23", "!", "...", "é", "é", "漢字", "👩‍💻", "<|endoftext|>", "word ", " the", "x" * 40])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=300).map("".join))
def test_units_encode_like_the_whole(text):
    own = encoding.encoder()
    units = encoding.units_of(text, 32)
    assert "".join(units) == text
    assert [i for u in units for i in own.encode_ordinary(u)] == own.encode_ordinary(text)


def test_shared_passages_share_units():
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    passage = " ".join(words)
    a, b = set(encoding.units_of("one two three " + passage)), set(encoding.units_of("something else entirely: " + passage + " end"))
    assert sum(map(len, a & b)) > 0.8 * len(passage)


def test_encode_corpus(spark):
    own = encoding.encoder()
    texts = {1: "Hello world, hello again.", 2: None, 3: "", 4: "x" * 30_000, 5: "one two " * 4000, 6: "日本語" * 500, 7: "one two " * 4000}
    df = spark.createDataFrame([(k, v, "u", 1) for k, v in texts.items()], "doc_id long, text string, unit string, pos int")
    got = {r.doc_id: list(r.ids) for r in encoding.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {k: own.encode_ordinary(v or "") for k, v in texts.items()}
    twice = encoding.encode_corpus(df.where("doc_id = 1").unionByName(df.where("doc_id = 1")), "doc_id", "text")
    assert [list(r.ids) for r in twice.collect()] == [got[1], got[1]]
    assert encoding.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_repeated_filter_and_full_filter(spark, monkeypatch):
    own = encoding.encoder()
    passage = " ".join(f"w{k}" for k in range(900))
    texts = {1: passage, 2: "before it " + passage, 3: "nothing shared at all", 4: passage + " and after", 5: " ".join(f"v{k}" for k in range(900))}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    want = {str(k): own.encode_ordinary(v) for k, v in texts.items()}
    held = []
    real = encoding.repeated_filter
    monkeypatch.setattr(encoding, "repeated_filter", lambda *a: held.append(real(*a)) or held[-1])
    assert {r.doc_id: list(r.ids) for r in encoding.encode_corpus(df, "doc_id", "text").collect()} == want
    counts = {}
    for t in texts.values():
        for u in encoding.units_of(t):
            counts[encoding._digest(u)] = counts.get(encoding._digest(u), 0) + 1
    repeated = {int(encoding._bits(np.frombuffer(d, np.uint8), encoding.FILTER_BITS)[0]) for d, n in counts.items() if n > 1}
    assert repeated and set(np.flatnonzero(np.unpackbits(held[0], bitorder="little")).tolist()) == repeated
    # a filter that holds everything changes no result
    monkeypatch.setattr(encoding, "repeated_filter", lambda *a: np.full(encoding.FILTER_BITS // 8, 255, np.uint8))
    assert {r.doc_id: list(r.ids) for r in encoding.encode_corpus(df, "doc_id", "text").collect()} == want
