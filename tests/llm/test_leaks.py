import random

from quirelake.llm import leaks

ITEM = "After March 2024 each pivot of Bexford waived its surplus levy yet 203 of the silos stayed rural and one pallet was posted twice"


def brute(text, item):
    a, b = leaks.words_of(text), leaks.words_of(item)
    grams = {tuple(a[i : i + 12]) for i in range(len(a) - 11)}
    return any(tuple(b[i : i + 12]) in grams for i in range(len(b) - 11))


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, lang string, item_text string")
    return leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item_text", "lang", spark.createDataFrame([("Bexford",), (None,)], "name_part string"), "name_part")


def test_kinds_of_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, "Before. " + ITEM + " After."), (2, ITEM.upper()), (3, " ".join(words[3:15])), (4, " ".join(words[3:14])), (5, ITEM.replace("Bexford", "Dunmarsh").replace("203", "117").replace("March", "June")),
        (6, ITEM.replace("surplus", "sur­plus").replace("a", "а")), (7, None), (8, ""), (9, "|" + "\n| ".join(words)), (10, "x " * 50_000 + ITEM), (11, ITEM.replace("levy", "tax").replace("stayed", "were")),
    ]
    docs = [(k, t, None) for k, t in docs]
    rows = frames(spark, docs, [(1, "en", ITEM), (2, "en", ITEM), (3, "fr", None), (4, "fr", "short one")])
    got = {(r.doc_id, r.item_id): r.leak_kind for r in rows.collect()}
    verbatim = {1, 2, 3, 6, 9, 10}
    assert {k for k, v in got.items() if v == "verbatim"} == {(d, i) for d in verbatim for i in (1, 2)}
    assert got[5, 1] == "re-parameterised" and (11, 1) not in got
    assert frames(spark, docs[:0], [(1, "en", ITEM)]).count() == 0
    again = frames(spark, [(5, ITEM.replace("203", "117").replace("March", "June"), None)], [(1, "en", ITEM)]).collect()
    assert [r.leak_kind for r in again] == ["re-parameterised"]
    mixed = "yet 203 of the silos stayed rural and 203 of them were posted twice"
    bad = frames(spark, [(6, mixed.replace("203", "117", 1).replace("203", "118"), None)], [(1, "en", mixed)]).collect()
    assert bad == []  # one number became two


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(40)] + ["12", "7", "March", "EUR", "B12"]
    items = [(i, "en", " ".join(rng.choices(vocabulary, k=40))) for i in range(12)]
    docs = []
    for d in range(60):
        item = rng.choice(items)[2].split()
        n, at = rng.randrange(8, 20), rng.randrange(0, 20)
        docs.append((d, " ".join(rng.choices(vocabulary, k=30) + item[at : at + n] + rng.choices(vocabulary, k=10)), None))
    got = {(r.doc_id, r.item_id) for r in frames(spark, docs, items).where("leak_kind = 'verbatim'").collect()}
    assert got == {(d, i) for d, t, _ in docs for i, _, x in items if brute(t, x)}
    assert got


def test_join_of_windows_gives_the_same(spark):
    """More items than are sent to every task: joined on the hashes of windows."""
    rng = random.Random(3)
    patterns = [" ".join(rng.sample(_sentences(rng), 3)) for _ in range(12)]
    items = [(k, "en", _filled(rng, p)) for k, p in enumerate(patterns)] + [(50, "en", ITEM), (51, "en", ITEM), (52, "en", None), (53, "en", "short")]
    docs = [(d, " ".join(rng.choice([_filled(rng, s) for s in _sentences(rng)] + [items[rng.randrange(12)][2], _again(rng, items[rng.randrange(12)][2]), ITEM]) for _ in range(4)), None) for d in range(80)]
    docs += [(100, None, None), (101, "", None), (102, ITEM + " " + ITEM, None), (None, ITEM, None)]
    parts = spark.createDataFrame([(n,) for n in "Bexford Dunmarsh Quillbay Hollowford Ostravale".split()], "name_part string")
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, lang string, item_text string")
    one = leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item_text", "lang", parts, "name_part").collect()
    many = leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item_text", "lang", parts, "name_part", block_words=30).collect()
    assert {r.leak_kind for r in one} == {"verbatim", "re-parameterised"} and sorted(one, key=str) == sorted(many, key=str)


def test_windows_of_placeholders_alone_are_no_leak(spark):
    numbers = " ".join(str(k) for k in range(100, 114))
    rows = frames(spark, [(1, " ".join(str(k) for k in range(500, 514)), None), (2, numbers, None)], [(1, "en", numbers)]).collect()
    assert [(r.doc_id, r.leak_kind) for r in rows] == [(2, "verbatim")]


def test_passages_are_judged_by_themselves(spark):
    clean = "after the audit of 12 ledgers in March the clerk left every renewal sealed and 40 pallets waived"
    item = "yet 203 of the silos stayed rural and 203 of them were posted twice before a break " + clean
    text = item.replace("203", "117", 1).replace("203", "118").replace("a break", "some pause").replace("12", "31").replace("40", "77")
    rows = frames(spark, [(1, text, None)], [(1, "en", item)]).collect()
    assert [(r.leak_kind, r.windows) for r in rows] == [("re-parameterised", len(clean.split()) - 11)]


def test_ids_of_other_types(spark):
    d = spark.createDataFrame([("d", ITEM), (None, ITEM)], "doc_id string, text string")
    i = spark.createDataFrame([("x", "en", ITEM), ("y", "en", ITEM), (None, "en", ITEM)], "item_id string, lang string, item_text string")
    got = leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item_text", "lang", spark.createDataFrame([("a",)], "name_part string"), "name_part")
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(a, b) for a in ("d", None) for b in ("x", "y", None)}


def _sentences(rng):
    nouns, verbs, adjectives = "ledger broker pivot silo barge panel coupon roster kiosk tenant waybill valve".split(), "waived merged halved queued disputed matched renamed recast shelved weighed".split(), "frozen rural joint overdue narrow bonded dormant spare mixed sealed".split()
    w = lambda x: rng.choice(x)
    return [
        f"After {{m}} {{n}} each {w(nouns)} of {{p}} {w(verbs)} its {w(adjectives)} {w(nouns)} yet {{n}} of the {w(nouns)}s stayed {w(adjectives)} and one {w(nouns)} was {w(verbs)} twice.",
        f"Whoever {w(verbs)} the {w(nouns)} also {w(verbs)} {{n}} {w(nouns)}s, so the {w(adjectives)} {w(nouns)} in {{c}} equals {{n}} {{u}} of the {w(nouns)} from {{p}}.",
        f"If the {w(nouns)} is {w(adjectives)}, the {w(nouns)} in {{c}} must be {w(verbs)}; if it is {w(adjectives)}, the {w(nouns)} costs {{n}} {{u}} per {w(nouns)}.",
    ]


def _filled(rng, sentence):
    import re

    slots = {"m": "March April June July August".split(), "p": "Bexford Dunmarsh Quillbay Hollowford Ostravale".split(), "u": "EUR USD kg".split()}
    fresh = lambda kind: str(rng.randrange(10, 9999)) if kind == "n" else f"{rng.choice('ABCDEFG')}{rng.randrange(1, 300)}" if kind == "c" else rng.choice(slots[kind])
    return re.sub(r"\{(.)\}", lambda m: fresh(m[1]), sentence)


def _again(rng, item):
    """The item with other numbers, cells, months, places and units: each value is replaced by one that nothing else became."""
    import re

    lists = ["March April June July August".split(), "Bexford Dunmarsh Quillbay Hollowford Ostravale".split(), "EUR USD kg".split()]
    turned = {w: ws[(k + 1) % len(ws)] for ws in lists for k, w in enumerate(ws)}
    shift = rng.randrange(10_000, 20_000)
    word = lambda w: turned.get(w) or (f"{w[0]}{int(w[1:]) + 300}" if re.fullmatch(r"[A-G][0-9]+", w) else str(int(w) + shift) if w.isdigit() else w)
    return re.sub(r"\w+", lambda m: word(m.group()), item)


def test_recall_and_precision_of_planted_items(spark):
    """Items whose slots were filled anew are found, texts of the same sentence patterns with other words are not."""
    rng = random.Random(11)
    names = spark.createDataFrame([(n,) for n in "Bexford Dunmarsh Quillbay Hollowford Ostravale".split()], "name_part string")
    patterns = [" ".join(rng.sample(_sentences(rng), 3)) for _ in range(40)]
    items = [(k, "en", _filled(rng, p)) for k, p in enumerate(patterns)]
    docs, want = [], set()
    for d in range(600):
        other = " ".join(_filled(rng, s) for s in _sentences(rng))
        if d % 3 == 0:
            k = rng.randrange(40)
            docs.append((d, f"{other} {_again(rng, items[k][2])} {other}"))
            want.add((d, k))
        else:
            docs.append((d, other))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, lang string, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", "item_text", "lang", names, "name_part").collect()}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    print(recall, precision)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)
