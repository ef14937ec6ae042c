import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quirelake.llm import looks

SAME = [
    ("ＡＢＣ１２", "ABC12"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("a　b", "a b"), ("co‑op", "co-op"), ("co‐op", "co-op"), ("ﬁnal ﬂow", "final flow"),
    ("zero​width", "zerowidth"), ("so­ft", "soft"), ("b﻿om", "bom"), ("Раураl", "Paypal"), ("Κpι".replace("ι", "i"), "Kpi"), ("ｶﾞ", "ガ"), ("객", "객"), ("Å", "Å"), ("Ω", "Ω"), ("µ", "μ"),
    ("ệ", "ệ"), ("ѐ", "è"), ("a\r\nb", "a\nb"), ("x͏y", "xy"),
]
OTHER = [("A", "a"), ("é", "e"), ("m²", "m2"), ("①", "1"), ("½", "1/2"), ("a–b", "a-b"), ("a—b", "a–b"), ("a  b", "a b"), ("l", "I"), ("0", "O"), ("カ", "ガ"), ("x₂", "x2")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert looks.look_form(a) == looks.look_form(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_look(a, b):
    assert looks.look_form(a) != looks.look_form(b)


def test_form_is_stable():
    for a, _ in SAME + OTHER:
        assert looks.look_form(looks.look_form(a)) == looks.look_form(a)
        assert unicodedata.is_normalized("NFC", looks.look_form(a))


def test_pairs_against_brute_force(spark):
    texts = [a for pair in SAME + OTHER for a in pair] + [None, "", " ", "​", "x" * 20_000, "ｘ" * 20_000, "café", "ＡＢＣ１２"]
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, "ABC12", "e")], "unit_id long, text string, look string")
    got = {tuple(r) for r in looks.alike_pairs(df, "unit_id", "text").collect()}
    seen = [(i, t) for i, t, _ in rows if t is not None and looks.look_form(t).strip()]
    assert got == {(a, b) for a, s in seen for b, t in seen if a < b and s != t and looks.look_form(s) == looks.look_form(t)}
    forms = {r.unit: (r.text, r.canonical) for r in looks.with_canonical(df, "unit_id", "text").where("unit is not null").collect()}
    assert len(forms) == len(rows) and forms[texts.index("​")][1] == "​"
    by_look = {}
    for text, canonical in forms.values():
        if text is not None:
            by_look.setdefault(looks.look_form(text), set()).add(canonical)
    assert all(len(v) == 1 for k, v in by_look.items() if k.strip())
    assert looks.alike_pairs(df.limit(0), "unit_id", "text").count() == 0


def test_units_of_one_text_never_meet(spark):
    df = spark.createDataFrame([*((i, "ABC") for i in range(50)), (50, "ＡBC")], "unit_id long, text string")
    pairs = looks.alike_pairs(df, "unit_id", "text")
    on_class = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "class_key" in x]
    assert on_class and not any("unit" in x for x in on_class)
    assert sorted(map(tuple, pairs.collect())) == [(i, 50) for i in range(50)]


def test_candidates_come_from_the_collation(spark):
    df = spark.createDataFrame(list(enumerate(["ABC", "ＡBC", "é", "e\u0301", "É"])), "unit_id long, text string")
    forms, _ = looks.alike_members(df, "unit_id", "text")
    assert sorted((r.class_key, r.n_variants) for r in forms.collect()) == [("ABC", 2), ("ABC", 2), ("é", 2), ("é", 2)]
    # composed and decomposed letters are mapped to different characters: nothing but the collation brings them together
    forms = {r.text: r.m for r in df.select("text", looks.mapped(F.col("text")).alias("m")).collect()}
    assert forms["é"] == "é" != forms["e\u0301"] == "e\u0301" and forms["ＡBC"] == "ABC"


def test_collation_is_coarser_than_the_look(spark):
    """Whatever the look brings together is in one group of the collation, for every character and for mixed texts."""
    rng = random.Random(7)
    known = [chr(o) for o in looks.table()]
    letters = [chr(o) for o in range(0xA0, 0x2100) if unicodedata.decomposition(chr(o))] + ["각", "\u1100\u1161", "a\u0327\u0301", "a\u0301\u0327", "e\u0301\u200d\u0327"]
    texts = set(known + letters)
    for _ in range(3000):
        text = "".join(rng.choice(known if rng.random() < 0.4 else letters) if rng.random() < 0.5 else rng.choice("aeiouAE xyz-\n") for _ in range(rng.randrange(1, 7)))
        texts |= {text, unicodedata.normalize("NFD", text), unicodedata.normalize("NFC", text)}
    texts = {t for t in texts | {looks.look_form(t) for t in texts} if looks.look_form(t).strip()}
    df = spark.createDataFrame([(t, looks.look_form(t)) for t in texts], "text string, look string")
    keyed = df.withColumn("mapped", looks.mapped(F.col("text"))).withColumn("key", looks._collated("mapped"))
    keyed = keyed.withColumn("bare", looks.without_marks(F.col("mapped")))
    apart = keyed.groupBy("look", "key", "bare").agg(F.min("text").alias("text")).groupBy("look").agg(F.count(F.lit(1)).alias("n"), F.collect_list("text").alias("texts")).where("n > 1")
    assert [(r.look, [t.encode("unicode_escape") for t in r.texts]) for r in apart.collect()] == []
