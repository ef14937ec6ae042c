import numpy as np
import pytest

from quirelake.llm import pii, pii_labels
from quirelake.llm.crf import RAW, Crf, Features, tokenize

GIVEN, FAMILY = ["Perrine", "Søren", "Will", "Rose", "Mark", "Jean-Corin", "Odette", "Bram"], ["Yllescas", "O'Kestrel", "Thornquist-Bell", "van der Mool", "Penhallick", "Farnwick"]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(GIVEN, FAMILY, rows=2500)


def keys(finder, text):
    return {(k, pii.letters_and_digits(text[a:b])) for a, b, k in finder.find([text])[0]}


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    crf = Crf(["O", "B-x", "I-x"], Features({}, ()), caution=0.0)
    texts = [" ".join(rng.choice(["ab", "Cd", "7", "EF"], rng.integers(3, 9))) for _ in range(60)]
    crf.fit([(tokenize(t)[0], rng.integers(0, 3, len(t.split())).tolist()) for t in texts], steps=15)
    scorer = crf.scorer()
    for text in texts:
        k, raws = tokenize(text)[0], RAW.findall(text)
        n = len(k)
        padded = ["\0"] * 6 + k + ["\0"] * 6
        scorer.label([raws])
        e = np.zeros((n, 3))
        for i in range(n):
            for o, off in enumerate(range(-6, 5)):
                e[i] += scorer.rows[scorer.number[padded[i + 6 + off]], o]
            s = [scorer.shapes[scorer.number[padded[i + 5]]], scorer.shapes[scorer.number[padded[i + 6]]]]
            e[i] += scorer.pair_scores[s[0] * scorer.size + s[1]]
        grid = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        score = e[np.arange(n), grid].sum(1) + crf.trans[grid[:, :-1], grid[:, 1:]].sum(1) + crf.trans[0, grid[:, 0]] + crf.trans[grid[:, -1], 0]
        assert grid[score.argmax()].tolist() == scorer.label([raws])[0].tolist()


def test_held_out_accuracy(finder):
    hit = proposed = wanted = 0
    for text, spans in pii_labels.labelled_rows(GIVEN, FAMILY, 900, seed=99)[300:]:
        got, want = keys(finder, text), {(k, pii.letters_and_digits(text[a:b])) for a, b, k in spans}
        hit, proposed, wanted = hit + len(got & want), proposed + len(got), wanted + len(want)
    assert hit / proposed > 0.95 and hit / wanted > 0.93


def accuracy(finder, rows, checked):
    """Recall and precision by kind, by the letters and digits of what is found in each text."""
    hit, proposed, wanted = {}, {}, {}
    texts = [t for t, _ in rows]
    found = finder.find(texts) if checked else finder.proposed(texts)
    for (text, spans), got in zip(rows, found):
        mine = {(k, pii.letters_and_digits(text[a:b])) for a, b, k in got}
        true = {(k, pii.letters_and_digits(text[a:b])) for a, b, k in spans}
        for table, keys_ in ((hit, mine & true), (proposed, mine), (wanted, true)):
            for k, _ in keys_:
                table[k] = table.get(k, 0) + 1
    return {k: (hit.get(k, 0) / wanted[k], hit.get(k, 0) / max(1, proposed.get(k, 0))) for k in pii.KINDS}


def test_held_out_sentences_places_and_streets():
    """Fitted without a third of the sentence patterns, places, products, teams and streets; measured on these alone."""
    finder = pii.Finder(GIVEN, FAMILY, rows=3000, held=1)
    rows = pii_labels.labelled_rows(GIVEN, FAMILY, 1500, seed=5, held=1, alone=True)
    model, whole = accuracy(finder, rows, False), accuracy(finder, rows, True)
    print({k: tuple(round(x, 3) for x in model[k] + whole[k]) for k in pii.KINDS})
    # the README has the figures of all three thirds; sentences without any known cue are what is missed
    assert all(whole[k][0] >= floor for k, floor in {"email": 0.95, "phone": 0.9, "id_number": 0.8, "address": 0.7, "name": 0.85}.items()), whole
    assert all(whole[k][0] >= model[k][0] - 0.02 for k in pii.KINDS)


def test_kinds_and_ends(finder):
    text = "Owner: Perrine Yllescas\nTel. +44 (0)20 7946 0464\nHome address: 376 N. LANTERN BLVD\nKestrel Point, 17262\n\nContact : will.farnwick [at] corrow [dot] example\nSSN 989-48-1811 was typed into B12."
    assert keys(finder, text) == {("name", "perrineyllescas"), ("phone", "4402079460464"), ("address", "376nlanternblvd"), ("email", "willfarnwickatcorrowdotexample"), ("id_number", "989481811")}
    assert ("phone", "12025550164") in keys(finder, "Desk line +1-202-555-0164, ext. 21")
    assert ("name", "sørenokestrel") in keys(finder, "Signed, Søren O'Kestrel")


def test_decoys(finder):
    for text in ("The Farnwick warehouse keeps its own stock sheet.", "Mark cell U375 as final and rename the tab.", "Will the grace period cover Corrow?", "Install tooling@2.48.0 and rerun the export.", "Part no. 900-14-7881 replaces 900-13-2002.", "Rows 555-8192 hold the archive.", "", "\n\n", "x" * 5000):
        assert keys(finder, text) == set(), text


def test_rows_and_redaction(spark, finder):
    long = "Nothing in Checks depends on R121 any more. " * 3000 + "\nOwner: Perrine Yllescas\n"
    df = spark.createDataFrame([(1, "Owner: Perrine Yllescas\nCall 020 7946 0805 after the close."), (2, None), (3, ""), (4, long), (4, long)], "doc_id long, text string")
    found = pii.find_pii(df, "doc_id", "text", finder)
    assert sorted((r.doc_id, r.pii_kind, r.pii_key) for r in found.select("doc_id", "pii_kind", "pii_key").distinct().collect()) == [(1, "name", "perrineyllescas"), (1, "phone", "02079460805"), (4, "name", "perrineyllescas")]
    redacted = {r.doc_id: r.redacted for r in pii.redact(df, "doc_id", "text", finder).collect()}
    assert redacted[1] == "Owner: <NAME>\nCall <PHONE> after the close." and redacted[2] is None and redacted[3] == "" and redacted[4] == long.replace("Perrine Yllescas", "<NAME>")
    assert pii.find_pii(df.limit(0), "doc_id", "text", finder).count() == 0
