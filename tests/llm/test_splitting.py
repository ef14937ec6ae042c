from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import splitting

TEXT = st.text(alphabet="ab .\n\r,;éé́漢。👩‍💼|#", max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(-1, 70))
def test_pieces_cover_and_fit(text, limit, overlap):
    cuts = splitting.cut_points(text, limit, overlap)
    shared = min(max(overlap, 0), limit - 1)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= limit for a, b in cuts)
    assert all(nxt[0] == cut[1] - shared and nxt[1] > cut[1] for cut, nxt in zip(cuts, cuts[1:]))
    assert (len(cuts) > 1) == (len(text) > limit)


def test_cuts_prefer_strong_boundaries():
    text = "One sentence here. Another one there.\n\nA new paragraph starts. It goes on and on."
    (_, end), _ = splitting.cut_points(text, 60, 0)
    assert text[:end].endswith("\n\n")
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    assert all(words[b - 1] == " " for _, b in splitting.cut_points(words, 20, 0)[:-1])


def test_line_ends_and_joined_emoji_stay_whole():
    cuts = splitting.cut_points("ab\r\n" * 50, 21, 0)
    assert all(("ab\r\n" * 50)[b - 1 : b + 1] != "\r\n" for _, b in cuts[:-1])
    text = "👩‍💼" * 40
    assert all(text[b - 1] != "‍" and text[b] != "‍" for _, b in splitting.cut_points(text, 20, 0)[:-1])


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "x" * 30, 2, 0, "p"), (2, "short", 2, None, "p"), (3, None, 2, 0, "p"), (4, "", 0, 5, "p"), (5, "y" * 9000, None, -3, "p"), (6, "abc", 0, 0, None)], "access_id long, content string, max_tokens int, overlap_tokens int, piece string")
    got = {}
    for r in splitting.split_oversized(df, "access_id", "content", "max_tokens", "overlap_tokens").collect():
        got.setdefault(r.access_id, []).append((r.piece_no, r.n_pieces, r.piece, r.over_limit))
    assert {k: len(v) for k, v in got.items()} == {1: 4, 2: 1, 4: 1, 5: 2, 6: 3}
    assert "".join(p for _, _, p, _ in sorted(got[1])) == "x" * 30
    assert [o for *_, o in got[2]] == [False] and all(o for *_, o in got[6])
    assert splitting.split_oversized(df.limit(0), "access_id", "content", "max_tokens", "overlap_tokens").count() == 0
