"""Fingerprints of texts on the two sides of a limit of length."""

import numpy as np
import pytest

from sparkloom.llm import syncmers

TEXT = "the river runs past an old mill, two low barns and one long field of barley before it turns to the sea again" * 3


def marks(text):
    return syncmers.read(syncmers.written(syncmers.sketch(syncmers.points_of(text))))


@pytest.mark.parametrize("n", [15, 63])
def test_nearly_equal_texts_across_a_limit(n):
    assert syncmers.likeness(marks(TEXT[:n]), marks(TEXT[: n + 1])) > 0.85
    assert syncmers.likeness(marks(TEXT[: n + 1]), marks(TEXT[:n])) > 0.85
    assert syncmers.likeness(marks(TEXT[:n]), marks("0123456789" * 6 + "9876")) == 0


@pytest.mark.parametrize("n", [16, 19, 22, 64, 80, 94])
def test_an_edit_that_shortens_a_text_over_a_limit(spark, n):
    docs = spark.createDataFrame([(2, TEXT[:n]), (1, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["near_edited"] for r in syncmers.edited_likeness(docs).collect()}
    assert got[2] > 0.6


@pytest.mark.parametrize(("short", "long"), [(63, 256), (15, 64), (60, 330), (10, 250), (63, 2000)])
def test_likeness_falls_evenly_across_limits(short, long):
    """A text and its continuation share the anchors of the shorter one; random letters, so that few k-mers repeat."""
    text = "".join(np.random.default_rng(9).choice(list("abcdefghijklmnopqrstuvwxyz"), 2100))
    got, before = (syncmers.likeness(marks(text[:short]), marks(text[:n])) for n in (long, long - 1))
    assert abs(got - before) < 0.06 and abs(got - 2 * short / (short + long)) < 0.12


@pytest.mark.parametrize("n", [1, 5, 16, 40, 64, 65, 100, 300, 3000, 200_000])
@pytest.mark.parametrize("m", [0, 1, 14, 60, 5000])
def test_anchors_of_an_edited_text_are_those_of_its_own_pass(n, m):
    letters = np.random.default_rng(n + m).choice(list("ab \u00e9\U0001F600"), n + m + 10)
    a, b = "".join(letters[:n]), "".join(letters[n : n + m])
    own, edited = syncmers.pair_sketches([syncmers.Text(a), syncmers.Text(b), syncmers.Text(a)], syncmers.SIZE)
    for got, text in ((own[0], a), (own[1], b), (edited[0], syncmers.edited_text(a, b)), (edited[1], syncmers.edited_text(b, a))):
        assert syncmers.written(got) == syncmers.written(syncmers.sketch(syncmers.points_of(text)))


def test_likeness_is_the_shared_share_of_anchors():
    """Against all anchors counted in plain Python, on texts of few anchors, where the fingerprint holds them all."""
    rng = np.random.default_rng(2)
    k, s = syncmers.LEVELS[0][1:]
    plain = lambda t: {t[i : i + k] for i in range(len(t) - k + 1) if (v := [int(syncmers.windows(syncmers.points_of(t[i + j : i + j + s]), s)[0]) for j in range(k - s + 1)]) and min(v) in (v[0], v[-1])}
    for n in (200, 300, 400):
        a, b = ("".join(rng.choice(list("abcdefghijklmnop "), n)) for _ in range(2))
        edited = syncmers.edited_text(a, b)
        x, y = plain(a), plain(edited)
        assert abs(syncmers.likeness(marks(a), marks(edited)) - 2 * len(x & y) / (len(x) + len(y))) < 1e-9


def test_equal_texts_are_alike_and_have_the_levels_of_their_length():
    for n in (1, 2, 15, 16, 63, 64, 255, 256, 300):
        found = marks(TEXT[:n])
        assert syncmers.likeness(found, found) == 1.0
        assert len(np.unique(np.searchsorted(syncmers.MARKS, found[1], side="right"))) == len(syncmers.levels_of(n)) == 1 + (16 <= n) + (n >= 64)
