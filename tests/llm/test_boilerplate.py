"""Problem 1: the fitted classifier finds frames that no phrase list names."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import boilerplate, linemodel
from corpusloom.llm.page import phrase_kind

NOUNS = "contract budget market project survey report team branch delivery claim lease premium portfolio account warehouse".split()
VERBS = "funds delays covers protects changes limits supports improves controls exceeds".split()

#: Lines of frames that meet no listed phrase.
UNLISTED = ["Skip to main content", "Toggle navigation", "You might also like", "Terms of service | Privacy policy | Cookie settings", "Leave a comment", "Page {n} of 9", "Sponsored", "Next article", "Jump to top of the page", "Powered by Nobody"]
LISTED = ["Home", "Contact", "We use cookies to improve your visit.", "Back to top", "© 2020 Somebody. All rights reserved.", "Print", "Sign in", "Legal notice"]


def sentence(rng):
    pick = lambda: f"the {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)}"
    return f"{pick().capitalize()}, because {pick()} and {pick()}."


def page(rng, frame):
    head = f"The {rng.choice(NOUNS)} of {rng.choice(NOUNS)} and {rng.choice(NOUNS)} in year {rng.randint(1, 9_999)}"
    body = [f"# {head}", *(sentence(rng) + " " + sentence(rng) for _ in range(rng.randint(3, 8)))]
    frame = [x.format(n=rng.randint(1, 9)) for x in frame]
    half = len(frame) // 2
    top, bottom = frame[:half], frame[half:]
    return "\n".join([*top, *body, *bottom]), [*range(1, half + 1), *range(half + len(body) + 1, half + len(body) + len(bottom) + 1)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows, want = [], set()
    for site in range(6):
        for k in range(40):
            key = site * 100 + k
            text, lines = page(rng, UNLISTED if site == 5 else LISTED)
            rows.append((key, text, None, f"site{site}"))
            want |= {(key, n) for n in lines}
    return rows, want


def test_unlisted_lines_meet_no_phrase():
    assert [x for x in UNLISTED if phrase_kind(x) is not None] == []


def test_frames_without_a_listed_phrase_are_found(spark, corpus):
    rows, want = corpus
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, title string, source string")
    got = {tuple(r) for r in boilerplate.frame_lines(docs).collect()}
    held = {(d, n) for d, n in want if d >= 500}
    assert len(got & held) >= 0.9 * len(held)
    assert len(got & want) >= 0.97 * len(got)
    texts = {r.doc_id: r.main_text for r in boilerplate.main_text(docs).collect()}
    assert len(texts) == len(rows) and all("# The" in t for t in texts.values())


def test_a_hot_line_and_dirty_rows(spark):
    rng = random.Random(2)
    rows = [(i, f"Home\n{sentence(rng)} {sentence(rng)}", None, "one") for i in range(200)]
    rows += [(None, None, None, None), (777, "", None, None), (8, "  \n\n", "t", ""), (999, "Home", None, None), (999, "Home", None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, title string, source string, site int, bits int")
    got = [tuple(r) for r in boilerplate.frame_lines(docs).collect()]
    assert got.count((999, 1)) == 2 and {(i, 1) for i in range(200)} <= set(got) and not [x for x in got if x[1] == 2]
    assert boilerplate.frame_lines(docs.limit(0)).count() == 0 and boilerplate.main_text(docs.limit(0)).count() == 0
    assert {r.main_text for r in boilerplate.main_text(docs).where("doc_id = 777").collect()} == {""}


def test_fit_without_examples_says_nothing():
    assert not linemodel.fit(np.array([], np.int64), np.array([], np.int64)).any()
    assert not linemodel.fit(np.array([1 << 11], np.int64), np.array([5], np.int64)).any()
