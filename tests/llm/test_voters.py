"""Which terms vote: those that clean rows share must add to purer ones."""

import numpy as np

from lattica.llm import toxicity


def rows_of(*groups):
    """(rows, labels) from (terms, label, how often)."""
    rows, labels = [], []
    for terms, label, n in groups:
        rows += [np.array(sorted(terms), np.int64)] * n
        labels += [label] * n
    return rows, np.array(labels)


def kept(voters, times, *groups):
    return list(toxicity._adding(np.array(voters), np.array(times), *rows_of(*groups)))


def test_a_start_that_adds_nothing_goes():
    # 1 begins the insult 0 and a harmless word; it never stands without 0 in toxic rows.
    assert kept([0, 1], [50, 50], ((0, 1), 1, 400), ((1,), 0, 20), ((), 0, 3000)) == [0]


def test_a_voter_that_adds_stays():
    groups = ((0, 1), 1, 200), ((1,), 1, 200), ((1,), 0, 4), ((), 0, 3000)
    assert kept([0, 1], [50, 50], *groups) == [0, 1]
    assert kept([0, 1], [50, 2000], *groups) == [0]


def test_stray_labels_drop_no_voter():
    assert kept([0, 1], [50, 50], ((0, 1), 1, 10), ((0,), 0, 1), ((), 0, 500)) == [0, 1]
    assert kept([0, 1], [50, 50], ((0, 1), 1, 10), ((1,), 0, 3), ((), 0, 3000)) == [0, 1]


def test_no_voters_and_one_label():
    assert kept([], [], ((0,), 1, 2)) == []
    assert kept([0], [5], ((0,), 1, 2)) == [0]
    assert kept([0], [5], ((0,), 0, 9)) == []


def test_clean_words_with_an_insults_start_are_clean():
    # ``lose*`` begins an insult and a harmless word of another language.
    examples = [(b"lose*\tloser\tw%d" % (k % 40), 1) for k in range(300)]
    examples += [(b"lose*\tloses\tloses*\tw%d" % (k % 40), 0) for k in range(8)] + [(b"w%d\tv%d" % (k % 40, k % 90), 0) for k in range(2000)]
    bias, weights = toxicity.train(examples)
    score = lambda terms: bias + sum(weights.get(t, 0.0) for t in terms.split(b"\t"))
    assert score(b"lose*\tloser\tw1") > 0 > score(b"lose*\tloses\tloses*\tw1")
