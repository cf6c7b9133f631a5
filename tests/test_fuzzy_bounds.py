"""Name lookup: vectorised scores, bounds that never cut a match, share of pairs scored."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.operators import fuzzy

TEXT = st.text(alphabet="abcdeé 日😀", min_size=0, max_size=24)


@settings(max_examples=300, deadline=None)
@given(TEXT.filter(bool), st.lists(TEXT, min_size=1, max_size=6))
def test_scores_and_bounds(q, names):
    want = [fuzzy.partial_ratio(q, t) for t in names]
    assert fuzzy.partial_ratios(q, names).tolist() == want
    codes, lengths = fuzzy._codes(names)
    qc, ql = fuzzy._codes([q])
    alphabet = np.unique(qc)
    chars, pairs = fuzzy._counts(codes, lengths, alphabet)
    q_chars, q_pairs = fuzzy._counts(qc, ql, alphabet)
    bound = fuzzy.upper_bounds(chars, pairs, lengths, q_chars[0], q_pairs[0], len(q), 0.0)
    assert (bound >= np.array(want)).all()


def test_long_strings():
    rng = random.Random(1)
    q = "".join(rng.choice("abc") for _ in range(90))
    names = [q[3:80], q[:63], q[:64], q + "x", "".join(rng.choice("abc") for _ in range(200)), ""]
    assert fuzzy.partial_ratios(q, names).tolist() == [fuzzy.partial_ratio(q, t) for t in names]


def test_bounds_spare_most_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(2500)]
    asked = [n.replace("e", "a", 1)[:-1] or n for n in rng.sample(names, 30)] + ["", None]
    ndf = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(9_999, None)], "uuid long, name string").repartition(4)
    qdf = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = {r.query_id: r for r in fuzzy.fuzzy_best_match(ndf, qdf, report=True).collect()}
    assert sorted(got) == list(range(30))
    for i, r in got.items():
        best = max(fuzzy.partial_ratio(asked[i], n) for n in names)
        key = min(k for k, n in enumerate(names) if fuzzy.partial_ratio(asked[i], n) == best)
        assert (r.match_key, r.match_name, r.score) == (key, names[key], round(best, 6))
        assert r.n_names == len(set(names))
    assert sum(r.n_scored for r in got.values()) < 0.1 * sum(r.n_names for r in got.values())


def test_no_names_or_no_queries(spark):
    ndf = spark.createDataFrame([(1, "abc")], "uuid long, name string")
    qdf = spark.createDataFrame([(1, "abd")], "query_id long, text string")
    assert fuzzy.fuzzy_best_match(ndf.limit(0), qdf).count() == 0
    assert fuzzy.fuzzy_best_match(ndf, qdf.limit(0)).count() == 0
    assert fuzzy.fuzzy_best_match(ndf, qdf).first().match_key == 1
