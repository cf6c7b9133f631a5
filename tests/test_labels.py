"""Label arrays through the cut, and markers as whole tokens."""

import pytest

from lexiforge.operators import corpus
from lexiforge.plans import queries as Q
from lexiforge.schemas import MARKERS
from tests.conftest import SF


@pytest.mark.parametrize("max_len", [0, 1, 5, 9, 14, 200])
def test_labels_follow_their_tokens(spark, max_len):
    rows = [(1, 0, "user", "what is it"), (1, 1, "assistant", "a red fox"), (1, 2, "assistant", None),
            (2, 0, "system", "only system"), (3, 0, "assistant", ""), (1, 1, "assistant", "a red fox")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in corpus.labelled_tokens(df, 10_000).collect()}
    for r in corpus.labelled_tokens(df, max_len).collect():
        w = whole[r.conv_id]
        assert len(r.tokens) == len(r.labels) == min(max_len, len(w.tokens))
        assert r.tokens == w.tokens[:max_len] and r.labels == w.labels[:max_len]
    one = whole[1]
    trained = [t for t, y in zip(one.tokens, one.labels) if y == 1]
    assert trained == ["a", "red", "fox", "<|eot_id|>"] * 2 + ["<|eot_id|>"]
    assert set(one.labels) == {1, corpus.IGNORE_INDEX} and set(whole[2].labels) == {corpus.IGNORE_INDEX}
    assert corpus.labelled_tokens(df.limit(0), 5).count() == 0


def test_markers_stay_whole(spark):
    for r in Q.q_marker_tokens(spark, SF).collect():
        assert r.n_markers == 1 and MARKERS[r.turn % len(MARKERS)] in r.tokens
