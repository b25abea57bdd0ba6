"""The nearest vectors of a block of queries, with bounded memory."""

import tracemalloc

import numpy as np

from paperloom.operators import retrieval


def test_scores_of_a_batch_are_made_in_pieces():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(5000, 16))
    vectors[1234] = vectors[77]  # a tie goes to the lesser id
    ids, queries = np.arange(0, 5000, 10), retrieval._unit(vectors[::10])
    tracemalloc.start()
    got_id, got = retrieval.nearest([(np.arange(5000), list(vectors))], ids, queries, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    scores = np.round(queries @ retrieval._unit(vectors).T, 9)
    scores[np.arange(500), ids] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(5000), scores.shape), -scores), axis=1)[:, :4]
    assert (got_id == want).all() and (got == np.take_along_axis(scores, want, 1)).all()
    assert peak < 16e6  # one array of all scores is 20 MB
