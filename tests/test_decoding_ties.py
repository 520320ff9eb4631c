"""Paths of equal scores."""

import duckdb
import numpy as np

from wordloom.operators.decoding import viterbi
from wordloom.plans import oracles


def test_rounding_decides_no_tie():
    # 0.3 + 0.2 + 0.1 rounds to less than 0.1 + 0.2 + 0.3: the first path is as good.
    logp = np.zeros((3, 1))
    arcs = np.array([[0, 1, 0, 1, 0.3], [0, 2, 0, 2, 0.1], [1, 3, 0, 3, 0.2], [2, 4, 0, 4, 0.2], [3, 5, 0, 5, 0.1], [4, 5, 0, 6, 0.3], [5, 6, -1, -1, 0.0]], float)
    assert 0.3 + 0.2 + 0.1 < 0.1 + 0.2 + 0.3
    assert viterbi(logp, arcs)[0] == [0, 2, 4]


def test_a_last_word_of_the_letter_before_it_is_found():
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, 'thedthea a' AS text")
    tokens = con.execute(f"WITH {oracles._BT} SELECT c, id, f FROM bt ORDER BY c").fetchall()
    arcs = np.array(con.execute(f"WITH {oracles._BT}, x AS ({oracles._arcs(oracles._FACTOR)}) SELECT src, dst, label, aux, score FROM x ORDER BY ALL").fetchall(), float)
    logp = np.full((3 * len(tokens), 32), -6.0)
    for c, label, _ in tokens:
        logp[3 * c : 3 * c + 2, label] = logp[3 * c + 2, 0] = -0.05
    path, _ = viterbi(logp, arcs)
    aux = arcs[path, 3]
    # The last symbol ends the path; the others open their tokens at their frames.
    assert [(int(f), int(aux[f])) for f in np.flatnonzero(aux)][:-1] == [(3 * c, c + 1) for c, _, _ in tokens]
