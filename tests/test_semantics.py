"""Verdict expressions vs an independent numpy rendering of the vote rules."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from flowscore.operators import scoring as S
from flowscore.sources import bundle as B

PROBS = st.sampled_from([0.0, 0.1, 0.3, 0.5, 0.50000001, 0.6, 0.7, 0.85, 1.0])


def _numpy_verdicts(P, C, weights, t, dis):
    votes = (P > 0.5).astype(float)  # argmax tie goes to class 0
    vd = np.zeros(len(P))
    for k, w in enumerate(weights):
        vd += votes[:, k] * w
    binary = (vd >= t).astype(int)
    mean, std = C.mean(axis=1), C.std(axis=1)  # population std
    l3 = np.where(std >= dis, 1, np.where(mean >= 0.5, 2, 0))
    dfdm = (votes.sum(axis=1) > 0).astype(int)
    return binary, l3, dfdm


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(PROBS, PROBS, PROBS, PROBS, PROBS, PROBS, PROBS, PROBS), min_size=1, max_size=30))
def test_votes_match_numpy(spark, rows):
    p = np.array([r[:4] for r in rows], dtype=float)
    c = np.array([r[4:] for r in rows], dtype=float)
    members = tuple(B.Member(f"m{k}", expr=f"p{k}", calibrated_expr=f"c{k}") for k in range(4))
    w = {"m0": 1.0, "m1": 1.0, "m2": 1.5, "m3": 1.0}
    feats = tuple(f"p{k}" for k in range(4)) + tuple(f"c{k}" for k in range(4))
    fdm = B.Voter("FDM", ("m0", "m1", "m2", "m3"), feats, w, 2.25, 0.3)
    bundle = B.EnsembleBundle(members=members, fdm=fdm, ham=fdm, label_col=None)
    pdf = pd.DataFrame({"i": range(len(rows)), "f": 0.0, **{f"p{k}": p[:, k] for k in range(4)},
                        **{f"c{k}": c[:, k] for k in range(4)}})
    v = S.verdicts(spark.createDataFrame(pdf), bundle, modes=("FDM", "DFDM")).orderBy("i").collect()
    binary, l3, dfdm = _numpy_verdicts(p, c, [1.0, 1.0, 1.5, 1.0], 2.25, 0.3)
    assert [r["_bin_FDM"] for r in v] == binary.tolist()
    assert [r["_bin_DFDM"] for r in v] == dfdm.tolist()
    got_l3 = [r["_l3_FDM"] for r in v]
    # std computed in a different summation order may straddle the threshold only at exact ties
    for g, e, s in zip(got_l3, l3.tolist(), c.std(axis=1)):
        assert g == e or abs(s - 0.3) < 1e-12
