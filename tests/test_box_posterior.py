"""The posterior over the whole prior box against a fine reference grid."""

import numpy as np
import pytest

from loamline.operators import fitting


def observations(seed, n, alpha, shape, residual, noise):
    draw = np.random.default_rng(seed)
    h = np.exp(draw.uniform(np.log(5), np.log(20000), n))
    theta = residual + (0.44 - residual) * (1 + (alpha * h) ** shape) ** (1 / shape - 1) + draw.normal(0, noise, n)
    return h, theta


def reference(h, theta, box, m=72):
    """Marginal means, sds and quantiles on a fine grid over a box given by the caller."""
    def middles(low, high, log):
        edges = np.exp(np.linspace(np.log(low), np.log(high), m + 1)) if log else np.linspace(low, high, m + 1)
        return (np.sqrt(edges[1:] * edges[:-1]) if log else (edges[1:] + edges[:-1]) / 2), np.diff(edges)

    (a, da), (n, dn), (r, dr), (s, ds) = (middles(*box[k], log) for k, log in
                                          (("alpha_cm", True), ("n", False), ("theta_r", False), ("sigma", True)))
    S = (1 + (a[:, None, None] * h) ** n[None, :, None]) ** (1 / n[None, :, None] - 1)
    rest, open_ = theta - 0.44 * S, 1 - S
    rr, ro, oo = (rest**2).sum(-1), (rest * open_).sum(-1), (open_**2).sum(-1)
    sse = rr[..., None] - 2 * ro[..., None] * r + oo[..., None] * r**2
    log = -len(h) * np.log(s) - sse[..., None] / (2 * s**2)
    w = np.exp(log - log.max()) * da[:, None, None, None] * dn[:, None, None] * dr[:, None] * ds
    w /= w.sum()
    out = {}
    for k, (name, x) in enumerate((("alpha_cm", a), ("n", n), ("theta_r", r), ("sigma", s))):
        mass = w.sum(axis=tuple(i for i in range(4) if i != k))
        mean = (mass * x).sum()
        out[name] = (mean, np.sqrt((mass * x * x).sum() - mean**2))
    return out


@pytest.mark.parametrize("truth, rounds", [((0.08, 1.6, 0.03, 0.01), None), ((0.4, 0.9, 0.03, 0.02), 5)])
def test_marginals_equal_a_fine_grid(spark, truth, rounds):
    h, theta = observations(3, 60, *truth)
    obs = spark.createDataFrame([("g", float(t), float(x)) for t, x in zip(theta, h)], "grp string, theta double, h_cm double")
    found = fitting.box_posterior(obs, rounds=rounds)
    marginals = fitting.box_marginals(found)
    box = {p: (1e9, -1e9) for p in fitting.PRIOR_CELLS}
    for r in marginals.collect():
        box[r.parameter] = (min(box[r.parameter][0], r.low), max(box[r.parameter][1], r.high))
    for name, axis in fitting.PRIOR_CELLS.items():
        assert axis.bounds[0] <= box[name][0] < box[name][1] <= axis.bounds[1] * (1 + 1e-12)
    want = reference(h, theta, box)
    got = {r.parameter: r for r in fitting.box_summary(marginals, {"low": 0.025, "mid": 0.5, "high": 0.975}).collect()}
    for name, (mean, sd) in want.items():
        assert abs(got[name].estimate - mean) < 1e-3 * max(1, abs(mean)) and abs(got[name].estimate - mean) < 0.05 * sd
        assert abs(got[name].std_error - sd) < 0.05 * sd
        assert got[name].low < got[name].mid < got[name].high
    state = fitting.box_state(marginals).collect()
    assert rounds or all(r.coarsest <= 0.3 and r.edge < 1e-5 for r in state)


def test_groups_have_boxes_of_their_own(spark):
    rows = []
    for name, truth in (("a", (0.08, 1.6, 0.03, 0.01)), (None, (0.1, 2.0, 0.04, 0.01))):
        rows += [(name, float(t), float(x)) for x, t in zip(*observations(5, 80, *truth))]
    obs = spark.createDataFrame([*rows, ("a", None, 5.0), ("a", 0.2, -1.0)], "grp string, theta double, h_cm double")
    got = fitting.box_summary(fitting.box_marginals(fitting.box_posterior(obs, rounds=5)), {"mid": 0.5}).collect()
    middle = {(r.grp, r.parameter): r.mid for r in got}
    assert len(middle) == 8
    for name, shape, noise in (("a", 1.6, 0.01), (None, 2.0, 0.01)):
        assert abs(middle[name, "n"] - shape) < 0.1 and abs(middle[name, "sigma"] / noise - 1) < 0.2


def test_unresolved_posterior_fails(spark):
    h, theta = observations(3, 50, 0.08, 1.6, 0.03, 0.01)
    obs = spark.createDataFrame([("g", float(t), float(x)) for t, x in zip(theta, h)], "grp string, theta double, h_cm double")
    with pytest.raises(ValueError, match="not resolved"):
        fitting.box_posterior(obs, most_rounds=1)
