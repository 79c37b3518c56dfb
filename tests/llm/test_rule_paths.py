import numpy as np

from tidewater.llm import quality_classifier as Q


def test_rules_of_the_last_trees_reach_the_lasso(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((3000, len(Q.FEATURES)))
    y = ((x[:, 0] * x[:, 1] + x[:, 2] * x[:, 3] + 0.3 * rng.random(3000)) > 0.65).astype(float)
    grown, covers = [], set()
    grow = Q._grow

    def noted(*args):
        grow(*args)
        if not args[8]:
            grown.append(list(args[9]))

    monkeypatch.setattr(Q, "_grow", noted)
    model = Q.fit_rules(x, y, penalty=0.0)
    for path in grown[-1]:
        c = Q.Rule(Q._simplest(path)).holds(x)
        if 0 < c.sum() < len(y):
            covers.add(c.tobytes())
    assert len(covers) > 240 and len(model.rules) >= 0.95 * len(covers)
