"""Model queries run the presets and grids of SURVEY, not smaller ones."""

import math

from logtriage.models import boosting as B
from logtriage.plans import queries_models as Q


def test_registered_presets(monkeypatch):
    calls = []

    def noted(name):
        return lambda *args, **options: calls.append((name, args, options)) or (None, None)

    monkeypatch.setattr(Q, '_lines', lambda spark, sf: (None, None))
    for name in ('_judged', '_stats'):
        monkeypatch.setattr(Q, name, lambda *args: None)
    for name in ('fit_boosted', 'fit_adaboost', 'grid_search'):
        monkeypatch.setattr(Q.B, name, noted(name))

    def run(query):
        calls.clear()
        Q.QUERIES[query][0](None, None)
        return calls[0][1][2:], calls[0][2]

    assert run('e1_boosted_trees_regularised') == (('xgb',), {})
    assert run('e1_boosted_trees_benchmark') == (('xgb_benchmark',), {})
    assert run('e2_boosted_trees_plain') == run('e6_evaluate_model_on') == (('gb_benchmark',), {})
    assert run('e2_boosted_trees_library') == (('gb',), {'keys': Q._KEYS})
    assert run('e3_adaboost') == (('ada_benchmark',), {}) and run('e4_adaboost_real') == (('ada',), {})
    for query, points in (('e9_grid_search', 27), ('e9_grid_search_adaboost', 12)):
        more, options = run(query)
        assert math.prod(map(len, more[1].values())) == points and options == {'k': 3}


def test_preset_values():
    p = B.PRESETS
    assert [(p[k].rounds, p[k].depth, p[k].rate, p[k].subsample) for k in ('xgb', 'xgb_benchmark', 'gb', 'gb_benchmark')] == [
        (100, 6, 0.1, 0.8), (200, 4, 0.05, 0.9), (100, 6, 0.1, 0.8), (20, 1, 0.8, 0.3)]
    assert (p['xgb_benchmark'].reg_alpha, p['xgb_benchmark'].reg_lambda, p['xgb_benchmark'].gamma, p['xgb_benchmark'].min_hessian) == (0.05, 1.0, 0.01, 1.0)
    assert (p['gb'].patience, B.VALIDATION['gb'], p['gb_benchmark'].min_split, p['gb_benchmark'].min_rows) == (10, 0.1, 50, 30)
    assert (p['ada'].kind, p['ada'].rounds, p['ada'].rate, p['ada'].depth) == ('samme.r', 100, 0.1, 3)
    assert (p['ada_benchmark'].kind, p['ada_benchmark'].rounds, p['ada_benchmark'].rate, p['ada_benchmark'].depth) == ('samme', 25, 2.0, 1)
