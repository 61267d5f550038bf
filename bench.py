"""Benchmark the headline queries.

Runs each query fully (``noop`` sink: every row is computed, nothing is collected) on
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints
one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logtriage.plans.registry import all_queries  # noqa: E402
from logtriage.session import local_session  # noqa: E402

HEADLINE = ['c4_label_distribution', 'b5_label_logs', 'c1_preprocess_logs', 'c9_stratified_split',
            'd5_fit_vocabulary', 'd6_tfidf_transform', 'f7_roc_curve', 'f11_evaluate_flat',
            'g7_scoreboard_ml', 'e2_boosted_trees_plain', 'e3_adaboost']


def main():
    sf_dir = os.environ.get('BENCH_SF_DIR', '/root/testdata/sf0.1')
    cpus = os.environ.get('BENCH_CPUS', '8')
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app='logtriage-bench')
    qs = all_queries()
    times = {}
    for name in names:
        fn, _ = qs[name]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format('noop').mode('overwrite').save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rstrip('/').rsplit('sf', 1)[-1]
    print(json.dumps({'metric': 'headline_queries_total_seconds', 'value': round(sum(times.values()), 3),
                      'unit': 'sec', 'queries': times, 'sf': float(sf) if sf.replace('.', '').isdigit() else sf}))
    spark.stop()


if __name__ == '__main__':
    main()
