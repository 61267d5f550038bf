"""Connected components by alternating star contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable over ``edges`` (a, b).

    Each round points the larger neighbours of every node at its least neighbour ("large
    star"), then the smaller ones ("small star"); the number of rounds grows with the
    logarithm of the longest path.  Rounds are written to the shared folder, which cuts the
    lineage.  Nodes without edges are not returned.
    """
    e = written(edges.filter('a <> b').select(F.greatest('a', 'b').alias('u'), F.least('a', 'b').alias('v')).distinct(), 'edges')
    state = None
    while True:
        both = e.unionByName(e.select(F.col('v').alias('u'), F.col('u').alias('v')))
        least = both.groupBy('u').agg(F.min('v').alias('m')).select('u', F.least('u', 'm').alias('m'))
        large = both.join(least, 'u').filter('v > u').select(F.col('v').alias('u'), F.col('m').alias('v')).distinct()
        least = large.groupBy('u').agg(F.min('v').alias('m'))
        small = large.join(least, 'u')
        small = small.filter('v <> m').select(F.col('v').alias('u'), F.col('m').alias('v')).unionByName(least.withColumnRenamed('m', 'v'))
        e = written(small.distinct(), 'edges')
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64('u', 'v').cast('decimal(38,0)'))).first()
        if now == state:
            break
        state = now
    return e.select(F.col('u').alias('node'), F.col('v').alias('root')).unionByName(
        e.select(F.col('v').alias('node'), F.col('v').alias('root')).distinct())
