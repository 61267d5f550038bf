"""Session helpers: building a session for local runs and locating shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

TABLES = ['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
          'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']


def local_session(cores: int | str = '*', shuffle_partitions: int = 8, app: str = 'logtriage',
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster use the cluster's session; nothing in the library depends on local mode.
    """
    b = (SparkSession.builder.master(f'local[{cores}]').appName(app)
         .config('spark.sql.shuffle.partitions', str(shuffle_partitions))
         .config('spark.sql.adaptive.enabled', 'true')
         .config('spark.sql.adaptive.coalescePartitions.enabled', 'true')
         .config('spark.sql.adaptive.skewJoin.enabled', 'true')
         .config('spark.sql.session.timeZone', 'UTC')
         .config('spark.sql.execution.arrow.pyspark.enabled', 'true')
         .config('spark.ui.enabled', 'false')
         .config('spark.driver.memory', os.environ.get('LOGTRIAGE_DRIVER_MEMORY', '8g')))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel('ERROR')
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder; we read it and never
    replace it.  A temporary folder is used only in local mode; elsewhere a missing setting
    is an error, because executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get('spark.checkpoint.dir', None) or sc.getConf().get('spark.checkpoint.dir', None)
    if not conf_dir:
        if not sc.master.startswith('local') or sc.master.startswith('local-cluster'):
            raise ValueError('spark.checkpoint.dir must name a folder that driver and executors share')
        conf_dir = tempfile.mkdtemp(prefix='logtriage-ckpt-')
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip('/')
    return f'{base}/{name}-{uuid.uuid4().hex[:12]}'


def written(df, name: str):
    """Write to the shared scratch folder and read back: one evaluation for several readers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f'{sf_dir.rstrip("/")}/{name}.parquet')
