"""weir: Spark-native operators for streams, traces, metric archives and live snapshots."""

import os

# One thread to a Python worker: Spark's tasks are the parallelism.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
