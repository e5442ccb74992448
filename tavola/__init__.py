"""tavola: Spark-native item/entity analytics, scoring and monitoring operators.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, MLlib pipelines or Structured Streaming, and is
parameterised by column names so it applies to any item/entity table.
"""

__version__ = "0.1.0"

import os

# Spark runs one Python process per core: more BLAS threads only compete for it, and
# a pool of them can stop for good when its process forks (as starting a session does).
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
