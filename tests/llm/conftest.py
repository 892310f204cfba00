"""One BLAS thread: the small matrices here are slower with more. Helpers beside the tests are importable."""

import os
import sys

for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(name, "1")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
