"""quillstone: DataFrame operators for passage corpora (build, check, version, retrieve, rank)."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
