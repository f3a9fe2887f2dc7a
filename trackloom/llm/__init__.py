"""Operators that prepare text corpora for language-model training.

What their tasks run travels with the job, so executors need no copy of this
package, only the libraries it uses.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
