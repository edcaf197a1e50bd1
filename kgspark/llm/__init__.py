"""Training-data operators: quality, safety, de-duplication, decontamination and mixing.

Nothing else in the library imports this subpackage. Its Python stages travel with the task, so executors
need the public packages only and not this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
