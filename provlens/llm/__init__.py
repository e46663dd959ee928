"""Operators for preparing language-model training data.

Thirteen independent operators (one module each), the queries that apply them to
whole tables (``queries.py``), and the stages of ``corpus_pipeline.py``.
Nothing outside this folder imports it except ``__spark_entry__.py`` and
``corpus_pipeline.py``.

Conventions shared by all operators:

* the input columns an operator needs are named by parameters and read by
  name; any other input column is ignored (so a column that has the name of
  an output column does no harm) and only key and result columns come back;
* a null text is an empty text; an empty table gives an empty result with the
  same schema;
* a word is a maximal run of ``[^\\x20\\x09-\\x0D]``.
"""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value, so a cluster job
# needs no copy of the package on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
