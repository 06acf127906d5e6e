"""Training-data operators: decontamination, packing, quality rules, line and
document deduplication, token counts, WARC derivatives, PPM scoring, language
identification, chat formatting, source divergence, periodic runs and token files.

Nothing outside this subpackage imports it.  Python functions that run on the
executors are pickled by value, so a cluster needs no copy of the package.
"""

from pyspark import cloudpickle

import lexigrain.llm as _self

cloudpickle.register_pickle_by_value(_self)
