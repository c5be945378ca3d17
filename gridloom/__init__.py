"""A Spark-native engine for tiled raster datasets.

Functions that run on executors are pickled by value, so a cluster needs no
copy of the package on its workers' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gridloom.functions.profiles import cog_profiles  # noqa: E402
from gridloom.plans.describe import get_data_offset, get_web_optimized_params, get_zooms, has_alpha_band, has_mask_band, non_alpha_indexes  # noqa: E402
from gridloom.plans.translate import cog_in_memory, cog_info, cog_translate, cog_validate, warped_source  # noqa: E402

__all__ = [
    "cog_in_memory", "cog_info", "cog_profiles", "cog_translate", "cog_validate", "warped_source",
    "get_data_offset", "get_web_optimized_params", "get_zooms", "has_alpha_band", "has_mask_band", "non_alpha_indexes",
]
