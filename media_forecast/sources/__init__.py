from .schema import RATIO_COLUMNS, UNIFIED_COLUMNS, UNIFIED_SCHEMA  # noqa: F401
from .sinks import read_unified, write_unified  # noqa: F401
from .vendors import (  # noqa: F401
    bing_to_unified,
    conform,
    google_to_unified,
    load_bing,
    load_channels,
    load_google,
    load_meta,
    meta_to_unified,
    read_export_csv,
)
