"""All queries of this folder: importing the modules registers them."""

from tastemill.llm import (  # noqa: F401
    chat, credentials, fingerprints, jaccard, language, neighbours, packing, periods, pieces_table, pii, resampling, shards, url_filter)
from tastemill.llm.registry import CHECKS, QUERIES  # noqa: F401
