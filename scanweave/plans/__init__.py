"""All queries of the engine and their DuckDB counterparts."""

from scanweave.plans import catalog_queries, codec_queries, exr_queries, pixel_queries  # noqa: F401
from scanweave.plans.registry import QUERIES, SQL
