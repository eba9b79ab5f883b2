"""Every operator as a query over the driver tables."""

from byline.plans.catalog import (batches, evidence, linking, pages, reporting, rosters, texts)  # noqa: F401
from byline.plans.catalog.registry import QUERIES, SQL  # noqa: F401
