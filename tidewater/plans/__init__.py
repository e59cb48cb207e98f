"""Named models (the reference's staging, intermediate, mart, report and
semantic layers) as DataFrame plans.  Importing this package registers them."""

from tidewater.plans import calendar, reports, saas, transit  # noqa: F401
from tidewater.plans.core import LAYERS, MODELS, Warehouse, model

__all__ = ["LAYERS", "MODELS", "Warehouse", "model"]
