"""Imports every catalogue module so that all queries are registered."""
from . import catalog_query  # noqa: F401
from . import catalog_profile  # noqa: F401
from . import catalog_segment  # noqa: F401
from . import catalog_cluster  # noqa: F401
from . import catalog_io  # noqa: F401
from . import catalog_prepare  # noqa: F401
