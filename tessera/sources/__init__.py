"""Sources: delimited/fixed-width files, datasets, catalog tables, JDBC, generated rows."""

from tessera.sources.files import *  # noqa: F401,F403
from tessera.sources.jdbc import read_jdbc  # noqa: F401
