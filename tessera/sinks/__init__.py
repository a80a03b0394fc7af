"""Sinks: delimited files, datasets (staged overwrite), catalog tables, JDBC."""

from tessera.sinks.files import *  # noqa: F401,F403
from tessera.sinks.jdbc import write_jdbc  # noqa: F401
