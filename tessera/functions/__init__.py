"""Scalar function library (job-language built-ins as native Columns)."""

from tessera.functions import basic, rules  # noqa: F401
from tessera.functions.basic import *  # noqa: F401,F403
