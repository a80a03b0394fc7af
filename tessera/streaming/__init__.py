"""Structured Streaming forms of the funnel and of the incremental upsert."""

from tessera.streaming.stages import (run_available_now, start_continuous, stream_funnel,  # noqa: F401
                                      stream_upsert)
