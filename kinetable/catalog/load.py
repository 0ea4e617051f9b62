"""Imports every query module so that it registers its queries."""

from kinetable.catalog import (  # noqa: F401
    event_queries,
    feature_queries,
    incident_queries,
    ingest_queries,
    label_queries,
    review_queries,
    signal_queries,
    source_queries,
    stream_queries,
)
