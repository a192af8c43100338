"""Registered queries; importing a module registers its queries."""

from . import contracts, curation, evaluation, experiments, files, indexing, lifecycle, monitoring, operations, pages, retrieval, review, sites, telemetry, validation  # noqa: F401
