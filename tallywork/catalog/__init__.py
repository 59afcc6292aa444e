"""Named queries over the benchmark tables, each with its check query."""

from . import accounting, documents, evaluation, invoices, quality, resolution, runs, sinks, streams, text  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
