"""All registered queries; importing a module registers its queries."""

from docmine.plans.catalog import (  # noqa: F401
    pages,
    sampling,
    layout,
    structures,
    graphs,
    search,
    evaluation,
    sequences,
    storage,
    streams,
)
from docmine.plans.registry import ORACLES, QUERIES  # noqa: F401
