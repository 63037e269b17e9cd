"""Registered queries: importing the submodules fills the registry."""

from papersieve.catalog import (  # noqa: F401
    bytes_and_scripts,
    documents,
    history,
    evaluation,
    opinions,
    sources_and_links,
    streams,
)
from papersieve.catalog.registry import ORACLES, QUERIES  # noqa: F401
