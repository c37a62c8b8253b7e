"""Registered queries over the star-schema tables. Importing this package fills the registry."""

from . import baskets, catalogue, market, reports, texts, titles, users  # noqa: F401
