"""The site-feasibility queries by name, and the SQL that gives the same rows."""

from . import features, files, more_features, more_sites, site_records, sites, terrain, zones

_PLANS = (terrain, zones, features, sites, more_sites, more_features, files, site_records)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
SQL: dict = {name: text for plan in _PLANS for name, text in plan.SQL.items()}
FLAGSHIP = "g07_buildability"
