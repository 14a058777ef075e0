"""All registered queries and their DuckDB oracles."""

from __future__ import annotations


def all_queries():
    from tessera.plans import files, outline, site, web
    out = {}
    out.update(web.QUERIES)
    out.update(files.QUERIES)
    out.update(outline.QUERIES)
    out.update(site.QUERIES)
    return out


def all_oracles():
    from tessera.plans import oracle
    return dict(oracle.ORACLES)
