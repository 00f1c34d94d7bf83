"""All queries over image requests, with the SQL that checks each."""

from __future__ import annotations

from . import dashboards, metadata, networks, options, origin, parts, payloads, policies, public, rasters, requests, service, stores, streams, wire

_ALL = {**requests.QUERIES, **service.QUERIES, **rasters.QUERIES, **wire.QUERIES, **policies.QUERIES, **options.QUERIES, **metadata.QUERIES, **origin.QUERIES, **public.QUERIES, **streams.QUERIES, **networks.QUERIES, **parts.QUERIES, **dashboards.QUERIES, **payloads.QUERIES, **stores.QUERIES}


def queries():
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
