"""Registered queries and their SQL counterparts, by theme."""

from emberlake.plans import feeds, history, spatial, streams, tabular

MODULES = (tabular, history, spatial, feeds, streams)
