"""Queries over the driver tables, by name, and their SQL."""

from barline.plans import evaluation, market, paths, policies, teachers, weights
from barline.plans.views import plain_zeros

QUERIES = {**market.QUERIES, **paths.QUERIES, **weights.QUERIES, **teachers.QUERIES, **evaluation.QUERIES, **policies.QUERIES}
ORACLES = {name: plain_zeros(sql) for name, sql in (market.ORACLES | paths.ORACLES | weights.ORACLES | teachers.ORACLES | evaluation.ORACLES | policies.ORACLES).items()}
