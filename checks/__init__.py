"""Registered queries with the SQL each is checked against."""

from checks import auditing, catalogue, cleaning, exploring, modelling, similarity

REGISTRY = {
    **cleaning.QUERIES, **auditing.QUERIES, **catalogue.QUERIES, **exploring.QUERIES, **similarity.QUERIES,
    **modelling.QUERIES,
}
