"""All registered queries: name to (function of session and table folder, SQL or None)."""

from . import chunks, commerce, evaluation, evidence, guides, products, ranking, records, retrieval, scoring, streams, vectors

QUERIES = {**retrieval.QUERIES, **commerce.QUERIES, **chunks.QUERIES, **evaluation.QUERIES, **evidence.QUERIES, **guides.QUERIES, **products.QUERIES, **ranking.QUERIES, **records.QUERIES, **scoring.QUERIES, **streams.QUERIES, **vectors.QUERIES}
