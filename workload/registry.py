"""All registered queries: name -> (Spark query, equivalent SQL or None)."""

from workload import checklist_queries, extraction_queries, intake_queries, licence_queries, quality_queries, registry_queries, text_queries

REGISTERED = {**text_queries.QUERIES, **quality_queries.QUERIES, **extraction_queries.QUERIES, **registry_queries.QUERIES, **checklist_queries.QUERIES, **licence_queries.QUERIES, **intake_queries.QUERIES}
