"""Multi-operator jobs: ingestion, taxonomy rebuild, reports, registered queries."""
