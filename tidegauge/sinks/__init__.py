"""Writers of run files, silver tables, results, classifications and verdicts."""
