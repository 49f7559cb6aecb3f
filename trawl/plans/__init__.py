"""System definitions, fingerprints, the stage runner, and the query catalogue."""
