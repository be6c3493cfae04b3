"""quillon: a PySpark engine for building and evaluating citation-grounded question-answer corpora."""
