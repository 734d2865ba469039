"""Table operators: filters, dedupe, ranking, keywords, coverage, applications, mail."""
