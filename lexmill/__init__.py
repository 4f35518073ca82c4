"""lexmill: analytics over legal documents, as functions from DataFrame to DataFrame."""
