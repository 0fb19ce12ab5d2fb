"""The registered queries, their SQL, and storage helpers."""
