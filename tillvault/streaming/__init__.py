"""File-drop ingestion."""
