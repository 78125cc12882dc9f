"""Estimators fitted to one site's series at a time; a site's series fits a task, and sites run in parallel."""
