"""End-to-end jobs: model training, batch scoring, reports."""
