"""End-to-end jobs: prepare, train, evaluate, report, rank."""
