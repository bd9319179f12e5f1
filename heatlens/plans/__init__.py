"""End-to-end classifiers: from an access table to a hot set."""
