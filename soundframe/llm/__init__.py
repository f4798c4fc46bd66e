"""Operators for preparing training data: ten jobs over documents, pages and conversations. Nothing else imports this package."""
