"""Operator chains that go from captures to features and from samples to scores."""
