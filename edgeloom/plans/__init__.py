"""Dataset facade and test-table plans."""
