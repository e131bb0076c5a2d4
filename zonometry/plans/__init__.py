"""Multi-step plans: scoring hierarchy, uncertainty, validation, event studies."""
