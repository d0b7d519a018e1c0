"""The graph language: parser and planner."""
