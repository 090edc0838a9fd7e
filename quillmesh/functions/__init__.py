"""Column functions on bibliographic text."""
