"""Table checks: every check returns (check_id, key, detail) rows, none = passed."""
