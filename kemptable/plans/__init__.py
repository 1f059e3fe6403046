"""Several operators planned together: profile requests and cleaning recipes."""
