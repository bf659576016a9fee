"""DataFrame operators: matching, gates, keyed state, scoring, events, reports."""
