"""Readers and writers of log lines, events, ban ledgers, block lists and state snapshots."""
