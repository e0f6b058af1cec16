"""Tables from logs, payloads and other tables."""
