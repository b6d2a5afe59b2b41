"""Readers and writers: texts, dictionaries, lexicons, profiles, logs and caches."""
