"""Relational operators over songs, lines, prompts and completions."""
