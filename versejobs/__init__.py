"""Spark jobs for lyric and verse text: syllables, rhyme scores, training samples, prompts and rewards."""
