"""facewave: Spark jobs over facial-movement frames, EEG windows and training text."""
