"""Extensions beyond the batch operators: edit logs and arriving points as streams."""
