"""The thin opN_ queries, one module per operator."""
