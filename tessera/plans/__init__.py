"""Plan helpers: iteration, checkpoints and sizes."""
