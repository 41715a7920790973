"""DataFrame operators: pure functions, frames in and frames out."""
