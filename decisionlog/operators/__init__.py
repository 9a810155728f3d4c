"""DataFrame transforms over decision logs."""
