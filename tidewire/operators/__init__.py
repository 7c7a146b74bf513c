"""DataFrame operators of the domain; `now` is always an argument."""
