"""DataFrame-to-DataFrame operators; each function returns a lazy plan unless it says otherwise."""
