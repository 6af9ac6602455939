"""DataFrame operators: selection, review, storage, surrogate ids, group ranks and join sizing."""
