"""A reward function of a user's, loaded by path: nothing imports this file."""


def score(prediction, truth):
    """1 for an answer in the truth's words, whatever their case; the share of common words otherwise."""
    if prediction is None or truth is None:
        return None
    a, b = set(prediction.lower().split()), set(truth.lower().split())
    return len(a & b) / max(len(a | b), 1)
