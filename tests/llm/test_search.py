"""The streaming search against a plain one, on small models whose pieces overlap without end."""

import itertools
import random

from cinelake.llm.pieces import Pieces


def plain(model, text):
    """The best ids by a table of the whole text; equal sums take the longer last piece."""
    best = [(0.0, 0, ())] + [None] * len(text)
    for at in range(len(text)):
        for end in range(at + 1, min(len(text), at + model.longest) + 1):
            score, ids = None, ()
            if text[at:end] in model.scores:
                score, number = model.scores[text[at:end]]
                ids = (number,)
            elif end == at + 1:
                score, ids = model.worst, tuple(model.byte_ids[b] for b in text[at].encode())
            if score is not None and (best[end] is None or best[at][0] + score > best[end][0]):
                best[end] = best[at][0] + score, at, ids
    out, end = [], len(text)
    while end:
        out.append(best[end][2])
        end = best[end][1]
    return list(itertools.chain(*reversed(out)))


def small(pieces):
    return Pieces([(256 + k, text, score) for k, (text, score) in enumerate(pieces.items())], {b: b for b in range(256)}, 256 + len(pieces))


def test_random_models():
    rng = random.Random(5)
    for _ in range(150):
        letters = "abcé"[: rng.randint(2, 4)]
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 6))): float(-rng.randint(1, 6)) for _ in range(rng.randint(1, 12))}
        model = small(pieces)
        text = "".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 400)))
        assert list(model.search(text)) == plain(model, text)


def test_paths_that_never_meet():
    model = small({"ab": -1.0, "ba": -1.0, "a": -1.0, "b": -1.0})
    for n in (1, 2, 7, 64, 999):
        for text in ("ab" * n, "ab" * n + "a", "a" + "ba" * n + "zz" + "b" * n):
            assert list(model.search(text)) == plain(model, text)


def test_ids_leave_before_the_end():
    model = small({"ab": -1.0, "ba": -1.5, "a": -1.0, "b": -1.0, "abab": -2.1})
    size = 100_000
    text = "ab" * size
    seen = []

    class Text(str):
        """Notes how far the search has read."""

        def __getitem__(self, key):
            seen.append(key.start if isinstance(key, slice) else key)
            return str.__getitem__(self, key)

    ids = model.search(Text(text))
    next(ids)
    assert max(seen) < 100
    assert sum(1 for _ in ids) == size - 1
