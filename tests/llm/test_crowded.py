"""SimHash buckets of more members than are compared at a time, in many row orders, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinelake.llm import simhash


def bucket(seed, groups=300, members=1200):
    """Fingerprints that agree on the first mask: chains and stars of near ones, and lone ones."""
    rng = random.Random(seed)
    free = [k for k in range(64) if not simhash.covering_masks()[0] >> k & 1]
    base, found = rng.getrandbits(64), set()
    centers = [base ^ sum(1 << b for b in rng.sample(free, rng.randint(0, len(free)))) for _ in range(groups)]
    while len(found) < members:
        at = rng.choice(centers)
        for _ in range(rng.randint(1, 6)):
            found.add(at)
            at ^= sum(1 << b for b in rng.sample(free, rng.randint(1, 4)))
    return sorted(simhash.signed(x) for x in found)


def brute(fps, near):
    """Smallest fingerprint that each one reaches."""
    root = np.arange(len(fps))
    bits = np.array(fps).view(np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= near)):
        a, b = sorted((root[i], root[j]))
        if a != b:
            root[root == b] = a
    return {fp: fps[r] for fp, r in zip(fps, root)}


def joined(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("seed", range(12))
def test_links_in_any_order_of_rows(seed):
    fps = bucket(seed)
    shuffled = random.Random(seed + 100).sample(fps, len(fps))
    links = simhash.spanning_links(np.array(shuffled).view(np.uint64), np.array(shuffled), 4, rows=64 if seed % 2 else 256)
    want = brute(fps, 4)
    assert len(set(want.values())) > 20
    assert joined(links, fps) == want
    assert len(links) == len(fps) - len(set(want.values()))


@pytest.mark.parametrize("seed", range(4))
def test_one_crowded_bucket(spark, seed):
    fps = bucket(seed + 50)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long").orderBy(F.rand(seed))
    got = {r["fp"]: r["label"] for r in simhash.components(frame).collect()}
    want = brute(fps, 4)
    assert {x: got.get(x, x) for x in fps} == want
