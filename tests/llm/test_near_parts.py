"""Wide radius: pairs by parts of the bits are the pairs of all against all, with far less work; ids are decoded as they lie."""

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import bpe, simhash


def links(found, same):
    """Pairs of indices; of one table with itself in one order, and without each with itself."""
    pairs = {(int(a), int(b)) for i, j in found for a, b in zip(i, j, strict=True)}
    return {(min(p), max(p)) for p in pairs if p[0] != p[1]} if same else pairs


def planted(n, m, seed):
    """Fingerprints of which some on the right differ from one on the left by 0 to 29 bits anywhere."""
    rng = np.random.default_rng(seed)
    left, right = (rng.integers(0, 1 << 64, (k, 2), dtype=np.uint64) for k in (n, m))
    for k in range(90):
        right[k] = left[k]
        for b in rng.choice(128, k % 30, replace=False):
            right[k, b // 64] ^= np.uint64(1 << int(b % 64))
    return left, right


@pytest.mark.parametrize("radius", [25, 24, 3])
@pytest.mark.parametrize("same", [False, True])
def test_parts_lose_no_pair(monkeypatch, radius, same):
    monkeypatch.setattr(simhash, "GROUP_PAIRS", 0)  # else so few are compared all with all
    left, right = planted(2000, 1500, radius)
    if same:
        left = right = np.concatenate([left, right])
    want = links(simhash.near_lanes(left, right, same, radius), same)
    assert len(want) >= 3 * min(radius + 1, 30) and links(simhash.near_parts(left, right, same, radius), same) == want


def test_similar_ones_are_compared_all_with_all(monkeypatch):
    """Thousands that share most parts would be compared many times over."""
    left = np.random.default_rng(3).integers(0, 4, (3000, 2), dtype=np.uint64)
    called = []
    whole = simhash.near_lanes
    monkeypatch.setattr(simhash, "near_lanes", lambda *a: called.append(1) or whole(*a))
    assert simhash.forest(3000, simhash.near_parts(left, left, True, 25)).max() == 0 and called


def test_parts_compare_fewer(monkeypatch):
    """Of 60,000 fingerprints less than a quarter of the pairs."""
    left, right = planted(60_000, 20_000, 5)
    seen = []
    count = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x, out=None: seen.append(x.size) or count(x, out=out))
    assert links(simhash.near_parts(left, right, False, 25), False)
    assert sum(seen) < 2 * len(left) * len(right) / 4


def test_decoding_asks_no_database():
    """Every id of the vocabulary, empty texts among others, and an id that is none."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = bpe.Coder(ranks, public_tokenizers.PATTERN)
    coder.db.close()
    ids = [np.array([r for _, r in ranks], "<u4").tobytes(), b"", *(r.to_bytes(4, "little") for _, r in ranks[:300]), b""]
    assert coder.decode(ids) == [b"".join(t for t, _ in ranks), b"", *(t for t, _ in ranks[:300]), b""]
    assert coder.decode([]) == [] and coder.decode([b""]) == [b""]
    with pytest.raises((ValueError, IndexError)):
        coder.decode([(max(r for _, r in ranks) + 1).to_bytes(4, "little")])
