"""Finding of round 3 on the pipeline: memory kept by a worker."""

from naskah.llm import bpe


def test_token_cache_stays_small(monkeypatch):
    assert 2 * bpe.CACHE_ENTRIES <= 200_000  # some 0.1 GB a worker at most
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    codec = bpe.Codec({bytes([i]): i for i in range(256)} | {b"ab": 256}, r"\S+")
    for i in range(500):
        text = f"ab w{i}"
        assert codec.decode(codec.encode(text)) == text.replace(" ", "").encode()
        assert "ab" in codec.cache or "ab" in codec.older  # words in use stay
        assert len(codec.cache) <= 50 and len(codec.older) <= 50
