import random

from siftlog.llm import bpe


def test_a_full_memory_keeps_what_is_met_again(monkeypatch):
    """Frequent words beside ever new ones: the frequent ones are merged once."""
    monkeypatch.setattr(bpe, "MEMO", 400)
    codec = bpe.Codec(bpe.vocabulary_path())
    merged: list[str] = []
    batch = codec.word_batch
    monkeypatch.setattr(codec, "word_batch", lambda words: merged.extend(words) or batch(words))
    rng, known = random.Random(4), bpe.ChunkMemo(codec, lambda raw: raw)
    common = ["harbour", "<|endoftext|>", "Signal,", "étoile", "x1"]
    for _ in range(30):
        fresh = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(60)]
        texts = [" ".join([*common, *fresh[:30]]), "", " ".join([*fresh[30:], *common, "<|ENDOFTEXT|>"])]
        assert [b"".join(p) for p in known.parts(texts)] == [b"".join(i.to_bytes(4, "little") for i in codec.encode(t)) for t in texts]
    assert merged.count("harbour") == merged.count("étoile") == merged.count("signal") == 1
