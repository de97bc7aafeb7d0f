"""Token ids: the words of a batch are encoded together."""

from vitalis.llm import tokenids
from vitalis.llm.textkit import worker_cache
from vitalis.llm.tokens import vocabulary_path


def test_words_of_a_batch_are_encoded_together(monkeypatch):
    path = vocabulary_path()
    monkeypatch.delitem(worker_cache(), ("ids", path), raising=False)
    calls = []
    encode = tokenids.IdEncoder._encode
    monkeypatch.setattr(tokenids.IdEncoder, "_encode", lambda self, words: calls.append(len(words)) or encode(self, words))
    texts = [f"word{i} " * 40_000 for i in range(12)]  # some 3 million characters, new words in each text
    ids, offs = tokenids.IdEncoder(path)(texts)
    assert len(calls) == 1
    monkeypatch.delitem(worker_cache(), ("ids", path), raising=False)
    monkeypatch.setattr(tokenids, "BLOCK_CHARS", 1 << 18)
    small, small_offs = tokenids.IdEncoder(path)(texts)
    assert len(calls) > 4 and (ids == small).all() and (offs == small_offs).all()
