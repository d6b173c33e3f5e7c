import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docspark.llm.tokens import ChunkEncoder

FILES = (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))


@pytest.mark.parametrize("name,spaces_matter", FILES)
def test_a_word_is_encoded_once_whatever_stop_follows(name, spaces_matter):
    encode, asked = ChunkEncoder(public_tokenizers.path(name), spaces_matter), []
    model = encode.known.model
    encode.known.model = lambda signs: asked.append(signs) or model(signs)
    for text in ("a wombat a wombat. a wombat, a", "a wombat,\na wombat. a"):
        encode.ids([text])
    assert sum("wombat" in signs for signs in asked) == 1


@pytest.mark.parametrize("name,spaces_matter", FILES)
@pytest.mark.parametrize("most", (0, 5, 300_000))
def test_ends_of_words(name, spaces_matter, most):
    path = public_tokenizers.path(name)
    whole, encode = Tokenizer.from_file(path), ChunkEncoder(path, spaces_matter, most)
    words = "a. é, É. à. ÿ, ×. ÷, ß. İ. ª, a.b a., a.. ., . .a 's. it's, 9. a9, <|endoftext|>. <|endoftext. - -. 世. 世, é. Ab, Ã. Ã—,".split()
    texts = ["", ".", ",", " .", " ".join(words), "\n".join(words), *words, *(f"x {w}" for w in words), *(f"{w}\ny " for w in words), None]
    for _ in range(2):
        for some in (texts, texts[:1], texts[::-1], []):
            want = [whole.encode(t or "", add_special_tokens=False).ids for t in some]
            assert [list(memoryview(x).cast("I")) for x in encode.ids(some)] == want
    assert len(encode.words) <= most
