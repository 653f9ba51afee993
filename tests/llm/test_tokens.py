import random

import numpy as np

from marlstone.llm import tokens


def test_plain_texts_are_split_together():
    """The pieces of random plain texts by bytes are those of the tokenizer's pattern, and no text is searched by the pattern; the ids are the tokenizer's own."""
    import regex
    from tokenizers import Tokenizer

    random.seed(5)
    parts = ["'", "''", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'l", "s", "t", "re", "d", "é", "Œ", "ß", "ÿ", "A", "z", "1", "23", ".", "!?", "<", " ", "  ", "\n", "\t", "\r\x0b\f", "-"]
    texts = ["", " ", "'", "'s", "it's", "'ll", "x'"] + ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(3000)]
    lower = [t.lower() for t in texts]
    found, firsts = tokens.pieces_of(lower)
    got = [found[x:y].to_pylist() for x, y in zip(firsts.tolist(), firsts.tolist()[1:], strict=False)]
    assert got == [regex.findall(tokens._PATTERN, t) for t in lower]

    encoder = tokens.Encoder(tokens.default_tokenizer())

    def searched(text):
        raise AssertionError(text)

    encoder.find = searched
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode([]) == [] and encoder.encode([None, ""]) == [b"", b""]
