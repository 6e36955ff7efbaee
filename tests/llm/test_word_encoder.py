"""The word encoder against the tokenizer itself, on texts that are hard to cut."""

import random

import numpy as np
import public_tokenizers

from fieldloom.llm.token_pack import WordEncoder

LETTERS = "aB1.,;'sS \n\t|#é́ßİΣς²½一🙂‍<>-_$कक़שׁ"


def test_ids_equal_the_tokenizers():
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = ["", " ", "\n", "Don't!? it's... <|endoftext|>. x<|startoftext|>y", "İ| İstanbul.", "क़. שׁ!", "五½. ⅷ.", "in\xa0nb. a\u0085b.", "x" * 20000, "ab. " * 20000]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for text, got in zip(texts, encoder.many(texts), strict=True):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text[:80]
    assert encoder.many([]) == []


def test_special_tokens_keep_their_case():
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|>, b", "X<|StartOfText|>Y! <|endoftext|>", "A<|endoftext|>B."]
    for text, got in zip(texts, encoder.many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
