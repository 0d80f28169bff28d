import random

import numpy as np
from plumbline.llm import tokens

ODD = [
    "don't we'll 'tis x's o'clock's' a''b it's, 'S", "a  b\n\n c\t d ", "ﬁ ß× ÷a café, naïve!! Ж日本 x² ½", "", " ", "a", " a", "a ", "Ġx Ċ y",
    "<|endoftext|> a <|endoftext|>", "a<|endoftext|> b", "w x é́ ǆ ɏ ɐ _a_ a_ -b a- b_c x1 1x !a a! 'll a'll b", "one.\nTwo three,\nfour\n\nfive\n six",
]


def test_ids_equal_the_librarys_own():
    from tokenizers import Tokenizer

    enc, own = tokens.encoder(), Tokenizer.from_file(tokens.default_vocabulary())
    r = random.Random(1)
    signs = list("abzé'!,.- \n\t_1²ßЖ日 ×Ġ<|>  \x1c")
    texts = ODD + ["".join(r.choices(signs, k=r.randrange(60))) for _ in range(3000)] + [None]
    want = [np.array(own.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for k in range(0, len(texts), 500):
        assert enc.encode_all(texts[k : k + 500]) == want[k : k + 500]


def test_beyond_the_memory_of_words(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    enc = tokens.Encoder(tokens.default_vocabulary())
    texts = ["some words, here\nand there " + str(i) for i in range(20)]
    want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode_all(texts) == want and enc.encode_all(texts[::-1]) == want[::-1]
    assert enc.pieces.n <= 2 * len(texts)


def test_long_texts_are_cut_where_pieces_begin(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "GROUP", 256)
    own, enc = Tokenizer.from_file(tokens.default_vocabulary()), tokens.Encoder(tokens.default_vocabulary())
    r = random.Random(3)
    texts = [" ".join(r.choices(["word", "don't", "a1", "  x", "\n\n", "é!", "'s", "日本"], k=900)) for _ in range(4)] + ["x" * 2000, "a\u00a0b " * 200, "<|endoftext|> b " * 90]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode_all(texts) == want


def test_added_tokens_are_single_ids():
    """Against the library as it is loaded, not the object that the encoder may have set up."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.default_vocabulary())
    texts = [*ODD, "a <|endoftext|> b", "x<|endoftext|>\n\n<|endoftext|> y  z", "plain words only", "<|endoftext|"]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.encoder().encode_all(texts) == want
    assert 50256 in np.frombuffer(want[len(ODD)], "<u4")
