"""Units of texts that the tokenizer sees once, and their ids."""

import random

from pressroll.llm import packed_ids


def _encoder(limit=400_000):
    import public_tokenizers

    return packed_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 2, limit)


def test_a_word_is_one_unit_whatever_mark_follows():
    encoder = _encoder()
    encoder.encode([" thered thered, thered. thered### thered\n thered; thered?\nThered"])
    assert [u for u in encoder.known if "thered" in u] == [" thered"]


def test_units_give_the_librarys_ids():
    from tokenizers import Tokenizer

    encoder = _encoder(limit=300)  # forgets again and again
    library = Tokenizer.from_file(encoder.path)
    random.seed(3)
    signs = [*"abcXYZ", "é", "ß", "×", "÷", "ж", "́", "'s", "'", ",", ".", "###", "12", "½", "\n", "\n\n", "\r\n", "\t", "\x85", "\xa0",
             "\x00", " ", " ", " ", "  ", " \n", "<|endoftext|>", "Ġ", "word"]
    for _ in range(20):
        texts = ["".join(random.choices(signs, k=random.randint(0, 30))) for _ in range(100)]
        ids, first = encoder.encode(texts)
        for i, text in enumerate(texts):
            assert ids[first[i] : first[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text
