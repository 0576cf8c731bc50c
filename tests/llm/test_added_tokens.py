"""Token files give added tokens the ids that the library gives them."""

import public_tokenizers

from forecastlab.llm import token_files


def test_added_tokens_have_their_own_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, known = Tokenizer.from_file(path), token_files.Library(path)
    texts = ["abc <|endoftext|> def", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "it's <|endoftext|", "a\n\n<|endoftext|>  \n b", "", "no"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [39305, 220, 50256, 825]
    assert [ids.tolist() for ids in known.encode(texts)] == want


def test_other_tokenizer_files_go_to_the_library_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, known = Tokenizer.from_file(path), token_files.Library(path)
    texts = ["It's  a TEST", "<|endoftext|> x", "", "e\u0301te"]
    assert not known.by_pieces
    assert [ids.tolist() for ids in known.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
