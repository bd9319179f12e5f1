"""Words for the lexicon are counted where texts are read, and pieces are cut as the tokenizer cuts them."""

from collections import Counter

import numpy as np
import public_tokenizers
import re
import regex
from tokenizers import Tokenizer

from heatlens.llm import lexicon_bpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_words_leave_a_batch_once(spark):
    texts = ["Ein Wort, ein WORT: ein wort. Überall ähnlich"] * 300 + [None, "", "12 34"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = lexicon_bpe._word_counts(docs).collect()
    assert Counter({r.word: r.n for r in rows}) == Counter({"ein": 900, "wort": 900, "überall": 300, "ähnlich": 300})
    assert len(rows) == 4
    assert sorted(lexicon_bpe.frequent_words(docs)) == ["ein", "wort", "ähnlich", "überall"]


def test_pieces_of_plain_texts():
    plain = [chr(c) for c in range(0x250) if not lexicon_bpe._OTHER.search(chr(c))]
    library = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    for a in plain:
        for b in plain:
            assert lexicon_bpe._PIECE.findall((a + b).lower()) == library.findall((a + b).lower())


def test_merged_words_are_remembered_up_to_a_bound(tmp_path, monkeypatch):
    path = tmp_path / "empty.bin"
    path.write_bytes(lexicon_bpe.compile_lexicon([]))
    monkeypatch.setattr(lexicon_bpe, "MERGED_WORDS", 8)
    monkeypatch.setattr(lexicon_bpe.SparkFiles, "get", lambda name: name)
    bpe, exact = lexicon_bpe.WordBpe(VOCABULARY, str(path)), Tokenizer.from_file(VOCABULARY)
    for n in range(40):
        text = f"qzxva{chr(97 + n % 20)} blorpnik{chr(97 + n % 7)} it's {'y' * (n * 9 + 1)} qzxvaa"
        ids, decoded = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids
        assert len(bpe.merged) <= 8 and all(re.fullmatch(".{1,64}", w) for w in bpe.merged)
